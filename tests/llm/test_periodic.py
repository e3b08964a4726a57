import hashlib
import random
import zlib

import pytest

from nosoflow.llm import periodic


def brute(words):
    """All runs by comparing words q apart, for every q."""
    out = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if len(part) >= max(6, 4 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.add((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda run: (run[0], run[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sequence(rnd):
    words = [rnd.choice("abcde"[:rnd.choice([1, 2, 2, 3, 5])]) for _ in range(rnd.randrange(90))]
    if words and rnd.random() < 0.6:
        at, q = rnd.randrange(len(words)), rnd.randrange(1, 9)
        block = words[at:at + q]
        words[at:] = (block * len(words))[:len(words) - at]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_texts_compressed_together_equal_all_comparisons(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        many = [sequence(rnd) for _ in range(rnd.randrange(1, 8))]
        found = periodic._described([(i, [w.encode() for w in words]) for i, words in enumerate(many)])
        for words, runs, text in zip(many, found.column("runs").to_pylist(), found.column("collapsed").to_pylist()):
            want = brute(words)
            assert [(r["start"], r["length"], r["period"]) for r in runs] == want
            assert text == collapsed(words, want)


def test_grammar_levels_expand_to_the_text_and_answer_agreement():
    import numpy as np

    rnd = random.Random(3)
    words = [rnd.randrange(1, 4) + 1 for _ in range(300)] + [2] * 60
    numbers = np.array([0, *words, 1])
    levels = periodic.grammar(numbers, 2)
    assert len(levels[-1].symbols) == 3 and levels[-1].lengths.tolist() == [1, 360, 1]
    for low, high in zip(levels, levels[1:]):
        assert high.lengths.sum() == len(numbers)
        for k in range(len(high.symbols)):
            parts = low.symbols[high.firsts[k]:high.firsts[k + 1]]
            assert low.lengths[high.firsts[k]:high.firsts[k + 1]].sum() == high.lengths[k]
            assert len(set(parts.tolist())) == 1 or len(parts) == 2
        rules = {}
        for k, symbol in enumerate(high.symbols.tolist()):
            assert rules.setdefault(symbol, low.symbols[high.firsts[k]:high.firsts[k + 1]].tolist()) == low.symbols[high.firsts[k]:high.firsts[k + 1]].tolist()
    a = np.array([rnd.randrange(1, 360) for _ in range(400)])
    b = np.array([x % 360 + 1 if x == y else y for x, y in zip(a.tolist(), (rnd.randrange(1, 361) for _ in a))])
    for x, y, n in zip(a.tolist(), b.tolist(), periodic.agreement(levels, a, b).tolist()):
        assert numbers[x:x + n].tolist() == numbers[y:y + n].tolist() and numbers[x + n] != numbers[y + n]


def test_the_query_equals_brute_force_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs, got = brute(words), found[doc_id]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        assert got.n_runs == len(runs)
        assert (got.start, got.length, got.period, got.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert got.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        kept = collapsed([w.decode() for w in words], runs)
        assert got.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 5


def test_awkward_rows(awkward, empty):
    rows = awkward.collect()
    found = periodic.find_runs(awkward).collect()
    want = sorted((str(r.doc_id), collapsed(w, brute(w))) for r in rows for w in [[x.decode() for x in (r.text or "").encode().split()]] if len(w) < 1000)
    assert sorted((str(r.doc_id), r.collapsed) for r in found if len(r.collapsed) < 10_000) == want
    assert len(found) == len(rows) and periodic.find_runs(empty).collect() == [] and periodic.periodic_runs(empty).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    blank = [r for r in periodic.periodic_runs(awkward).collect() if r.doc_id in (1, 2, 3)]
    assert [(r.n_runs, r.start, r.runs_sha256, r.collapsed_sha256) for r in blank] == [(0, None, nothing, nothing)] * 3


def test_texts_longer_than_a_batch_and_many_grid_portions(make_docs, monkeypatch):
    monkeypatch.setattr(periodic, "PLACES", 50)
    words = [w.encode() for w in ("x y z " * 400 + "q r " + "a " * 900).split()]
    found = periodic._described([(1, words), (2, words[5:])])
    for row, part in zip(found.column("runs").to_pylist(), (words, words[5:])):
        assert [(r["start"], r["length"], r["period"]) for r in row] == brute(part)
    monkeypatch.undo()
    text = "one two three " * 120_000  # more words than a batch
    row = periodic.find_runs(make_docs([(1, text), (2, "a"), (3, text)])).where("doc_id = 3").first()
    assert [tuple(r) for r in row.runs] == [(0, 360_000, 3)] and row.collapsed == "one two three"


def test_only_ascii_blanks_part_words(make_docs):
    row = periodic.find_runs(make_docs([(1, "a b a b\ta b\na b\x0ba b\x0ca b\ra")])).first()
    assert [tuple(r) for r in row.runs] == [(0, 6, 1)] and row.collapsed == "a b a"
