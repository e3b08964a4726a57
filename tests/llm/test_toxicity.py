import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nosoflow.llm import toxicity
from nosoflow.llm.common import HASHES

from .conftest import prose

RUDE = ["blorf", "gnarx", "zwick"]


def text(i, toxic):
    words = prose(i, 60).split()
    if toxic:
        for k in range(4):
            words.insert((i * 7 + k * 13) % len(words), RUDE[(i + k) % 3])
    return " ".join(words)


@pytest.fixture(scope="module")
def data(spark, make_docs):
    docs = make_docs([(i, text(i, i % 4 == 0)) for i in range(400)])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400) if i % 3], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_held_out_texts_are_told_apart(data):
    rows = toxicity.score_documents(*data).collect()
    assert len(rows) == 400 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 60 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_are_not_learned(data, spark):
    docs, labels = data
    turned = spark.createDataFrame(
        [(r.doc_id, r.quality, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.toxic) for r in labels.collect()], labels.schema)
    assert sorted(map(tuple, toxicity.score_documents(docs, labels).collect())) == sorted(map(tuple, toxicity.score_documents(docs, turned).collect()))


def plain_discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 for k in (1, 2, 3)]
    return [0.0, *(min(0.95 * k, max(0.1, d)) for k, d in zip((1, 2, 3), raw))]


def believed(evidence, places):
    """Probability that an expression differs, with the prior that expectation maximisation finds for rounded evidence."""
    share, rounded = 0.01, [round(e * places) / places for e in evidence]
    chance = lambda e, odds: 1 / (1 + math.exp(-max(-700, min(700, e + odds))))
    for _ in range(500):
        after = min(0.5, max(1e-9, sum(chance(e, math.log(share / (1 - share))) for e in rounded) / len(rounded)))
        if abs(after - share) < 1e-9:
            break
        share = after
    return [chance(e, math.log(share / (1 - share))) for e in evidence]


def beta_evidence(n0, n1, q):
    return math.lgamma(n0 + 1) + math.lgamma(n1 + 1) - math.lgamma(n0 + n1 + 2) - n1 * math.log(q) - n0 * math.log(1 - q)


class Brute:
    """The model by dictionaries: different words before each bigram and word, modified discounts, corpus-wide continuation counts, evidence."""

    def __init__(self, texts, labels):
        used = {i: c for i, c in labels.items() if zlib.crc32(str(i).encode()) % 4 in (0, 1)}
        befores, self.corpus = {}, set()
        for i, text in texts.items():
            words = [None, None, *text.split()]
            for u, v, w in zip([0, *words], words[1:], words[2:]):
                self.corpus.add((v, w))
                if i in used:
                    befores.setdefault((v, w), (set(), set()))[used[i]].add(u if v is not None else 0)
        pairs = {p: tuple(map(len, b)) for p, b in befores.items()}
        seen = {}
        for (v, w), c in pairs.items():
            t = seen.setdefault(w, [0, 0])
            for k in (0, 1):
                t[k] += c[k] > 0
        total = [sum(t[k] for t in seen.values()) for k in (0, 1)]
        d = plain_discounts([sum(t) for t in seen.values()])
        cut = lambda n, d: d[min(n, 3)]
        self.lower = [sum(cut(t[k], d) for t in seen.values()) / total[k] for k in (0, 1)]
        shared = {w: sum(b == w for _, b in self.corpus) / len(self.corpus) for w in seen}
        own = {w: [(t[k] - cut(t[k], d)) / total[k] + self.lower[k] * shared[w] for k in (0, 1)] for w, t in seen.items()}
        differs = believed([beta_evidence(*t, total[1] / sum(total)) for t in seen.values()], 100)
        chance = {w: [shared[w] ** (1 - x) * own[w][k] ** x for k in (0, 1)] for w, x in zip(seen, differs)}
        self.word = {w: math.log(p[1] / p[0]) for w, p in chance.items()}
        self.word_plain = {w: math.log(p[1] / p[0]) for w, p in own.items()}

        d = plain_discounts([sum(c) for c in pairs.values()])
        after, spare = {}, {}
        for (v, w), c in pairs.items():
            for k in (0, 1):
                after.setdefault(v, [0, 0])[k] += c[k]
                spare.setdefault(v, [0, 0])[k] += cut(c[k], d)
        self.back = {v: [spare[v][k] / n[k] if n[k] else 1.0 for k in (0, 1)] for v, n in after.items()}

        def ratio(v, w, p):
            q = [((pairs[v, w][k] - cut(pairs[v, w][k], d)) / after[v][k] if after[v][k] else 0) + self.back[v][k] * p[w][k] for k in (0, 1)]
            return math.log(q[1] / q[0])

        sums = [sum(c[k] for c in pairs.values()) for k in (0, 1)]
        share = [sums[1] * chance[w][1] / (sums[0] * chance[w][0] + sums[1] * chance[w][1]) for _, w in pairs]
        trust = believed([beta_evidence(*c, q) for c, q in zip(pairs.values(), share)], 20)
        self.pair = {(v, w): self.word[w] + x * (ratio(v, w, chance) - self.word[w]) for (v, w), x in zip(pairs, trust)}
        self.pair_plain = {(v, w): ratio(v, w, own) for v, w in pairs}

    def measured(self, text):
        words = text.split()
        gap = plain = 0.0
        for v, w in zip([None, *words], words):
            gap += math.log1p(toxicity.MIXED * math.expm1(self.pair.get((v, w), self.word.get(w, 0.0))))
            ratio = self.word_plain.get(w, math.log(self.lower[1] / self.lower[0]))
            if v in self.back:
                ratio += math.log(self.back[v][1] / self.back[v][0])
            plain += self.pair_plain.get((v, w), ratio)
        return gap / max(len(words), 1), plain / max(len(words), 1)


def test_likelihoods_are_those_of_the_two_models(data, spark):
    """Words, bigrams, gaps, plain ratios and scores against a computation by dictionaries over all expressions."""
    docs, labels = data
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    brute = Brute(texts, {r.doc_id: r.toxic for r in labels.collect()})
    place = {w: i for i, h in enumerate(model.words.tolist()) for w in [h]}
    assert set(place) == {HASHES[w] for w in brute.word}
    for w, gain in brute.word.items():
        i = place[HASHES[w]]
        assert abs(model.word_gain[i] - gain) < 1e-6 and abs(model.word_plain[i] - brute.word_plain[w]) < 1e-9
    keys = {p: i for i, p in enumerate(model.pairs.tolist())}
    assert len(keys) == len(brute.pair)
    for (v, w), gain in brute.pair.items():
        i = keys[((place[HASHES[v]] if v is not None else -1) + 1) * len(place) + place[HASHES[w]]]
        assert abs(model.pair_gain[i] - gain) < 1e-4 and abs(model.pair_plain[i] - brute.pair_plain[v, w]) < 1e-5
    some = [*list(texts.values())[:80], "never seen", "blorf never gnarx", "never", "stone0 stone0", ""]
    rows = toxicity.score_documents(spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string"), labels, model).collect()
    assert max(r.score for r in rows) > 0.9 and min(r.score for r in rows) < 0.1
    for r in rows:
        gap, plain = brute.measured(some[r.doc_id])
        assert abs(r.log_ratio - plain) < 1e-5
        assert abs(r.score - 1 / (1 + math.exp(-max(-60, min(60, model.offset + model.slope * gap))))) < 1e-4


def test_numbers_are_packed_without_loss():
    rnd = random.Random(4)
    values = np.array([rnd.randrange(1 << rnd.randrange(1, 63)) for _ in range(500)] + [0, 255, 256, (1 << 63) - 1])
    assert toxicity.unpacked(toxicity.packed(values), len(values)).tolist() == values.tolist()
    assert toxicity.unpacked(toxicity.packed(values[:0]), 0).tolist() == []
    assert len(toxicity.packed(np.arange(200))) == 400


def test_long_texts_are_thinned_to_the_characters_named(data):
    docs, labels = data
    rows, shares = toxicity.training_rows(docs, labels, fit_chars=10_000)
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert set(shares) == {0, 1} and all(0 < share < 1 for share in shares.values()) and all(3_000 < n < 25_000 for n in sizes.values())


def test_awkward_rows(data, awkward, empty, spark):
    model = toxicity.fit(*data)
    rows = toxicity.score_documents(awkward, data[1], model).collect()
    assert len(rows) == awkward.count() and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert all(r.held_out for r in rows if r.doc_id is None)
    kept = toxicity.keep_ordinary(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(r.predicted == 0 for r in rows)
    assert toxicity.score_documents(empty, data[1]).collect() == []


@pytest.mark.parametrize("where", ["toxic = 1", "toxic = 0", "toxic > 1"])
def test_without_both_labels_nothing_is_learned(data, where):
    docs, labels = data
    assert {(r.score < 1e-9, r.predicted) for r in toxicity.score_documents(docs.limit(5), labels.where(where)).collect()} == {(True, 0)}


def test_odd_and_repeated_labels_change_nothing(data, spark):
    docs, labels = data
    more = labels.union(spark.createDataFrame([(None, 1, 1), (4, 1, None), (5, 0, 7)], labels.schema)).union(labels.limit(20))
    assert sorted(map(tuple, toxicity.score_documents(docs, labels).collect())) == sorted(map(tuple, toxicity.score_documents(docs, more).collect()))


def test_the_sample_is_bounded(data):
    _, labels = data
    rows, shares = toxicity.labelled_rows(labels, 20)
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    assert set(shares) == {0, 1} and all(share < 1 for share in shares.values()) and all(n < 45 for n in counts.values())


def test_rare_expressions_are_kept_and_count_by_their_evidence(data, spark):
    """Words of one, three and twelve toxic texts: none is cut, and what is seen more often says more."""
    docs, labels = data
    ids = sorted(r.doc_id for r in labels.where("toxic = 1").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 in (0, 1))
    more = {i: [w for w, n in (("once", 1), ("thrice", 3), ("often", 12)) if k < n] for k, i in enumerate(ids)}
    rows = [(r.doc_id, " ".join([r.text, *more.get(r.doc_id, [])])) for r in docs.collect()]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    used = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 in (0, 1)}
    texts = [[HASHES[w] for w in t.split()] for i, t in rows if i in used]
    assert set(model.words.tolist()) == {w for t in texts for w in t}
    assert len(model.pairs) == len({p for t in texts for p in zip([None, *t], t)})
    gain = dict(zip(model.words.tolist(), model.word_gain.tolist()))
    assert 0 < gain[HASHES["once"]] < gain[HASHES["thrice"]] < gain[HASHES["often"]]


def test_evidence_is_that_of_the_beta_function():
    n0, n1, q = np.array([0.0, 7, 900]), np.array([1.0, 0, 40]), np.array([0.1, 0.5, 0.01])
    want = [math.lgamma(a + 1) + math.lgamma(b + 1) - math.lgamma(a + b + 2) - b * math.log(s) - a * math.log(1 - s) for a, b, s in zip(n0, n1, q)]
    assert np.allclose(toxicity._evidence(n0, n1, q), want, rtol=1e-10)


def test_shared_counts_are_different_words_before_a_word_in_all_documents(data, spark):
    """A text copied many times counts once, a document without a label like any other, and bigrams use the same counts."""
    docs, labels = data
    texts = [r.text for r in docs.collect()]
    rows = [(i, t) for i, t in enumerate(texts + ["blorf alone", "alone blorf blorf"] + texts[:1] * 50)]
    both = {p for _, t in rows for p in zip([None, *t.split()], t.split())}
    words = sorted({w for _, w in both}, key=HASHES.__getitem__)
    keys = np.array([HASHES[w] for w in words], np.uint64)
    counts, total = toxicity._corpus_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), keys, keys[::40])
    assert total == len(both) and counts.tolist() == [sum(b == w for _, b in both) for w in words]
