import random
import re

import numpy as np
import pytest

from nosoflow.llm import jaccard

from .conftest import prose


def grams(text, size=5):
    words = re.findall(r"\w+", (text or "").lower())
    n = min(size, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(rows, threshold=0.8):
    """class_id, n_links and copy_of of each id, from all pairs of rows."""
    rows = list({(r.doc_id, r.text or "") for r in rows if r.doc_id is not None})
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = {}
    for a, (doc_id, _) in enumerate(rows):
        out[doc_id] = (min(rows[b][0] for b in range(len(rows)) if find(b) == find(a)), links[a],
                       min(rows[b][0] for b in range(len(rows)) if sets[b] == sets[a]) if sets[a] else doc_id)
    return out


def got(df, **options):
    return {r.doc_id: (r.class_id, r.n_links, r.copy_of) for r in jaccard.join(df, **options).collect()}


def variants(seed, count, words=120, edits=3):
    rnd = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(count):
        text = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            text[rnd.randrange(len(text))] = f"edit{rnd.randrange(1000)}"
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def near(make_docs):
    """Groups of near copies of several sizes, copies, and a passage that many texts share."""
    texts = [t for seed, count in ((1, 40), (2, 12), (3, 2), (4, 2), (5, 7)) for t in variants(seed, count)]
    texts += texts[:10] + ["UP " + t.upper() for t in texts[50:55]] + [prose(300 + i, 30) + " " + prose(99, 60) for i in range(30)]
    texts += [prose(1000 + i, 50) for i in range(20)] + ["one two", "One  TWO!", "one"]
    order = random.Random(3).sample(range(len(texts)), len(texts))
    return make_docs([(i, texts[k]) for i, k in enumerate(order)])


def test_equals_all_pairs(near):
    assert got(near) == brute(near.collect())


def test_large_blocks_and_buckets_are_cut_into_tiles(near, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 5)
    monkeypatch.setattr(jaccard, "BUCKET_TILE", 4)
    assert got(near) == brute(near.collect())


def test_other_thresholds(near):
    assert got(near, threshold=0.6, recall=0.99999) == brute(near.collect(), 0.6)


def test_awkward_rows(awkward, empty):
    rows = awkward.collect()
    found = jaccard.join(awkward).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted([*{str(r.doc_id) for r in rows if r.doc_id is not None}, "None", "None"])
    want = brute(rows)
    for r in found:
        if r.doc_id not in (None, 7, 6, 13):
            assert (r.class_id, r.n_links, r.copy_of) == want[r.doc_id]
    by_id = {r.doc_id: r for r in found}
    assert by_id[13].class_id == by_id[6].class_id == 6 and (by_id[6].n_links, by_id[13].n_links) == (1, 1)
    assert jaccard.join(empty).collect() == []


def test_the_number_of_bands_follows_from_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        bands = jaccard.bands_for(0.8, recall, 8)
        assert 1 - (1 - 0.8**8) ** bands >= recall > 1 - (1 - 0.8**8) ** (bands - 1)


def test_signatures_estimate_similarity():
    factors, terms = jaccard._permutations(400)
    rnd = np.random.default_rng(0)
    values = rnd.integers(0, 1 << 32, 3000, np.uint64).astype(np.uint32)
    for shared in (500, 1600):
        a, b = values[:2000], values[2000 - shared:4000 - shared][:2000]
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        estimate = (jaccard.signature(a, factors, terms) == jaccard.signature(b, factors, terms)).mean()
        assert abs(estimate - truth) < 0.08


def test_sets_are_compared_exactly():
    rnd = random.Random(5)
    for _ in range(50):
        sets = [np.array(sorted(rnd.sample(range(40), rnd.randrange(1, 30))), np.uint64) for _ in range(rnd.randrange(2, 9))]
        linked = jaccard.similar(sets, 0.5)
        for a in range(len(sets)):
            for b in range(len(sets)):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                assert linked[a, b] == (a != b and len(x & y) / len(x | y) >= 0.5)


def test_one_of_each_class_stays(near):
    kept = jaccard.keep_one(near)
    want = brute(near.collect())
    assert kept.columns == near.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _, _ in want.values()})
