import random

import numpy as np
import pytest

from nosoflow.llm import hyperminhash

from .conftest import prose
from .test_jaccard import variants


def grams(text):
    words = (text or "").encode().lower().split()
    n = min(4, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(rows):
    """n_shingles, component_id and kept of each id, from all pairs of rows."""
    rows = list({(r.doc_id, r.text or "") for r in rows if r.doc_id is not None})
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            one_id = rows[a][0] == rows[b][0]
            if sets[a] and sets[b] and (one_id or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for a, (doc_id, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), doc_id), doc_id)
    out = {}
    for a, (doc_id, _) in enumerate(rows):
        size = max(len(sets[a]), out.get(doc_id, (0,))[0])
        out[doc_id] = (size, least[find(a)], least[find(a)] == doc_id)
    return out


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(df).collect()}


@pytest.fixture(scope="module")
def near(make_docs):
    """Groups of near copies of several sizes, short texts, copies, and a passage that many texts share."""
    texts = [t for seed, count in ((1, 40), (2, 12), (3, 2), (4, 2), (5, 7)) for t in variants(seed, count, words=160)]
    texts += [t for seed in range(20) for t in variants(600 + seed, 3, words=9 + seed, edits=1)]
    texts += [" ".join(prose(700 + i, 8).split()[:7 + k]) for i in range(15) for k in (0, 1)]  # 4 of 5 shingles: exactly at the threshold
    texts += texts[:10] + [t.upper() for t in texts[50:55]] + [prose(300 + i, 30) + " " + prose(99, 60) for i in range(30)]
    texts += [prose(1000 + i, 50) for i in range(20)] + ["one two", "One  TWO", "one two!", "one", "Élan vital", "élan vital", "a b c", "a b c"]
    order = random.Random(3).sample(range(len(texts)), len(texts))
    return make_docs([(i, texts[k]) for i, k in enumerate(order)])


def test_equals_all_pairs(near):
    assert got(near) == brute(near.collect())


def test_large_blocks_and_buckets_are_cut_into_tiles(near, monkeypatch):
    from nosoflow.llm import jaccard

    monkeypatch.setattr(jaccard, "TILE", 5)
    monkeypatch.setattr(hyperminhash, "BUCKET_TILE", 4)
    assert got(near) == brute(near.collect())


def test_awkward_rows(awkward, empty):
    rows = awkward.collect()
    found = hyperminhash.near_duplicates(awkward).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is not None} == brute(rows)
    nameless = sorted((r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is None)
    assert nameless == [(0, None, True), (57, None, True)] and len(found) == len({r.doc_id for r in rows}) + 1
    assert hyperminhash.near_duplicates(empty).collect() == []


def test_the_number_of_bands_follows_from_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        bands = hyperminhash.bands_for(0.8, recall)
        assert 1 - (1 - 0.8**6) ** bands >= recall > 1 - (1 - 0.8**6) ** (bands - 1)
    with pytest.raises(ValueError):
        hyperminhash.bands_for(0.5, 0.9999)


def test_registers_hold_zeros_and_mantissa_of_the_least_hash_of_each_bucket():
    rng = np.random.default_rng(2)
    hashes = np.unique(rng.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2) + np.uint64(1))
    held = hyperminhash.registers(hashes)
    least = {}
    for h in hashes.tolist():
        least[h >> 56] = min(least.get(h >> 56, 1 << 56), h & (1 << 56) - 1)
    for bucket, rest in least.items():
        zeros = 56 - rest.bit_length()
        mantissa = (rest << zeros >> 51) - 16
        assert held[bucket] == min(zeros, 15) << 4 | mantissa


def test_estimates_are_corrected_for_chance_collisions():
    rng = np.random.default_rng(0)
    for size in (3, 40, 600, 60_000):
        for truth in (0.0, 0.8):
            found = []
            for _ in range(60 if size < 1000 else 8):
                values = rng.integers(0, 1 << 63, 2 * size, np.uint64) * np.uint64(2)
                shared = round(2 * size * truth / (1 + truth))
                a, b = values[:size], values[size - shared:2 * size - shared]
                exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                equal = (hyperminhash.registers(np.unique(a)) == hyperminhash.registers(np.unique(b))).sum()
                found.append(float(hyperminhash.estimated(np.array(equal), np.array(size))) - exact)
            assert abs(np.mean(found)) < 0.02


def test_repeated_rows_are_one_document(make_docs):
    docs = make_docs([(2, prose(1, 40)), (2, prose(1, 40)), (1, prose(1, 40)), (3, prose(2, 40))])
    assert got(docs) == {1: (37, 1, True), 2: (37, 1, False), 3: (37, 3, True)}
