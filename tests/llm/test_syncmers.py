import hashlib
import random

import numpy as np

from nosoflow.llm import syncmers

from .conftest import prose


def brute_places(text, k=syncmers.K, s=syncmers.S):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inner = [int(syncmers.mixed(syncmers._windows(points[i:i + s], s))[0]) for i in range(len(points) - s + 1)]
    out = []
    for i in range(len(points) - k + 1):
        window = inner[i:i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            out.append(i)
    return out


def test_closed_syncmers():
    for text in (prose(1, 60), "a" * 40, "日本語" * 20, "x" * 15, ""):
        assert syncmers.anchors(text)[0].tolist() == brute_places(text)


def test_anchors_don_t_depend_on_their_surroundings():
    passage = prose(2, 50)
    own = {(p, h) for p, h in zip(*(x.tolist() for x in syncmers.anchors(passage)))}
    text = "before, " + passage + " after"
    inside = {(p - 8, h) for p, h in zip(*(x.tolist() for x in syncmers.anchors(text)))}
    assert own <= inside


def test_every_stretch_has_an_anchor():
    places = syncmers.anchors(prose(3, 2000))[0]
    assert np.diff(places).max() <= syncmers.K - syncmers.S


def test_fingerprint_holds_the_smallest_anchors_and_grows_with_the_text():
    for text in (prose(4, 30), prose(5, 3000), "ab" * 3000):
        places, values = syncmers.anchors(text)
        first = {}
        for p, h in zip(places.tolist(), values.tolist()):
            first.setdefault(h, p)
        count = max(syncmers.SIZE, sum(h < (1 << 32) // syncmers.SHARE for h in first))
        assert syncmers.fingerprint(text) == "".join(f"{h:08x}{first[h]:08x}" for h in sorted(first)[:count])
        assert syncmers.fingerprint(text, share=1) == "".join(f"{h:08x}{first[h]:08x}" for h in sorted(first))
    assert len(syncmers.fingerprint(prose(5, 9000))) > 2.5 * len(syncmers.fingerprint(prose(5, 3000))) > 16 * 3 * syncmers.SIZE
    assert syncmers.fingerprint("") == "" and len(syncmers.fingerprint("short")) == 16


def test_likeness():
    texts = [prose(i, 300) for i in range(12)]
    prints = [syncmers.fingerprint(t) for t in texts]
    for i, t in enumerate(texts):
        near = syncmers.fingerprint(t.replace("boat", "ship", 1) + " end")
        half = syncmers.fingerprint(syncmers.edited(t, texts[i - 1]))
        other = syncmers.likeness(prints[i], prints[i - 1])
        assert syncmers.likeness(prints[i], prints[i]) == 1.0
        assert syncmers.likeness(prints[i], near) > 0.85 > 0.7 > syncmers.likeness(prints[i], half) > 0.25 > 0.1 > other
        assert syncmers.likeness(prints[i], half) == syncmers.likeness(half, prints[i])
    assert syncmers.likeness("", "") == 1.0 and syncmers.likeness("", prints[0]) == 0.0
    # anchors in another order are not a match
    words = prose(50, 200)
    assert syncmers.likeness(syncmers.fingerprint(words), syncmers.fingerprint(words[len(words) // 2:] + words[:len(words) // 2])) < 0.75


def brute_likeness(a, b, size=syncmers.SIZE, share=syncmers.SHARE):
    """By dictionaries: what both texts' fingerprints hold up to the hash at which the first of them stops."""
    if a == b:
        return 1.0
    both = [{int(p[i:i + 8], 16): int(p[i + 8:i + 16], 16) for i in range(0, len(p), 16)} for p in (a, b)]
    last = min(max(sorted(x)[size - 1], (1 << 32) // share - 1) if len(x) >= size else 1 << 32 for x in both)
    x, y = ({h: p for h, p in one.items() if h <= last} for one in both)
    order = [y[h] for h in sorted(x, key=x.get) if h in y]
    best = []
    for i, place in enumerate(order):
        best.append(1 + max((best[j] for j in range(i) if order[j] < place), default=0))
    return 2 * max(best, default=0) / (len(x) + len(y)) if best else 0.0


def test_likeness_equals_brute_force():
    rnd = random.Random(8)
    texts = [prose(i, n) for i, n in enumerate((0, 3, 20, 60, 300, 900, 1500))]
    texts += [texts[5][:k] + texts[6][k:] for k in (500, 3000)] + [texts[6][2000:] + texts[6][:2000]]
    prints = [syncmers.fingerprint(t) for t in texts]
    for _ in range(60):
        a, b = rnd.choice(prints), rnd.choice(prints)
        assert abs(syncmers.likeness(a, b) - brute_likeness(a, b)) < 1e-12


def test_a_passage_that_two_long_texts_share_is_found():
    passage = prose(99, 200)
    a, b = (prose(seed, 12_000) + " " + passage + " " + prose(seed + 1, 12_000) for seed in (11, 21))
    apart = prose(31, 24_000)
    assert min(len(a), len(b)) > 150_000
    found = [syncmers.likeness(syncmers.fingerprint(x), syncmers.fingerprint(y)) for x, y in ((a, b), (a, apart))]
    shared = [syncmers.fingerprint(x) for x in (a, b)]
    common = {shared[0][i:i + 8] for i in range(0, len(shared[0]), 16)} & {shared[1][i:i + 8] for i in range(0, len(shared[1]), 16)}
    assert len(common) > 20 and found[0] > found[1]


def brute(rows):
    order = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    out = []
    for n, (doc_id, text) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        changed = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), syncmers.fingerprint(text), syncmers.fingerprint(changed),
                    syncmers.likeness(syncmers.fingerprint(text), syncmers.fingerprint(changed)), syncmers.likeness(syncmers.fingerprint(text), syncmers.fingerprint(following))))
    return sorted(map(str, out))


def test_documents(make_docs, awkward, empty):
    assert sorted(str(tuple(r)) for r in syncmers.fingerprints(awkward).collect()) == brute(awkward.collect())
    assert syncmers.fingerprints(empty).collect() == []
    rnd = random.Random(3)
    docs = make_docs([(rnd.randrange(10**6) - 5000, prose(i, i % 40)) for i in range(200)])
    for size in (1 << 10, 1 << 30):
        assert sorted(str(tuple(r)) for r in syncmers.fingerprints(docs, part_bytes=size).collect()) == brute(docs.collect())
    single = make_docs([(5, "alone in here")])
    assert [r.near_next for r in syncmers.fingerprints(single).collect()] == [1.0]
