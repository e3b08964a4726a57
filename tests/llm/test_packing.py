import random

from pyspark.sql import functions as F

from nosoflow.llm import packing


def brute(items, capacity):
    bins, placed = [], [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        length, source, cluster = items[i]
        best = None
        for n, (left, sources, clusters) in enumerate(bins):
            if left >= length and (source is None or source not in sources) and (cluster is None or cluster not in clusters):
                if best is None or left < bins[best][0]:
                    best = n
        if best is None:
            bins.append([capacity, set(), set()])
            best = len(bins) - 1
        placed[i] = (best, capacity - bins[best][0])
        bins[best][0] -= length
        bins[best][1].add(source)
        bins[best][2].add(cluster)
    return placed, len(bins)


def test_equals_search_over_all_bins():
    for seed in range(150):
        rnd = random.Random(seed)
        capacity = rnd.choice([7, 50, 64, 1000])
        items = [(rnd.randint(1, capacity), rnd.choice([None, *range(rnd.choice([1, 3, 8]))]), rnd.choice([None, *range(30)])) for _ in range(rnd.randint(0, 100))]
        assert packing.pack(items, capacity) == brute(items, capacity), seed


def check(rows, docs, capacity):
    """Bins are within capacity, without overlap, conflict or loss."""
    texts = {}
    for d in docs:
        texts.setdefault(d.doc_id, []).append(d)
    by_bin, total = {}, {}
    for r in rows:
        by_bin.setdefault(r.bin_id, []).append(r)
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {k: sum(len((d.text or "").encode()) + 1 for d in v) for k, v in texts.items()}
    for held in by_bin.values():
        held.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in held:
            assert r.bin_offset == at
            at += r.length
        assert at <= capacity
    return by_bin


def test_documents(awkward):
    rows = packing.pack_documents(awkward, capacity=500).collect()
    by_bin = check(rows, awkward.collect(), 500)
    assert all(len(held) == 1 for held in by_bin.values())  # one source only
    again = packing.pack_documents(awkward.orderBy(F.desc("text")).repartition(3), capacity=500).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_sources_and_clusters_stay_apart(make_docs):
    docs = make_docs([(i, f"text {i % 50}", "en", None if i % 4 == 0 else f"s{i % 7}") for i in range(300)])
    rows = packing.pack_documents(docs, capacity=100).collect()
    by_bin = check(rows, docs.collect(), 100)
    facts = {d.doc_id: (d.source, d.text) for d in docs.collect()}
    for held in by_bin.values():
        sources = [facts[r.doc_id][0] for r in held if facts[r.doc_id][0]]
        copies = [facts[r.doc_id][1] for r in held]
        assert len(set(sources)) == len(sources) and len(set(copies)) == len(copies)
    assert len(by_bin) < 100


def test_own_length_and_empty_table(make_docs, empty):
    assert packing.pack_documents(empty).collect() == []
    docs = make_docs([(1, "a"), (2, "b"), (3, "c")])
    rows = packing.pack_documents(docs, length=F.col("doc_id") * 4 - 4, cluster=F.col("doc_id"), capacity=4).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in rows) == [(2, 0, 4), (3, 0, 4), (3, 1, 4)]


def test_the_query_packs_token_counts_and_parts_copies(spark, tmp_path):
    """Lengths are those of the tokenizer, and texts that differ in white space alone never share a bin."""
    import pytest
    from tokenizers import Tokenizer

    from nosoflow.llm import catalog

    pytest.importorskip("public_tokenizers")
    whole = Tokenizer.from_file(catalog.tokenizer("byte_bpe_50k.json"))
    texts = [None, "", *(f"text number {i // 3}" + " " * (i % 3) for i in range(60))]
    rows = [(i, t, "en", f"s{i}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["op2_best_fit_packing"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.length for r in found} == {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    bins = {}
    for r in found:
        bins.setdefault(r.bin_id, []).append((texts[r.doc_id] or "").replace(" ", ""))
    assert all(len(b) == len(set(b)) for b in bins.values()) and len(bins) == 3
