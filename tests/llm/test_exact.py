import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from nosoflow.llm import exact


def brute(rows):
    groups = {}
    for doc_id, text in [(r.doc_id, r.text or "") for r in rows]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc_id is None, doc_id or 0, doc_id))
    out = []
    for text, members in groups.items():
        best = min(members)
        for m in members:
            out.append((m[3], best[3], len(members), m[:3] == best[:3], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in exact.duplicates(df).drop("text_hash").collect()), key=str)


def test_awkward_rows(awkward, empty):
    assert got(awkward) == brute(awkward.collect())
    assert got(empty) == []


def test_copies_and_near_copies(make_docs):
    base = [" ".join(f"word{(i * k) % 97}." for i in range(400)) for k in range(1, 6)]
    rows = [(i, base[i % 5]) for i in range(60)] + [(100 + i, base[i % 5].replace(" ", "\n", i)) for i in range(20)]
    rows += [(200 + i, base[i % 5] + ("x" if i % 2 else " ")) for i in range(20)]
    docs = make_docs(rows)
    assert got(docs) == brute(docs.collect())


def test_an_identifier_that_stands_for_two_chunks_is_told_apart(make_docs, monkeypatch):
    """With a hash of the chunk's length all texts of equal shape share their recipes; verification must part them."""
    real = F.xxhash64

    def weak(*columns):
        text = str(columns[0])
        return F.length(columns[0]).cast("bigint") if len(columns) == 1 and ("chunk" in text or "namedlambdavariable" in text) else real(*columns)

    docs = make_docs([(i, chr(97 + i % 3) * 700) for i in range(9)])
    monkeypatch.setattr(exact.F, "xxhash64", weak)
    assert exact.ambiguous(docs).count() > 0
    assert got(docs) == brute(docs.collect())


def test_chunks_are_cut_by_content(spark):
    rnd = random.Random(1)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x9000)))):
        text = "".join(rnd.choice(letters) for _ in range(30_000))
        df = spark.createDataFrame([(text,), ("zz9" + text,), ("!" * 20_000,)], "t string")
        a, b, none = (r.c for r in df.select(exact.chunks(F.col("t")).alias("c")).collect())
        assert "".join(a) == text and "".join(b) == "zz9" + text
        assert all(exact.SHORTEST < len(c) for c in a[:-1]) and len(set(a) & set(b)) > 0.9 * len(a) > 30
        assert [len(c) for c in none] == [8192, 8192, 20_000 - 2 * 8192]


def test_repeated_rows_equal_the_sql(make_docs):
    import duckdb

    from nosoflow.llm import catalog

    docs = make_docs([(1, "a b"), (1, "a b"), (2, "ab"), (3, None), (3, ""), (4, "c"), (6, "c "), (5, "ab ")])
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    rows = db.execute(catalog.ORACLES["op4_exact_dedup"]).fetchall()
    assert got(docs) == sorted(rows, key=str) and len(rows) == 8
    assert sorted(tuple(r) for r in exact.keep_one(docs).select("doc_id", "text").na.fill("").collect()) == [(1, "a b"), (3, ""), (6, "c ")]


def test_keep_one(awkward):
    kept = exact.keep_one(awkward)
    assert kept.columns == awkward.columns
    expected = {(r[0], r[4]) for r in brute(awkward.collect()) if r[3]}
    assert sorted((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()) for r in kept.where("doc_id is not null").collect()) == sorted(
        x for x in expected if x[0] is not None)


@pytest.mark.parametrize("name", ["duplicates", "keep_one"])
def test_no_python_runs(awkward, name):
    plan = getattr(exact, name)(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_texts_of_keep_one_are_shuffled_once(spark, awkward, no_broadcast):
    """The plan's last join and what follows it share their keys: no text is dealt again after the join."""
    plan = exact.keep_one(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Exchange" not in plan[:plan.index("LeftSemi")]
    zero = awkward.selectExpr("cast(0 AS bigint) AS doc_id", "text").union(awkward.selectExpr("cast(NULL AS bigint)", "text"))
    kept = sorted(tuple(r) for r in exact.keep_one(zero).na.fill("", ["text"]).collect())
    texts = {}
    for r in awkward.collect():
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), set()).add(r.text or "")
    assert [i for i, _ in kept] == [0] * len(kept) and {t for _, t in kept} == {t for same in texts.values() for t in same if len(t) == max(map(len, same))}
