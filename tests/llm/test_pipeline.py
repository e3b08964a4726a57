import importlib.util
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from nosoflow.llm import catalog, common

from . import test_jaccard
from .conftest import prose
from .test_toxicity import text

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    """A folder of tables with planted toxic texts, texts without letters, copies and near copies."""
    rows = [(i, text(i, i % 4 == 0)) for i in range(300)]
    rows += [(1000 + i, rows[4 * i + 1][1].replace(" ", "\n")) for i in range(10)]
    rows += [(2000 + i, rows[4 * i + 2][1] + " more") for i in range(10)]
    rows += [(3000, "123 456 !!"), (3001, None), (3002, ""), (3003, prose(3, 4000))]
    base = tmp_path_factory.mktemp("tables")
    docs = make_docs([(i, t, "en", f"s{i % 9}") for i, t in rows]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{base}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300) if i % 3], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages_drop_what_is_planted(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, docs, folder), name)
        assert after.columns == docs.columns
        kept[name], docs = {r.doc_id for r in after.select("doc_id").collect()}, after
    ordinary = {i for i in range(300) if i % 4}
    assert not any(i < 300 and i % 4 == 0 for i in kept["toxicity"]) and kept["toxicity"] >= ordinary
    assert kept["language_id"] == kept["toxicity"] - {3000, 3001, 3002}
    assert kept["exact_dedup"] == kept["language_id"] - {1000 + i for i in range(10)} and kept["ngram_jaccard"] == kept["exact_dedup"] - {2000 + i for i in range(10)}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    whole = Tokenizer.from_file(catalog.tokenizer("byte_bpe_50k.json"))
    lengths = {r.doc_id: len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    packed = {}
    for r in rows:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == lengths
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_dropped_near_copies_equal_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {c for c, _, _ in test_jaccard.brute(docs.collect()).values()}
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, folder).collect()} == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, folder, awkward, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty, folder).collect() == []
    rows = stage(spark, awkward, folder)
    assert rows.count() <= awkward.count() + 100
    if name != "best_fit_packing":
        assert rows.columns == awkward.columns and {tuple(r) for r in rows.collect()} <= {tuple(r) for r in awkward.collect()}


def test_registered_queries(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in names) == [*range(1, 14)] and "pipeline" in entry.queries()
    assert importlib.util.find_spec("nosoflow.llm")


@pytest.mark.skipif(not importlib.util.find_spec("duckdb"), reason="no DuckDB")
def test_queries_with_sql_equal_it(spark):
    import duckdb

    from nosoflow.llm.catalog import ORACLES, QUERIES

    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    for name, sql in ORACLES.items():
        result = db.execute(sql)
        columns = [d[0] for d in result.description]
        got = QUERIES[name](spark, DATA)
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(result.fetchall())


def test_scratch_folders_are_below_the_shared_one(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    frame = common.stored(spark.range(5), "x")
    assert all(f.startswith(shared) for f in frame.inputFiles()) and frame.agg(F.sum("id")).first()[0] == 10
