"""Readers. Every schema is declared, so no read needs an inference pass."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nosoflow.functions.text import https
from nosoflow.operators.scaling import concat_all, cut_lineage


_PIECE = ["_block", "ligne", "_text", "_starts", "_ends", "_first"]


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Columns of the input files.
POSTCOORD_CSV = _strings("code_racine", "libelle_racine", "code_postcoord", "libelles_extensions")
TERMS_CSV = _strings("code", "texte", "type", "uri")
SYNONYMS_CSV = _strings("code", "synonyme", "source")
AXES_CSV = _strings("code", "axe_nom", "allow_multiple", "taille_axe", "raison_arret")
ICD_MAP_CSV = _strings("icd10Code", "icd11Code")
NODE_JSON = (
    "uri string, code string, title struct<`@value`:string>, child array<string>, parent array<string>, "
    "postcoordinationScale array<struct<axisName:string,allowMultipleValues:string,scaleEntity:array<string>>>"
)


def read_csv(spark: SparkSession, path, schema: T.StructType | str, delimiter: str = ",", multiline: bool = True) -> DataFrame:
    """CSV with header, doubled quotes, and newlines inside quotes.

    Files with quoted newlines are not split: ``read_quoted_csv`` reads large ones of these, ``multiline=False`` large files known
    to have none. A byte-order mark is skipped by Spark.
    """
    return spark.read.csv(
        path, schema=schema, header=True, sep=delimiter, quote='"', escape='"', multiLine=multiline, enforceSchema=True)


def read_quoted_csv(spark: SparkSession, path, schema: T.StructType | str, delimiter: str = ",") -> DataFrame:
    """What ``read_csv`` reads, with its order as column ``ord``, but split over tasks although quotes may hold newlines.

    A line starts a record if the quotes before it in its file are even in number. Quotes are summed per file block, whose size the reader bounds, and the
    parities of the blocks along the file; this table of one row per block is broadcast. Then the lines of each block are put together where they
    are read, and only parts of records that cross the border of a block are shuffled. As in
    the other reader the first record of a file is its header and empty lines are skipped. Quotes stand around values only, doubled inside; a file whose last quote is not
    closed ends in one long record. A line break of two characters inside quotes reads as one, as there.
    """
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lines = read_lines(spark, path, "\n").select(
        "brut", F.col("ord.fichier").alias("fichier"), F.col("ord.debut").alias("debut"), F.col("ord.ligne").alias("ligne"))
    quotes = F.length("brut") - F.length(F.replace("brut", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("fichier", "debut").agg(F.sum(quotes).alias("_sum"))
    earlier = Window.partitionBy("fichier").orderBy("debut").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.pmod(F.coalesce(F.sum("_sum").over(earlier), F.lit(0)), F.lit(2))
    blocks = blocks.select("fichier", "debut", opened.cast("int").alias("_opened"))
    blocks = F.broadcast(cut_lineage(blocks.withColumn("_block", F.monotonically_increasing_id())))

    # a block that was not counted would lose its lines, so it is an error
    block = F.coalesce("_block", F.raise_error(F.lit("files changed while they were read")).cast("bigint"))
    placed = lines.join(blocks, ["fichier", "debut"], "left").select(block.alias("_block"), "_opened", "ligne", "brut")
    pieces = placed.mapInArrow(_pieces_of_blocks, "_block bigint, ligne bigint, _text string, _starts boolean, _ends boolean, _first boolean").join(blocks, "_block")
    pieces = pieces.withColumn("_header", F.col("_first") & (F.col("debut") == 0))
    one = pieces.where("_starts AND _ends").select("fichier", "debut", "ligne", "_text", "_header")
    until = Window.partitionBy("fichier").orderBy("debut", "ligne").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = pieces.where("NOT (_starts AND _ends)").withColumn("_record", F.sum(F.col("_starts").cast("int")).over(until))
    several = parts.groupBy("fichier", "_record").agg(
        F.min(F.struct("debut", "ligne")).alias("_at"), F.max("_header").alias("_header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("debut", "ligne", "_text"))), lambda x: x["_text"]), "\n").alias("_text"))
    records = one.unionByName(several.select("fichier", "_at.debut", "_at.ligne", "_text", "_header"))
    records = records.where("NOT _header")
    records = records.withColumn("_text", F.regexp_replace(F.replace("_text", F.lit("\r\n"), F.lit("\n")), "\r$", "")).where("_text <> ''")
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true"}
    order = F.struct("fichier", "debut", "ligne").alias("ord")
    return records.select(F.from_csv("_text", schema.simpleString()[7:-1].replace(":", " "), options).alias("_row"), order).select("_row.*", "ord")


def _pieces_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of file blocks, in order, put together: a row per record, or per part of one that goes on beyond its block.

    ``_starts`` and ``_ends`` tell whether the first and the last line of the record are in the row, ``_first`` whether it is the first row of its block. Only the lines of one unfinished record are kept between batches.
    """
    block, quotes, first, held, fresh = None, 0, None, [], True  # of the record that is not finished: its first line and its texts

    def row(ends: bool) -> pa.RecordBatch:
        number, starts = first
        return pa.record_batch([pa.array([block], pa.int64()), pa.array([number], pa.int64()), pa.array(["\n".join(held)], pa.string()),
                                pa.array([starts]), pa.array([ends]), pa.array([fresh])], names=_PIECE)

    for batch in batches:
        found = batch.column("_block").to_numpy()
        edges = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            part = batch.slice(low, high - low)
            if part.column("_block")[0].as_py() != block:
                if held:
                    yield row(quotes % 2 == 0)
                block, quotes, first, held, fresh = part.column("_block")[0].as_py(), part.column("_opened")[0].as_py(), None, [], True
            texts, numbers = part.column("brut"), part.column("ligne").to_numpy()
            after = quotes + np.cumsum(pc.count_substring(texts, '"').to_numpy(zero_copy_only=False), dtype=np.int64)
            before = np.concatenate(([quotes], after[:-1]))
            starts = np.flatnonzero(before % 2 == 0)
            quotes = int(after[-1])
            head = int(starts[0]) if len(starts) else len(texts)
            if head and not held:
                first = (int(numbers[0]), False)
            held += texts.slice(0, head).to_pylist()
            if not len(starts):
                continue
            if held:
                yield row(True)
                fresh = False
            whole = texts.slice(head, int(starts[-1]) - head)
            offsets = pa.array(starts - head, pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, whole), "\n")
            yes, firsts = pa.array(np.ones(len(joined), bool)), np.zeros(len(joined), bool)
            firsts[:1], fresh = fresh, fresh and not len(joined)
            yield pa.record_batch([pa.array(np.full(len(joined), block)), pa.array(numbers[starts[:-1]]), joined.cast(pa.string()), yes, yes, pa.array(firsts)], names=_PIECE)
            first, held = (int(numbers[starts[-1]]), True), texts.slice(int(starts[-1])).to_pylist()
    if held:
        yield row(quotes % 2 == 0)


def with_file_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Add an order that follows the files: file name, offset of the block in the file, row in the block.

    Rows of one partition are in file order, and partitions of a file start at
    increasing offsets, so the struct sorts as the rows were written.
    """
    return df.withColumn(
        name,
        F.struct(
            F.col("_metadata.file_path").alias("fichier"),
            F.col("_metadata.file_block_start").alias("debut"),
            F.monotonically_increasing_id().alias("ligne")))


def read_lines(spark: SparkSession, path, separator: str | None = None) -> DataFrame:
    """Text lines with their order: columns ``brut`` and ``ord``. Without a ``separator``, any line break ends a line."""
    return with_file_order(spark.read.text(path, lineSep=separator).withColumnRenamed("value", "brut"))


def number_lines(lines: DataFrame, start: int = 0) -> DataFrame:
    """Exact consecutive line number ``num`` over all files, from ``start``.

    Lines are numbered per file block, whose size the reader bounds, and blocks are summed.
    """
    keyed = lines.select("brut", F.col("ord.fichier").alias("fichier"), F.col("ord.debut").alias("debut"),
                         F.col("ord.ligne").alias("ligne"))
    blocks = keyed.groupBy("fichier", "debut").agg(F.min("ligne").alias("_first"), F.count(F.lit(1)).alias("_n"))
    files = blocks.groupBy("fichier").agg(F.sum("_n").alias("_file_n"))
    earlier_files = Window.orderBy("fichier").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("fichier", F.coalesce(F.sum("_file_n").over(earlier_files), F.lit(0)).alias("_before_file"))
    earlier_blocks = Window.partitionBy("fichier").orderBy("debut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.join(files, "fichier").select(
        "fichier", "debut", "_first",
        (F.col("_before_file") + F.coalesce(F.sum("_n").over(earlier_blocks), F.lit(0))).alias("_before"))
    return keyed.join(offsets, ["fichier", "debut"]).select(
        (F.col("_before") + F.col("ligne") - F.col("_first") + start).alias("num"), "brut")


def read_parquet(spark: SparkSession, path, names: Mapping[str, str] | None = None) -> DataFrame:
    return spark.read.parquet(path).withColumnsRenamed(dict(names or {}))


def union_parts(parts: Mapping[str, DataFrame], columns: Sequence[str], tag: str = "source") -> DataFrame:
    """Stack aligned parts, each tagged with its name and its position among the parts."""
    return concat_all([
        part.select(*columns).withColumns({tag: F.lit(name), "_part": F.lit(i)}) for i, (name, part) in enumerate(parts.items())])


def read_table(
    spark: SparkSession, url: str, table: str, partition_column: str | None = None,
    bounds: tuple[int, int] | None = None, partitions: int = 1, properties: Mapping[str, str] | None = None
) -> DataFrame:
    """Database table by URL; a numeric partition column reads it in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**dict(properties or {}))
    if partition_column and bounds:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0])
                  .option("upperBound", bounds[1]).option("numPartitions", partitions))
    return reader.load()


def read_pages(spark: SparkSession, path) -> DataFrame:
    """Stored pages, one row per file: ``page``, ``html``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("page"), F.col("value").alias("html"))


def read_nodes(spark: SparkSession, path) -> DataFrame:
    """Terminology nodes, one JSON object per line."""
    return spark.read.schema(NODE_JSON).json(path)


def node_edges(nodes: DataFrame) -> DataFrame:
    """``parent``, ``child`` of node documents, links in one spelling."""
    return nodes.select(https(F.col("uri")).alias("parent"), F.explode("child").alias("child")).select(
        "parent", https(F.col("child")).alias("child"))


def first_parents(nodes: DataFrame) -> DataFrame:
    """``child``, ``parent``: the first parent of each node that has one."""
    return nodes.where(F.size("parent") > 0).select(
        https(F.col("uri")).alias("child"), https(F.col("parent")[0]).alias("parent"))


def ranked_children(nodes: DataFrame, root: str) -> DataFrame:
    """``id``, ``pos`` (from one): children of one node in the order of its document."""
    node = nodes.where(https(F.col("uri")) == F.lit(root).cast("string"))
    return node.select(F.posexplode("child").alias("_p", "child")).select(
        https(F.col("child")).alias("id"), (F.col("_p") + 1).cast("bigint").alias("pos"))
