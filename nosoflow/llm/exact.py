"""Exact duplicates by recipes of content-defined chunks, in DataFrame operations only.

A text without white space is cut where its content says so: after at least ``SHORTEST`` characters at the next anchor, a run of four characters
of given classes, at ``LONGEST`` characters at the latest. A text's recipe is the ordered list of its chunks' identifiers. Chunk
bytes are shuffled once, each distinct chunk of a task once, to verify that an identifier stands for one chunk; documents are
then compared by their recipes alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nosoflow.llm.common import stored, texts

SHORTEST, LONGEST = 128, 8192
HIGHEST = (1 << 63) - 1
STEP = 10**20  # over all differences of two ids
BLANKS = " \t\n\x0b\x0c\r"


def _classes(characters: Iterable[int], shown: Callable[[int], str]) -> str:
    """Regular expression of an anchor: four classes, of which each holds a quarter of the given units of text."""
    kinds = ["", "", "", ""]
    for unit in characters:
        kinds[(unit * 0x9E37 >> 8) % 4] += shown(unit)
    return "".join(f"[{k}]" for k in kinds)


def _chunk(anchor: str) -> str:
    return f"(?s).{{{SHORTEST},{LONGEST}}}?{anchor}|.{{1,{LONGEST}}}"


#: Letters and digits below U+0100, which a regular expression tests by one table; of other scripts, which take longer, blocks of 256 characters.
CHUNK = _chunk(_classes((c for c in range(0x30, 0x100) if chr(c).isalnum()), chr))
WIDE_CHUNK = _chunk(_classes((b for b in range(0x03, 0x100) if not 0xD8 <= b < 0xE0), lambda b: f"\\u{b:02x}00-\\u{b:02x}ff"))
#: A text with a letter of another script is cut by WIDE_CHUNK.
OTHER_SCRIPT = "[\\u0250-\\u1fff\\u2c00-\\ud7ff\\uf900-\\uffef]"


def normalised(text: Column) -> Column:
    """The text without white space of the ASCII range."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def chunks(text: Column) -> Column:
    wide = F.regexp_extract_all(text, F.lit(WIDE_CHUNK), F.lit(0))
    return F.when(text.rlike(OTHER_SCRIPT), wide).otherwise(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the original), n_chars (its code points), recipe (chunk identifiers in order), text_sha256 (normalised)."""
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").cast("bigint").alias("n_chars"), normalised(F.col("text")).alias("text"))
    return rows.select(
        "doc_id", "text_hash", "n_chars", F.transform(chunks(F.col("text")), lambda c: F.xxhash64(c)).alias("recipe"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def ambiguous(docs: DataFrame) -> DataFrame:
    """Identifiers that stand for several different chunks. Copies are dropped on the map side, so a frequent chunk costs no more than others."""
    parts = texts(docs).select(F.explode(chunks(normalised(F.col("text")))).alias("chunk")).select(F.xxhash64("chunk").alias("id"), "chunk")
    return parts.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")


def _verified(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Recipes, with a digest of the text added to those that hold an ambiguous identifier: equal lists are then equal texts."""
    unsure = stored(ambiguous(docs), "ambiguous")
    if unsure.isEmpty():
        return rows
    touched = rows.select("doc_id", "text_hash", F.explode("recipe").alias("id")).join(unsure, "id", "left_semi").select("doc_id", "text_hash").distinct()
    same = rows["doc_id"].eqNullSafe(touched["doc_id"]) & (rows["text_hash"] == touched["text_hash"])
    marked = rows.join(touched.withColumn("unsure", F.lit(True)), same, "left").select(rows["*"], "unsure")
    digest = F.when(F.col("unsure"), F.array(F.xxhash64("text_sha256"), F.xxhash64(F.reverse("text_sha256")))).otherwise(F.array().cast("array<bigint>"))
    return marked.withColumn("recipe", F.concat("recipe", digest)).drop("unsure")


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after white space of the ASCII range is deleted; null is the empty text. Of equal texts the row
    with the most code points stays, then the one with the smallest id, a null id last. Every row counts and appears, repeated ones too: rows that
    repeat both id and text are kept or dropped alike. An empty table gives an empty result.
    """
    rows = stored(recipes(docs), "recipes")
    rows = _verified(rows, docs).withColumn("recipe_hash", F.xxhash64("recipe"))
    # Order as one number, so that it is combined on the map side: length first, then small ids, a null id last.
    rows = rows.withColumn("order", F.expr(
        f"cast(cast(n_chars as decimal(12,0)) * {STEP}BD + ({HIGHEST}BD - cast(coalesce(doc_id, {HIGHEST}) as decimal(20,0))) as decimal(38,0))"))
    best = rows.groupBy("recipe_hash", "recipe").agg(F.max("order").alias("best"), F.count(F.lit(1)).alias("group_size"))
    found = rows.join(best, ["recipe_hash", "recipe"])
    keep = F.expr(f"cast({HIGHEST}BD - best % {STEP}BD as bigint)")
    kept = F.col("order") == F.col("best")
    return found.select(
        "doc_id", "text_hash", F.when(kept, F.col("doc_id")).otherwise(keep).alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that equal another one that stays. All columns stay; a repeated row stays once."""
    own = "_".join(["key", *docs.columns])
    keys = [f"{own}_id", f"{own}_null", f"{own}_hash"]  # those of the join and of the last step alike, so texts are shuffled and sorted once

    def keyed(rows: DataFrame, text_hash: Column) -> DataFrame:
        doc_id = rows["doc_id"].cast("bigint")
        return rows.withColumns(dict(zip(keys, (F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), text_hash))))

    kept = keyed(duplicates(docs).where("kept"), F.col("text_hash")).select(*keys)
    rows = keyed(docs, F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
