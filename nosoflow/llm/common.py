"""Shared folders, ordered partitions, words and hashes of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nosoflow.operators.scaling import shared_folder

LOWEST = -(1 << 63)
_WORD = re.compile(r"\w+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one. It is removed when the driver ends; until then results may read it."""
    base = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            path = jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the session has ended
            pass

    atexit.register(remove)
    return f"{base}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and no lost executor takes it along."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty), so no other column of ``docs`` can clash."""
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))


def id_crc(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a table's size; 4 KB a row where it has none, as for a table that is not read from files."""
    estimate, rows = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), df.count()
    return estimate if estimate <= rows << 20 else rows << 12


def range_bounds(df: DataFrame, key: str, part_bytes: int) -> list[int]:
    """Lower bounds of the second and later key ranges, about ``part_bytes`` of input each, two for each core at least.

    Counts the rows and reads the key column only. The driver gets one number per range.
    """
    parts = min(200_000, max(-(-estimated_bytes(df) // part_bytes), 2 * df.sparkSession.sparkContext.defaultParallelism))
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 10 * parts)).alias("b")).first().b
    return sorted(set(found or []))


def part_of(bounds: list[int]) -> Callable[[Column], Column]:
    """Number of the key range of an integer column; null counts as the lowest key."""
    edges = np.array(bounds, dtype=np.int64)

    @F.arrow_udf(T.IntegerType())
    def part(keys: pa.Array) -> pa.Array:
        values = keys.fill_null(LOWEST).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, values, side="right").astype(np.int32))

    return part


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what is made from long texts stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def words(text: str) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


class WordHashes(dict):
    """64-bit hash of a word, remembered. It is emptied when it holds ``limit`` words, which bounds a worker's memory."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, text: str) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


#: Of this Python worker, whatever the operator and the task.
HASHES = WordHashes()
_REMEMBERED: list = []
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def remember(cache) -> None:
    """From now on ``cache`` is emptied by ``make_room``."""
    _REMEMBERED.append(cache)


def make_room() -> None:
    """Empties what other operators remember in this Python worker, and gives freed memory back to the machine.

    An operator calls it before it fills a cache of its own, as workers are used again from task to task.
    """
    for cache in _REMEMBERED:
        cache.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


remember(HASHES)


def word_hashes(text: str) -> np.ndarray:
    return HASHES.of(text)


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """UTF-8 words between runs of space and ``\\t\\n\\v\\f\\r``, and of no other blank; ``lower`` changes A to Z only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


class ByteHashes(WordHashes):
    """64-bit hash of a word's bytes, remembered as ``WordHashes`` does."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


BYTE_HASHES = ByteHashes()
remember(BYTE_HASHES)


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(word_hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each run of ``size`` words, in order. A shorter text is one shingle; one without words has none."""
    if not len(word_hashes):
        return word_hashes
    size = min(size, len(word_hashes))
    count = len(word_hashes) - size + 1
    total = np.zeros(count, np.uint64)
    for i in range(size):
        total = (total + word_hashes[i:i + count]) * _GOLD
        total ^= total >> np.uint64(29)
    return mixed(total + np.uint64(size))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
