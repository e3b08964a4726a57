"""Token ids as Arrow stream files: equal-length sequences with masks, in ascending id order.

A file holds two Arrow streams, one after the other. The first has record batches of fixed-size lists: ``ids`` (the token
ids), ``valid`` (false for the padding after a file's last document) and ``last`` (true on the end token of a document, as an
ordinary token may have the same id). Its batches all have the same length in bytes, but for the last one, so sequence ``i`` is found by
arithmetic and read from a memory map without a copy. The second stream lists the documents of the file in order.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nosoflow.llm.common import make_room, part_of, pieces_of, range_bounds, remember, texts

SEQUENCE = 2048
SEQUENCES_A_BATCH = 64
PART_BYTES = 16 << 20
#: The pattern by which byte-level BPE cuts a text before it merges, for the characters that _UNUSUAL leaves. Of these, letters are:
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
SPLIT = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Texts with other characters than these go to the tokenizer whole: regular expression libraries may class them differently.
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e]")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level BPE writes a printable byte as its own character, the others as the characters from 256 on.
_BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


def _filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    uri = re.sub(r"^file:/(?!/)", "file:///", folder)
    if "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def cut_by_split(path: str) -> bool:
    """Whether a tokenizer's file says that a text is cut as SPLIT does, without any change before, and that its pieces are merged as bytes."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    cut, model = parts.get("pre_tokenizer") or {}, parts["model"]
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "byte_fallback"))
    same = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return bool(same and plain and model.get("type") == "BPE" and not parts.get("normalizer"))


class Encoder:
    """Ids of a text, identical to those of the tokenizer for the whole text.

    Where the file cuts texts as SPLIT does (``cut_by_split``), merges never cross these pieces, so the tokenizer's model is asked once for each piece; at most
    ``limit`` pieces are remembered. Any other tokenizer, and texts that hold one of its added tokens, are encoded whole. The string of a special
    token in a text is that token, as by the library's default, or with ``special_as_text`` ordinary text.
    """

    def __init__(self, path: str, limit: int = 400_000, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.whole = re.compile("|".join([_UNUSUAL.pattern, *map(re.escape, added)]) if cut_by_split(path) else "")
        self.model = self.tokenizer.model.tokenize
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = np.dtype(self.dtype).char
        self.limit, self.known, self.counts = limit, {}, {}

    def _piece(self, piece: str) -> bytes:
        chars = piece.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array(self.code, [t.id for t in self.model(chars)]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if self.whole.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        if len(self.known) >= self.limit:
            self.known.clear()
        pieces = SPLIT.findall(text)
        ids = list(map(self.known.get, pieces))
        if None in ids:
            for i, piece in enumerate(pieces):
                if ids[i] is None:
                    ids[i] = self.known.get(piece) or self.known.setdefault(piece, self._piece(piece))
        return np.frombuffer(b"".join(ids), self.dtype)

    def count(self, text: str) -> int:
        """Number of the ids of a text. Pieces are remembered apart, with their number of ids alone."""
        if self.whole.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.counts) >= self.limit:
            self.counts.clear()
        pieces = SPLIT.findall(text)
        counts = list(map(self.counts.get, pieces))
        if None in counts:
            for i, piece in enumerate(pieces):
                if counts[i] is None:
                    counts[i] = self.counts[piece] = len(self._piece(piece)) // np.dtype(self.dtype).itemsize
        return sum(counts)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}
remember(_ENCODERS)


def encoder_of(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        make_room()
        _ENCODERS[key] = Encoder(path, special_as_text=special_as_text)
    return _ENCODERS[key]


def counter(path: str, special_as_text: bool = False):
    """Column function: text to its number of ids and one end id; a null text has the end id alone."""

    @F.arrow_udf(T.LongType())
    def count(texts_: pa.Array) -> pa.Array:
        encoder = encoder_of(path, special_as_text)
        return pa.array([encoder.count(t.as_py() or "") + 1 for t in texts_], pa.int64())

    return count


class _Sequences:
    """Fills equal-length sequences and writes them in equal batches."""

    def __init__(self, sink, dtype, length: int, rows: int):
        self.length, self.rows, self.dtype = length, rows, dtype
        kinds = (("ids", pa.from_numpy_dtype(dtype)), ("valid", pa.bool_()), ("last", pa.bool_()))
        self.schema = pa.schema([(n, pa.list_(pa.field("item", k, nullable=False), length)) for n, k in kinds])
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.ids, self.ends = np.zeros(length * rows, dtype), np.zeros(length * rows, bool)
        self.filled = 0

    def _flush(self, count: int) -> None:
        rows = -(-count // self.length)
        size = rows * self.length
        columns = (self.ids[:size], np.arange(size) < count, self.ends[:size])
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(c), type=f.type) for c, f in zip(columns, self.schema)]
        self.writer.write_batch(pa.record_batch(arrays, schema=self.schema))
        self.ids[:], self.ends[:], self.filled = 0, False, 0

    def add(self, ids: np.ndarray) -> None:
        """A document's ids; the last one is its end token."""
        done = 0
        while done < len(ids):
            step = min(len(ids) - done, len(self.ids) - self.filled)
            self.ids[self.filled:self.filled + step] = ids[done:done + step]
            self.filled, done = self.filled + step, done + step
            if done == len(ids):
                self.ends[self.filled - 1] = True
            if self.filled == len(self.ids):
                self._flush(self.filled)

    def close(self) -> None:
        if self.filled:
            self._flush(self.filled)
        self.writer.close()


_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, sequence: int = SEQUENCE, part_bytes: int = PART_BYTES,
    special_as_text: bool = False,
) -> list[tuple[str, int, int]]:
    """Encode every whole text, append ``end_id`` to each document, write files in ascending ``doc_id`` order.

    Returns the manifest, one (file, documents, tokens) per file in order. Documents are dealt to ranges of ids, one file each, by one
    shuffle; a task writes under a name of its own and renames at the end, so a repeated task replaces its file with the same bytes.
    A null text is empty, a null id comes first, rows with the same id follow each other by text, and every
    row is written: none is merged. An empty table gives no file. ``folder`` must be one that all executors reach.
    """
    source = texts(docs)
    bounds = range_bounds(source, "doc_id", part_bytes)
    dealt = source.withColumn("part", part_of(bounds)("doc_id")).repartitionById(len(bounds) + 1, "part")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        encoder = sequences = None
        documents: list[tuple[int | None, int]] = []
        for batch in pieces_of(batches, 1024):
            for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part"))):
                if sequences is None:
                    encoder = encoder_of(tokenizer_path, special_as_text)
                    store.create_dir(base, recursive=True)
                    name = f"ids-{part:06d}.arrows"
                    own = f"{base}/.{name}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(own)
                    sequences = _Sequences(sink, encoder.dtype, sequence, SEQUENCES_A_BATCH)
                ids = np.append(encoder.encode(text), encoder.dtype(end_id))
                documents.append((doc_id, len(ids)))
                sequences.add(ids)
        if sequences is None:
            return
        sequences.close()
        columns = [pa.array(c, pa.int64()) for c in zip(*documents)]
        with pa.ipc.new_stream(sink, _DOCUMENTS) as writer:
            writer.write_batch(pa.record_batch(columns, schema=_DOCUMENTS))
        sink.close()
        try:
            store.move(own, f"{base}/{name}")
        except OSError:  # some stores don't replace: an earlier attempt of this task has left the same file
            if store.get_file_info(f"{base}/{name}").type != pyarrow.fs.FileType.File:
                raise
            store.delete_file(own)
        total = sum(n for _, n in documents)
        yield pa.record_batch([pa.array([x]) for x in (name, len(documents), total)], names=["file", "n_docs", "n_tokens"])

    written = dealt.sortWithinPartitions("doc_id", "text").mapInArrow(write, "file string, n_docs bigint, n_tokens bigint")
    return sorted(map(tuple, written.collect()))


def _file_rows(source: pa.NativeFile) -> Iterator[tuple[int | None, int, int]]:
    """Id, number of ids and their crc32 (as little-endian 32-bit numbers) of a file's documents. One batch of sequences is held at a time."""
    lengths, sums, length, crc = [], [], 0, 0
    for batch in pa.ipc.open_stream(source):
        flat = {f: batch.column(f).flatten() for f in batch.schema.names}
        count = flat["valid"].true_count
        ids = flat["ids"].to_numpy()[:count].astype("<u4")
        start = 0
        for end in (np.flatnonzero(flat["last"].to_numpy(zero_copy_only=False)) + 1).tolist():
            lengths.append(length + end - start)
            sums.append(zlib.crc32(ids[start:end], crc))
            start, length, crc = end, 0, 0
        length, crc = length + count - start, zlib.crc32(ids[start:], crc)
    ids = pa.ipc.open_stream(source).read_all().column("doc_id").to_pylist()
    assert len(ids) == len(lengths) and not length, "a file that was cut off"
    yield from zip(ids, lengths, sums)


def read_token_files(spark: SparkSession, folder: str, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, file.

    ``start`` counts the ids of all documents before it, end tokens included. Each file is streamed by one task.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string"
    if not manifest:
        return spark.createDataFrame([], schema)
    files, total = [], 0
    for name, _, tokens in manifest:
        files.append((name, total))
        total += tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "file"]
        for batch in batches:
            for name, at in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist()):
                rows = []
                with store.open_input_stream(f"{base}/{name}") as source:
                    for doc_id, count, crc in _file_rows(source):
                        rows.append((doc_id, at, count, crc, name))
                        at += count
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    listed = spark.createDataFrame(files, "file string, at bigint").repartition(min(len(files), 10_000))
    return listed.mapInArrow(read, schema)


class SequenceFile:
    """Random access to the sequences of one file through a memory map, without copies."""

    def __init__(self, path: str):
        self.source = pa.memory_map(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.rows = self.batches[0].num_rows if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, index: int) -> tuple[np.ndarray, pa.BooleanArray, pa.BooleanArray]:
        """Ids of a sequence, the mask of its valid tokens and that of documents' last tokens, all views of the file."""
        if not 0 <= index < len(self):
            raise IndexError(index)
        batch, row = self.batches[index // self.rows], index % self.rows
        ids, valid, last = (batch.column(c) for c in ("ids", "valid", "last"))
        length = ids.type.list_size
        views = [column.values.slice((column.offset + row) * length, length) for column in (ids, valid, last)]
        return views[0].to_numpy(), views[1], views[2]


def stream(spark: SparkSession, docs: DataFrame, folder: str, tokenizer_path: str, **options) -> DataFrame:
    """Write the files, then read every document back from them."""
    return read_token_files(spark, folder, write_token_files(docs, folder, tokenizer_path, **options))
