"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Byte-pair merges are taken from an agenda, the best score first and of equal scores the leftmost. A candidate merge is skipped for good if a hash of the seed,
the document, the place and the merged piece falls below the dropout rate, so a seed gives the same segmentation anywhere and another seed
another one. Segments of usual length are merged side by side in numpy; a very long one goes through a heap.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nosoflow.llm.common import LOWEST, mixed, pieces_of, texts

SPACE = "▁"
DROPOUT, SEED = 0.1, 17
#: Segments of up to so many symbols are merged side by side; longer ones one by one.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 40, 64)
#: Code points that are merged together; a longer text takes several turns, between segments.
BATCH_CHARS = 1 << 19
_NEVER = np.int32(0x7FFFFFFF)
_MASK = (1 << 64) - 1
_PLACE, _PIECE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Pieces:
    """The vocabulary: symbols of code points, merges of pairs and bytes of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        ordinary = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {self.text[i]: i for i in ordinary}
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        order = sorted(ordinary, key=lambda i: (-model.get_score(i), i))
        self.rank = np.full(size, _NEVER, np.int32)
        self.rank[order] = np.arange(len(order), dtype=np.int32)
        self.symbol = np.full(0x110000, -1, np.int32)
        for piece, i in self.id.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        for value, i in self.byte_id.items():  # an ASCII character without a piece is its byte, which merges with nothing
            if value < 128 and self.symbol[value] < 0:
                self.symbol[value] = i
        pairs = {}
        for piece, i in self.id.items():
            for cut in range(1, len(piece)):
                if piece[:cut] in self.id and piece[cut:] in self.id:
                    pairs[self.id[piece[:cut]] << 32 | self.id[piece[cut:]]] = i
        self.pairs = pairs
        self._slots(pairs)
        self.bytes = [b""] * size
        for piece, i in self.id.items():
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte_id.items():
            self.bytes[i] = bytes([value])

    def _slots(self, pairs: dict[int, int]) -> None:
        """A sparse hash table of pairs; pairs whose slot is taken are few and held in a sorted list."""
        keys, merged = np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32)
        bits = max(10, (16 * len(keys)).bit_length())
        self.down = np.uint64(64 - bits)
        slots = (keys * _PLACE) >> self.down
        _, first = np.unique(slots, return_index=True)
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.table, self.result = np.full(1 << bits, np.uint64(_MASK)), np.full(1 << bits, -1, np.int32)
        self.table[slots[first]], self.result[slots[first]] = keys[first], merged[first]
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[slots[rest]] = True
        self.rest, self.rest_result = np.append(keys[rest], np.uint64(_MASK)), np.append(merged[rest], np.int32(-1))

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair of symbols makes, or -1. Negative symbols make none."""
        keys = (left.astype(np.int64) << 32 | right).view(np.uint64)  # a negative symbol gives a key that no pair has
        at = (keys * _PLACE) >> self.down
        hit = self.table[at] == keys
        found = np.where(hit, self.result[at], np.int32(-1))
        again = np.flatnonzero(self.crowded[at] & ~hit)
        if len(again):
            place = np.searchsorted(self.rest[:-1], keys[again])
            found[again] = np.where(self.rest[place] == keys[again], self.rest_result[place], np.int32(-1))
        return found


class Encoder:
    """Encodes texts of documents with a dropout rate and a seed."""

    def __init__(self, pieces: Pieces, dropout: float = DROPOUT, seed: int = SEED):
        self.pieces, self.seed = pieces, seed
        self.limit = np.uint64(min(_MASK, int(dropout * 2.0**64)))
        self.certain = dropout >= 1

    def _ranks(self, left: np.ndarray, right: np.ndarray, places: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Rank of each candidate merge, _NEVER if it is none or skipped."""
        merged = self.pieces.merged(left, right)
        ranks = np.full(len(merged), _NEVER, np.int32)
        some = np.flatnonzero(merged >= 0)
        if self.certain or not len(some):
            return ranks
        if self.limit:
            draw = owners[some] + places[some].astype(np.uint64) * _PLACE + merged[some].astype(np.uint64) * _PIECE
            some = some[mixed(draw) >= self.limit]
        ranks[some] = self.pieces.rank[merged[some]]
        return ranks

    def _together(self, symbols: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a matrix of symbols (-2 beyond a row's end). Returns the rows and their lengths."""
        rows, width = symbols.shape
        lengths = (symbols != -2).sum(axis=1)
        out, columns = symbols.copy(), np.arange(width)
        places = np.broadcast_to(columns.astype(np.int16), symbols.shape).copy()
        ranks = self._ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel(), places[:, :-1].ravel(), np.repeat(owners, width - 1)).reshape(rows, width - 1)
        active = np.arange(rows)
        while len(active):
            best = ranks.argmin(axis=1)
            line = np.arange(len(active))
            going = ranks[line, best] != _NEVER
            if not going.all():
                out[active[~going]] = symbols[~going]
                active, symbols, places, ranks, best, owners = (x[going] for x in (active, symbols, places, ranks, best, owners))
                if not len(active):
                    break
                line = np.arange(len(active))
            symbols[line, best] = self.pieces.merged(symbols[line, best], symbols[line, best + 1])
            moved = columns[:-1] + (columns[:-1] > best[:, None])
            symbols[:, :-1], places[:, :-1] = np.take_along_axis(symbols, moved, 1), np.take_along_axis(places, moved, 1)
            symbols[:, -1] = -2
            ranks[:, :-1] = np.take_along_axis(ranks, moved[:, :-1], 1)
            ranks[:, -1] = _NEVER
            lengths[active] -= 1
            ranks[line, best] = _NEVER
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < width - 1))
                ranks[ok, at[ok]] = self._ranks(symbols[ok, at[ok]], symbols[ok, at[ok] + 1], places[ok, at[ok]], owners[ok])
        return out, lengths

    def agenda(self, symbols: list[int], owner: int) -> list[int]:
        """One segment by a heap of candidate merges, in n log n steps."""
        n, before, after = len(symbols), [*range(-1, len(symbols) - 1)], [*range(1, len(symbols) + 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            merged = self.pieces.pairs.get(symbols[i] << 32 | symbols[j], -1) if j < n and symbols[i] >= 0 and symbols[j] >= 0 else -1
            if merged < 0 or self.certain:
                return
            draw = (owner + i * int(_PLACE) + merged * int(_PIECE)) & _MASK
            if self.limit and int(mixed(np.array([draw], np.uint64))[0]) < int(self.limit):
                return
            heapq.heappush(heap, (int(self.pieces.rank[merged]), i, symbols[i], symbols[j], merged))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = merged, -3, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        kept, i = [], 0
        while i < n:
            kept.append(symbols[i])
            i = after[i]
        return kept

    def encode(self, text: str, doc_id: int | None) -> np.ndarray:
        """Ids of a text. A space comes before it, as the model wants; no other change is made."""
        return self.encode_all([text], [doc_id])[0]

    def encode_all(self, texts_: list[str], doc_ids: list[int | None]) -> list[np.ndarray]:
        """Ids of several texts, merged together in groups of about BATCH_CHARS code points."""
        out: list[list[np.ndarray]] = [[] for _ in texts_]
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> None:
            offsets = np.cumsum([0, *(len(points) for _, points, _, _ in held)])
            starts = np.concatenate([s + o for (_, _, s, _), o in zip(held, offsets)])
            owners = np.concatenate([o for _, _, _, o in held])
            ids, counts = self._segments(np.concatenate([p for _, p, _, _ in held]), starts, owners)
            ends = np.cumsum(counts)[np.cumsum([len(s) for _, _, s, _ in held]) - 1]
            for (number, *_), part in zip(held, np.split(ids, ends[:-1])):
                out[number].append(part)
            held.clear()

        for number, (text, doc_id) in enumerate(zip(texts_, doc_ids)):
            if not text:
                continue
            points = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32)
            spaces = points == 32
            starts = np.flatnonzero(spaces & ~np.concatenate(([False], spaces[:-1])))
            key = np.array([(self.seed * 0x9E3779B97F4A7C15 + (LOWEST if doc_id is None else doc_id)) & _MASK], np.uint64)
            owners = mixed(mixed(key) + np.arange(len(starts), dtype=np.uint64))
            first = 0
            while first < len(starts):
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + BATCH_CHARS)))
                end = int(starts[last]) if last < len(starts) else len(points)
                held.append((number, points[starts[first]:end], starts[first:last] - starts[first], owners[first:last]))
                size += end - int(starts[first])
                first = last
                if size >= BATCH_CHARS:
                    flush()
                    size = 0
        if held:
            flush()
        return [np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in out]

    def _segments(self, points: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, and how many each has."""
        symbols = self.pieces.symbol[points]
        symbols[points == 32] = self.pieces.id[SPACE]
        literal = (points == ord(SPACE)) | (symbols < 0)
        symbols[literal] = -4 - points[literal].astype(np.int32)  # written as bytes in the end
        sizes = np.diff(np.append(starts, len(points)))
        flat, lengths = symbols.copy(), sizes.copy()  # a segment's result overwrites its start
        for low, width in zip((1, *WIDTHS), WIDTHS):
            which = np.flatnonzero((sizes > low) & (sizes <= width))
            if len(which):
                at = np.minimum(starts[which, None] + np.arange(width), len(points) - 1)
                inside = np.arange(width) < sizes[which, None]
                merged, lengths[which] = self._together(np.where(inside, symbols[at], -2), owners[which])
                flat[at[inside]] = merged[inside]
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            kept = self.agenda(symbols[starts[i]:starts[i] + sizes[i]].tolist(), int(owners[i]))
            flat[starts[i]:starts[i] + len(kept)], lengths[i] = kept, len(kept)
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        ids = flat[place < np.repeat(lengths, sizes)]
        if not (ids < 0).any():
            return ids, lengths
        parts = [[i] if i >= 0 else [self.pieces.byte_id[b] for b in chr(-4 - i).encode("utf-8", "surrogatepass")] for i in ids.tolist()]
        counts = np.bincount(np.repeat(np.arange(len(starts)), lengths), [len(x) for x in parts], len(starts)).astype(np.int64)
        return np.array([x for part in parts for x in part], np.int32), counts

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.bytes.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


_PIECES: dict[str, Pieces] = {}


def pieces_at(path: str) -> Pieces:
    """One vocabulary per Python worker."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode_documents(docs: DataFrame, model_path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids. Null and empty texts have no ids; repeated rows have equal ids; a null id is a key of its own."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces_at(model_path), dropout, seed)
        for batch in pieces_of(batches):
            out = encoder.encode_all(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(encode, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """One row per row of ``encoded``: doc_id, text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces_at(model_path))
        for batch in batches:
            out = [encoder.decode(i.values.to_numpy()) if len(i) else "" for i in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(decode, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), decoded_sha256, lossless."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces_at(model_path), dropout, seed)
        for batch in pieces_of(batches):
            rows, doc_ids, sources = [], batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc_id, text, ids in zip(doc_ids, sources, encoder.encode_all(sources, doc_ids)):
                decoded = encoder.decode(ids)
                rows.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), sha256(decoded.encode()).hexdigest(), decoded == text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean"
    return texts(docs).mapInArrow(both, schema)
