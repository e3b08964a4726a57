"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each rotated by its distance to
the end, so order counts. A text's vector bundles (adds) the vectors of its n-grams; a language's prototype adds the direction vectors of
its training texts. A text gets the language whose prototype has the largest cosine with its vector.

What counts as a language at all depends on the length of a text, as long texts come closer to their prototype. ``floors`` learns, for each language and
length, a bound between the cosines of its own texts and those that texts of random letters reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nosoflow.llm.common import id_crc, make_room, pieces_of, remember

DIMENSIONS = 1024
GRAM = 3
#: Prototypes are held by every task, so at most these languages are learned, those with the most texts to learn from.
MAX_LANGUAGES = 512
#: Number of texts of random letters of each length that bounds of scores come from.
NOISE_TEXTS = 64
#: Scores further below their mean than so many standard deviations are those of stray texts.
DEVIATIONS = 3
#: Lengths of texts are told apart by powers of two up to 2^LONGEST characters, longer ones as these.
LONGEST = 13
UNKNOWN = "und"
_SYMBOLS = 1024
_SEED = 20_11


@cache
def _symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for no letter, else a number below _SYMBOLS; lower and upper case alike."""
    table = np.zeros(0x110000, np.int16)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = ord(char.lower()[0])
            table[code] = low if 0 < low < 768 else 768 + low % 256
    return table


@cache
def _rotated_letters(dimensions: int, gram: int, seed: int) -> list[np.ndarray]:
    """The letters' vectors, rotated by gram - 1, ..., 1, 0 places."""
    letters = np.random.default_rng(seed).integers(0, 2, (_SYMBOLS, dimensions), np.int8) * np.int8(2) - np.int8(1)
    return [np.roll(letters, gram - 1 - i, axis=1) for i in range(gram)]


class Bundler:
    """Vectors of texts. Vectors of n-grams met before are kept, at most ``limit`` of them."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = _SEED, limit: int = 16_384):
        self.letters = _rotated_letters(dimensions, gram, seed)
        self.dimensions, self.gram, self.limit = dimensions, gram, limit
        self.codes = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, dimensions), np.int8)

    def _bind(self, codes: np.ndarray) -> np.ndarray:
        bound = np.ones((len(codes), self.dimensions), np.int8)
        for i, letters in enumerate(self.letters):
            bound *= letters[(codes >> (10 * (self.gram - 1 - i))) % _SYMBOLS]
        return bound

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of distinct sorted codes."""
        if len(codes) > self.limit:
            return self._bind(codes)
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        missing = codes[self.codes[at] != codes] if len(self.codes) else codes
        if len(missing):
            if len(self.codes) + len(missing) > self.limit:
                self.codes, self.vectors, missing = self.codes[:0], self.vectors[:0], codes
            merged = np.concatenate((self.codes, missing))
            order = np.argsort(merged, kind="stable")
            self.codes, self.vectors = merged[order], np.concatenate((self.vectors, self._bind(missing)))[order]
            at = np.searchsorted(self.codes, codes)
        return self.vectors[at]

    def vector(self, text: str) -> np.ndarray | None:
        """Bundle of all n-grams of the text, word ends included; None without a letter."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = _symbol_table()[points]
        if not symbols.any():
            return None
        blank = symbols == 0
        symbols = symbols[~(blank & np.concatenate(([True], blank[:-1])))]  # one gap between words, none at the start
        symbols = np.concatenate((np.zeros(1, np.int32), symbols, np.zeros(self.gram - 1, np.int32))).astype(np.int32)
        count = len(symbols) - self.gram + 1
        codes = np.zeros(count, np.int32)
        for i in range(self.gram):
            codes = (codes << 10) | symbols[i:i + count]
        codes, counts = np.unique(codes, return_counts=True)
        total = np.zeros(self.dimensions, np.float32)
        for start in range(0, len(codes), 8192):
            total += counts[start:start + 8192].astype(np.float32) @ self._rows(codes[start:start + 8192]).astype(np.float32)
        return total


_BUNDLERS: dict[int, Bundler] = {}
remember(_BUNDLERS)


def _bundler(dimensions: int) -> Bundler:
    if dimensions not in _BUNDLERS:
        make_room()
        _BUNDLERS[dimensions] = Bundler(dimensions)
    return _BUNDLERS[dimensions]


def training_rows(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", fit_rows: int | None = None) -> DataFrame:
    """Texts to learn from: crc32 of the id not divisible by 5, a language given. All of them, or, if ``fit_rows`` is given, of a language with
    more texts about as many, drawn by a hash of the id. Of more than ``MAX_LANGUAGES`` values of ``lang`` the most frequent are languages, ties in
    alphabetical order; no text is learned from or recognised as any other."""
    rows = docs.where((id_crc(docs[doc_id], 5) != 0) & docs[lang].isNotNull()).select(
        docs[doc_id].alias("doc_id"), docs["text"].alias("text"), docs[lang].cast("string").alias("lang"))
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    counts = {r.lang: r["count"] for r in found[:MAX_LANGUAGES]}
    if len(found) > MAX_LANGUAGES:
        rows = rows.where(F.col("lang").isin(list(counts)))
    limits = {lang: int((1 << 30) * fit_rows / n) for lang, n in counts.items() if n > fit_rows} if fit_rows else {}
    if not limits:
        return rows
    limit = F.coalesce(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("lang")], F.lit(1 << 30))
    return rows.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < limit)


def fit(rows: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit rows), from rows of text and lang.

    Each task adds up its own texts; only one vector per task and language is shuffled, and one per language reaches the driver. More than ``MAX_LANGUAGES``
    languages in ``rows`` are an error; ``training_rows`` gives no more.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = _bundler(dimensions), {}
        for batch in pieces_of(batches, 1024):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                vector = None if text is None else bundler.vector(text)
                if vector is not None:
                    sums.setdefault(lang, np.zeros(dimensions))
                    sums[lang] += vector / (np.linalg.norm(vector) or 1.0)
        for lang, vector in sums.items():
            yield pa.record_batch([pa.array([lang]), pa.array([vector.tolist()])], names=["lang", "vector"])

    parts = rows.select("text", "lang").mapInArrow(add, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    profiles = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("vector"))
    found = profiles.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found.sort(key=lambda r: r.lang)
    matrix = np.array([[x.v for x in r.vector] for r in found]).reshape(len(found), dimensions)
    return [r.lang for r in found], matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def _answers(model: tuple[list[str], np.ndarray], texts_: pa.Array) -> Iterator[tuple[str | None, str, float]]:
    """Each text, its language and score. ``model`` has prototypes of 32 bits."""
    languages, prototypes = model
    bundler = _bundler(prototypes.shape[1] if len(languages) else DIMENSIONS)
    for value in texts_:
        text = value.as_py()
        vector = None if text is None or not languages else bundler.vector(text)
        length = 0.0 if vector is None else float(np.linalg.norm(vector))
        if not length:
            yield text, UNKNOWN, 0.0
            continue
        cosines = prototypes @ vector / length
        best = int(np.argmax(cosines))  # of equal cosines the first language in alphabetical order
        yield text, languages[best], min(1.0, max(0.0, float(cosines[best])))


def predictor(model: tuple[list[str], np.ndarray]):
    """Column function: text to struct(lang_pred, score)."""
    model = model[0], model[1].astype(np.float32)

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts_: pa.Array) -> pa.Array:
        names, scores = [], []
        for _, name, score in _answers(model, texts_):
            names.append(name)
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Null or letterless texts get ``und`` and score 0, as does every text if nothing could be learned. Rows without an id are held out. Repeated rows
    get equal answers; equal cosines give the first language in alphabetical order. Only doc_id, text and, to learn from, lang are read.
    """
    model = model or fit(training_rows(docs))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    answer = rows.withColumn("answer", predictor(model)("text"))
    held = F.coalesce(id_crc(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out")
    return answer.select("doc_id", held, "answer.lang_pred", "answer.score")


def _length_class(text: str) -> int:
    return min(len(text).bit_length(), LONGEST)


def _random_letters(length: int, number: int) -> str:
    """Words of random Latin letters; the same ones for the same numbers."""
    rng = np.random.default_rng((length, number))
    letters = rng.integers(97, 123, length).astype(np.uint32)
    letters[rng.random(length) < 0.15] = 32
    return letters.tobytes().decode("utf-32-le")


def _own_scores(model: tuple[list[str], np.ndarray], rows: DataFrame) -> DataFrame:
    """lang, kind (class of lengths), score of each row, null where another language is recognised. A filter on the answer would score
    every text twice, in two Python workers of a task."""
    kind = F.least(F.length(F.bin(F.length("text"))), F.lit(LONGEST)).alias("kind")
    scored = rows.select("lang", kind, predictor(model)("text").alias("answer"))
    return scored.select("lang", "kind", F.when(F.col("answer.lang_pred") == F.col("lang"), F.col("answer.score")).alias("score"))


def floors(model: tuple[list[str], np.ndarray], rows: DataFrame) -> np.ndarray:
    """Least score of each language (rows of the result) for each class of lengths, from ``rows`` of doc_id, text and lang.

    It lies a quarter of the way from the highest score of ``NOISE_TEXTS`` random texts of that length to the lowest of the language's own
    texts that are recognised, but strays: the lowest of very many texts is one, so what lies more than ``DEVIATIONS`` standard deviations below the mean
    does not count. Where these overlap, as for short texts, it is the lowest of all, so no such text learned from is rejected. A length without own texts
    has the bound of the random ones. Every row is scored; two numbers for each language and length reach the driver.
    """
    languages, prototypes = model
    if not languages:
        return np.zeros((0, LONGEST + 1))
    low = F.greatest(F.min("score"), F.avg("score") - DEVIATIONS * F.stddev_pop("score"))
    found = _own_scores(model, rows).groupBy("lang", "kind").agg(F.min("score").alias("least"), low.alias("low")).where("least IS NOT NULL").collect()
    own = {(r.lang, r.kind): (r.least, r.low) for r in found}
    bundler, out = _bundler(prototypes.shape[1]), np.zeros((len(languages), LONGEST + 1))
    for kind in range(1, LONGEST + 1):
        vectors = [bundler.vector(_random_letters(3 << kind >> 2, i)) for i in range(NOISE_TEXTS)]
        noise = np.max([prototypes @ v / (np.linalg.norm(v) or 1.0) for v in vectors if v is not None] or [np.zeros(len(languages))], axis=0)
        for i, lang in enumerate(languages):
            least, low = own.get((lang, kind), (noise[i], noise[i]))
            out[i, kind] = noise[i] + (low - noise[i]) / 4 if low > noise[i] else min(least, noise[i])
    return out


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], bounds: np.ndarray | None = None) -> DataFrame:
    """``docs`` without the rows whose language is unknown or whose score is below that of its language and length. All columns stay.

    ``bounds`` are those of ``floors``, by default learned from the training rows of ``docs``. Texts of random letters, encoded data and languages that were not
    learned go once they are long enough to tell, from some forty characters on; short texts stay, as their scores tell little.
    """
    bounds = floors(model, training_rows(docs)) if bounds is None else bounds
    places = {lang: i for i, lang in enumerate(model[0]) if lang != UNKNOWN}
    model = model[0], model[1].astype(np.float32)

    @F.arrow_udf(T.BooleanType())
    def identified(texts_: pa.Array) -> pa.Array:
        return pa.array([lang in places and bool(score >= bounds[places[lang], _length_class(text)]) for text, lang, score in _answers(model, texts_)], pa.bool_())

    return docs.where(identified(docs["text"]))
