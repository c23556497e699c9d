"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import held_by_worker, in_python
from .textarrays import mix, text_pieces

DIMENSIONS = 1024
SEED = 7
#: n-grams whose vectors a worker remembers.
REMEMBERED = 1 << 13
#: Bits of a code point.
POINT = 21
#: A best cosine under this is no answer for the pipeline's stage; from so many n-grams on the second one counts. Of 10,000 documents none with
#: as many scores under 0.2, while random letters and a language that wasn't learned score 0.04 to 0.08 at any length.
LEAST_SCORE, LONG_GRAMS, LEAST_LONG_SCORE = 0.05, 128, 0.15


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters; 0 stands for anything between words and is none."""
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)])


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of random +-1 for each code point, the same wherever it is asked for: bits of a hash of the point."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(SEED << 40)
    bits = mix(mix(points.astype(np.uint64) + np.uint64(1))[:, None] ^ mix(words)[None, :])
    return np.unpackbits(bits.view(np.uint8).reshape(len(points), -1), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def ngram_vectors(grams: np.ndarray) -> np.ndarray:
    """A row of +-1 for each three letters: the product of their vectors, the first two permuted."""
    parts = [grams >> (2 * POINT), (grams >> POINT) & ((1 << POINT) - 1), grams & ((1 << POINT) - 1)]
    points, at = np.unique(np.concatenate(parts), return_inverse=True)
    base = letter_vectors(points)
    a, b, c = at.reshape(3, -1)
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


class _Vectors:
    """The vectors of n-grams, of which a worker keeps the first REMEMBERED it meets."""

    def __init__(self):
        self.known, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.table = np.zeros((REMEMBERED, DIMENSIONS), np.float32)

    def row_of(self, grams: np.ndarray) -> np.ndarray:
        """Where the vectors of grams are kept, -1 for those that aren't."""
        if not len(self.known):
            return np.full(len(grams), -1)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return np.where(self.known[at] == grams, self.rows[at], -1)

    def keep(self, grams: np.ndarray, vectors: np.ndarray) -> None:
        """Keeps the vectors of new grams, as far as there is room."""
        n = len(self.known)
        room = min(len(grams), REMEMBERED - n)
        if room:
            self.table[n : n + room] = vectors[:room]
            known, rows = np.concatenate([self.known, grams[:room]]), np.concatenate([self.rows, np.arange(n, n + room)])
            order = np.argsort(known)
            self.known, self.rows = known[order], rows[order]


@held_by_worker
def _vectors() -> _Vectors:
    return _Vectors()


def ngrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Text and three lower-case letters (code points, POINT bits each) of every n-gram. A text's words stand between single 0s; a text without a letter has none."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\n" + "\n".join(lowered) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.where(_letters()[codes], codes, 0)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    keep = letters > 0
    keep[0] = True
    keep[1:] |= letters[:-1] > 0
    at = np.flatnonzero(keep)
    letters, doc = letters[at].astype(np.int64), np.searchsorted(ends, at, side="left")
    gram = (letters[:-2] << (2 * POINT)) | (letters[1:-1] << POINT) | letters[2:]
    doc = np.minimum(doc[1:-1], len(texts) - 1)
    real = letters[1:-1] > 0  # the middle letter tells the text
    return doc[real], gram[real]


def bundles(doc: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts (or other numbers in doc) the sum of its n-grams' vectors."""
    kind = np.float32 if len(gram) < 1 << 24 else np.float64  # whole numbers, held exactly
    kept = _vectors()
    counted = lambda of, at, wide: np.bincount(of * wide + at, minlength=n * wide).reshape(n, wide).astype(kind)
    row, wide = kept.row_of(gram), len(kept.known)
    found = row >= 0
    out = counted(doc[found], row[found], wide) @ kept.table[:wide].astype(kind, copy=False) if found.any() else np.zeros((n, DIMENSIONS), kind)
    if not found.all():
        of = doc[~found]
        grams, at = np.unique(gram[~found], return_inverse=True)
        for a in range(0, len(grams), 4096):
            part, own = grams[a : a + 4096], (at >= a) & (at < a + 4096)
            vectors = ngram_vectors(part).astype(kind)
            out += counted(of[own], at[own] - a, len(part)) @ vectors
            kept.keep(part, vectors)
    return out


def learn_profiles(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes: the sum of the n-gram vectors of all rows (text, lang).

    Each partition bundles its texts by language and sends one sum per language and dimension, however many letters and n-grams there are. Null
    texts and languages don't take part, empty texts have no n-grams, repeated rows count each; an empty table gives no languages.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b, texts in text_pieces(batch.column(0)):
                doc, gram = ngrams(texts)
                names = sorted(set(langs[a:b]))
                of = {name: k for k, name in enumerate(names)}
                found = bundles(np.array([of[x] for x in langs[a:b]])[doc], gram, len(names))
                for name, k in of.items():
                    sums[name] = sums.get(name, 0) + found[k].astype(np.int64)
        for name, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(found)], names=["lang", "dimension", "n"])

    known = docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = in_python(known, bundle, "lang string, dimension int, n long").groupBy("lang", "dimension").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    prototypes = np.zeros((len(langs), DIMENSIONS))
    prototypes[np.searchsorted(langs, rows["lang"].to_numpy(str)) if len(rows) else [], rows["dimension"].to_numpy(int)] = rows["n"]
    return langs, prototypes


def classify(texts: list, langs: list[str], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of the nearest prototype, by cosine, and that cosine, cut to 0 to 1."""
    return _nearest(texts, langs, prototypes)[:2]


def _nearest(texts: list, langs: list[str], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """classify(), and how many n-grams each text has."""
    doc, gram = ngrams(texts)
    bundle = bundles(doc, gram, len(texts))
    length = np.linalg.norm(bundle, axis=1)
    names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    if len(langs):
        unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
        cosine = bundle @ unit.T.astype(np.float32) / np.maximum(length, 1e-12)[:, None]
        some = length > 0
        best = cosine.argmax(axis=1)
        names[some] = np.array(langs, object)[best[some]]
        score[some] = np.clip(cosine.max(axis=1)[some], 0, 1)
    return names, score, np.bincount(doc, minlength=len(texts))


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray, pred: str = "lang_pred", confidence: str = "score", grams: str = "grams") -> DataFrame:
    """docs with lang_pred, score and grams, how many n-grams that is from (or other names), from the whole text.

    `und` with score 0 stands for a null text, a text without a letter, and for every text
    if no language was learned. Row by row, without a shuffle; other columns stay as they are.
    Equal rows get equal answers, an empty table gives none. Columns of docs with these names are replaced.
    """
    docs = docs.drop(pred, confidence, grams)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_pieces(batch.column(at), 1 << 18):
                for a in range(start, end, 64):
                    b = min(end, a + 64)
                    name, score, n = _nearest(texts[a - start : b - start], langs, prototypes)
                    own = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(name, pa.string()), pa.array(score), pa.array(n)], names=[*names, pred, confidence, grams])

    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(confidence, DoubleType()), StructField(grams, LongType())])
    return in_python(docs, run, schema)
