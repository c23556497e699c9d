"""A quality classifier by positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import fold, in_python, sampled_ids, texts_of
from .repetition import _repeats
from .textarrays import CHAR_INVERSE, Words, slices, text_pieces

#: At most so many trusted positives, and so many unlabelled texts, fit the classifier.
FIT_ROWS = 8_000
BINS = 12
THRESHOLD = 0.3


def features(texts: list) -> np.ndarray:
    """Shares and means of a whole text's words, characters and lines; zeros for a text without words."""
    w = Words(texts)
    chars = (w.end - w.start).astype(np.int64)
    per = lambda doc, weight=None: np.bincount(doc, weight, minlength=w.n).astype(float)
    words, text_chars = np.maximum(w.counts, 1.0), np.maximum(np.diff(w.bounds), 1.0)
    doc_of = lambda at: np.searchsorted(w.bounds, at, side="right") - 1
    share = lambda mask: per(doc_of(np.flatnonzero(mask))) / text_chars
    c = w.codes
    letters = ((c | 32) >= 97) & ((c | 32) <= 122) | (c >= 192)
    symbols = np.isin(c, np.array([ord(x) for x in "#*$%&|<>{}[]=\\/@^~_+"], np.uint32))
    shared, later = _repeats(w.key, w.doc)
    mean = per(w.doc, chars) / words
    start, end, doc = w.lines()
    before = np.concatenate([[0], np.cumsum(w.word)])
    filled = before[end] > before[start]
    start, end, doc = start[filled], end[filled], doc[filled]
    _, again = _repeats(slices(w.prefix, start, end, CHAR_INVERSE) + (end - start).astype(np.uint64), doc)
    lines = np.maximum(per(doc), 1.0)
    beside = np.zeros(len(w.doc), bool)
    beside[1:] = (w.key[1:] == w.key[:-1]) & (w.doc[1:] == w.doc[:-1])
    far = np.zeros(len(w.doc), bool)
    far[2:] = (w.key[2:] == w.key[:-2]) & (w.doc[2:] == w.doc[:-2])
    word_letters = np.concatenate([[0], np.cumsum(letters)])
    bare = word_letters[w.end] == word_letters[w.start] if len(w.end) else np.zeros(0, bool)
    ends_symbol = symbols[w.end - 1] if len(w.end) else np.zeros(0, bool)
    return np.stack(
        [
            np.log1p(w.counts),
            mean,
            np.sqrt(np.maximum(per(w.doc, chars.astype(float) ** 2) / words - mean**2, 0)),
            per(w.doc[~later]) / words,
            per(w.doc[beside]) / words,
            per(w.doc[far]) / words,
            share(letters),
            share(symbols),
            share((c >= 48) & (c <= 57)),
            share((c >= 65) & (c <= 90)),
            share(np.isin(c, np.array([ord(x) for x in ".,;:!?"], np.uint32))),
            per(w.doc[bare]) / words,
            per(w.doc[ends_symbol]) / words,
            words / lines,
            per(doc[again]) / lines,
            per(w.doc[shared]) / words,
        ],
        axis=1,
    ) * (w.counts > 0)[:, None]


def _measured(docs: DataFrame) -> DataFrame:
    """The other columns of docs with `x`, the features of its last column, text."""
    names = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_pieces(batch.column(len(names))):
                x = features(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], pa.array(list(x), pa.list_(pa.float64()))], names=[*names, "x"])

    schema = StructType([*docs.schema.fields[:-1], StructField("x", ArrayType(DoubleType()))])
    return in_python(docs, run, schema)


@dataclass
class Classifier:
    """Log odds as a sum of steps: one weight for each bin of each feature."""

    edges: np.ndarray
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, v, side="right") for e, v in zip(self.edges, x.T, strict=True)], axis=1)
        out = np.zeros((len(x), len(self.weights)))
        width = self.edges.shape[1] + 1
        out[np.arange(len(x))[:, None], np.arange(x.shape[1]) * width + bins] = 1
        out[:, -1] = 1
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that the scores of both samples allow.

    Among unlabelled texts under a score, positives can be no more than the share that the
    trusted ones have there; the tightest threshold bounds the prior. Thresholds that
    few positives pass would bound it by chance and are left out.
    """
    steps = np.quantile(positive, np.linspace(0.0, 0.5, 26))
    above = lambda s: (s[:, None] >= steps).mean(axis=0)
    return float(np.clip((above(unlabelled) / np.maximum(above(positive), 1e-9)).min(), 0.05, 0.98))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_parts(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """Of designs of positives and unlabelled texts: the risk of the positives, and that of the negatives, which may turn out under 0."""
    zp, zu = p @ w, u @ w
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of both parts; where the second is under 0, only its own with the sign turned, so that it comes back up."""
    zp, zu = p @ w, u @ w
    negative = (u.T @ _sigmoid(zu)) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
    return -negative if risk_parts(w, p, u, prior)[1] < 0 else negative + prior * (p.T @ (_sigmoid(zp) - 1)) / len(p)


def non_negative_fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> Classifier:
    """Minimises the non-negative unbiased risk of positive and unlabelled features, with logistic loss.

    risk = prior * loss(positive as 1) + max(0, loss(unlabelled as 0) - prior * loss(positive as 0)).
    Where the second part turns negative its gradient is followed upwards instead, as
    the non-negative estimator asks. The prior comes from a first fit of positives against
    unlabelled ones.
    """
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    # a feature that is mostly one value still gets a bin for what lies beyond it
    spread = np.quantile(both, [0.001, 0.01, 0.99, 0.999], axis=0).T
    edges = np.sort(np.concatenate([edges, spread], axis=1), axis=1)
    model = Classifier(edges, np.zeros(edges.shape[0] * (edges.shape[1] + 1) + 1), 0.5)
    p, u = model.design(positive), model.design(unlabelled)

    def descend(gradient) -> np.ndarray:
        w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
        for t in range(1, steps + 1):
            g = gradient(w) + 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return w

    first = descend(lambda w: (p.T @ (_sigmoid(p @ w) - 1)) / len(p) / 2 + (u.T @ _sigmoid(u @ w)) / len(u) / 2)
    prior = class_prior(p @ first, u @ first)
    model.weights, model.prior = descend(lambda w: risk_gradient(w, p, u, prior)), prior
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, fit_rows: int = FIT_ROWS) -> Classifier | None:
    """A classifier from at most fit_rows trusted positives (quality 1) and as many texts whose labels aren't looked at.

    Both come from documents outside the held-out fold, those with the smallest hashes of
    doc_id. A doc_id counts once, however many rows it has: as a positive if any label says so, with the text of the smallest hash. Rows without a doc_id
    don't take part, null texts count as empty ones. Without positives, as in empty tables, there is nothing to learn: None.
    """
    outside = fold(F.col("doc_id"), folds) != held
    trusted = sampled_ids(labels.where("quality = 1").where(outside), 4, fit_rows)
    free = sampled_ids(docs.where(outside), 4, fit_rows)
    wanted = trusted.withColumn("p", F.lit(1)).unionByName(free.withColumn("p", F.lit(0))).groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("u"))
    rows = _measured(texts_of(docs, wanted)).toPandas()  # 2 * fit_rows rows at most
    x = np.array(rows["x"].tolist(), float)
    positive, unlabelled = rows["p"].to_numpy() == 1, rows["u"].to_numpy() == 0
    if not positive.any() or not unlabelled.any():
        return None
    return non_negative_fit(x[positive], x[unlabelled])


def score_quality(docs: DataFrame, model: Classifier | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= threshold) of every row, from the whole text.

    Null and empty texts have the features of a text without words and are scored by them. Without a
    model every score is 0.5. Equal rows get equal scores, a null doc_id is kept, an empty table gives no rows. Row by row, without a shuffle; columns other than doc_id
    and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_pieces(batch.column(1)):
                score = np.full(b - a, 0.5) if model is None else model.score(features(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    schema = StructType().add("doc_id", "long").add("score", DoubleType()).add("predicted", IntegerType())
    return in_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)
