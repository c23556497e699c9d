"""Labelled clips: splits, weights, pooling, waveforms and a classifier head."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from ..functions import kernels
from ..sources.shared import written

#: The classes that count as crying.
CRY_CLASSES = ("Baby cry, infant cry", "Crying, sobbing")


def class_distribution(clips: DataFrame, label: str = "label", group: str = "group") -> DataFrame:
    return clips.groupBy(label).agg(F.count(F.lit(1)).alias("clips"), F.countDistinct(group).alias("groups"))


def group_split(clips: DataFrame, test: float = 0.2, seed: int = 42, group: str = "group") -> DataFrame:
    """clips with split: whole groups go to test (about that share of them) or to train, by a hash of group and seed."""
    share = F.conv(F.substring(F.md5(F.concat(F.col(group), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return clips.withColumn("split", F.when(share < test, "test").otherwise("train"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """The balanced weight of each class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    every = Window.partitionBy()  # a row per class
    return counts.withColumn("weight", F.sum("rows").over(every) / (F.count(F.lit(1)).over(every) * F.col("rows")))


def pool_embeddings(frames: DataFrame, clip: str = "clip", embedding: str = "embedding") -> DataFrame:
    """The mean embedding of each clip's frames, place by place; a clip's frames are equally long, null ones take no part.

    Vectors are summed up before the exchange, so a clip sends one from each task.
    """
    rows = frames.where(F.col(embedding).isNotNull()).select(clip, array_to_vector(F.col(embedding).cast("array<double>")).alias("_v"))
    return rows.groupBy(clip).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(embedding))


def pool_frames(scores: DataFrame, cry_classes: Sequence = CRY_CLASSES, threshold: float = 0.5, clip: str = "clip") -> DataFrame:
    """Per clip cry_score, the larger of the cry classes' mean scores over frames (0 without such a class), and is_crying; scores is (clip, frame, class, score)."""
    means = scores.groupBy(clip, "class").agg(F.avg("score").alias("_mean"))
    own = F.when(F.col("class").isin(*cry_classes), F.col("_mean"))
    out = means.groupBy(clip).agg(F.coalesce(F.max(own), F.lit(0.0)).alias("cry_score"))
    return out.withColumn("is_crying", F.col("cry_score") > threshold)


def cry_score(scores: DataFrame, cry_classes: Sequence = CRY_CLASSES, keys: Sequence[str] = ("clip", "frame")) -> DataFrame:
    """Per window the largest score of the cry classes and its class; of equals the first class in order."""
    rows = scores.where(F.col("class").isin(*cry_classes))
    place = F.array_position(F.array(*map(F.lit, cry_classes)), F.col("class"))
    return rows.groupBy(*keys).agg(F.max("score").alias("cry_score"), F.max_by("class", F.struct("score", -place)).alias("label"))


def resample(samples: Column, rate: float, target: float = 16000.0) -> Column:
    """Linear interpolation of each waveform from rate to target samples a second."""

    @F.pandas_udf("array<double>")
    def run(waves: pd.Series) -> pd.Series:
        return waves.map(lambda w: None if w is None else kernels.resample(np.asarray(w, float), rate, target))

    return run(samples)


def fit_window(samples: Column, n: int = 15600) -> Column:
    """The last n samples, or all of them and zeros up to n."""
    size = F.size(samples)
    zero = F.try_element_at(F.transform(F.slice(samples, 1, 1), lambda x: x * 0 + 0), F.lit(1))
    padded = F.concat(samples, F.array_repeat(F.coalesce(zero, F.lit(0.0)), F.greatest(F.lit(n) - size, F.lit(0))))
    return F.when(size >= n, F.slice(samples, F.greatest(size - n, F.lit(0)) + 1, n)).otherwise(padded)


def _numbered_waves(waves: DataFrame, samples: str, name: str, buckets: int = 64) -> tuple[DataFrame, int]:
    """Waveforms as `name` with _i from 0 on, by their content, and how many there are; counted by buckets, so no task holds them all."""
    rows = waves.where(F.size(samples) > 0).select(F.col(samples).cast("array<double>").alias(name)).withColumn("_h", F.xxhash64(name))
    rows = rows.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sizes = dict(rows.groupBy("_b").count().collect())  # `buckets` rows
    before, total = {}, 0
    for b in sorted(sizes):
        before[b] = total
        total += sizes[b]
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("_b")) if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", name)) - 1
    return rows.select((offset + place).cast("long").alias("_i"), name), total


def augment(clips: DataFrame, n: int = 2, noise: DataFrame | None = None, rir: DataFrame | None = None, seed: int = 42, rate: int = 16000, clip: str = "path", samples: str = "samples") -> DataFrame:
    """n altered copies of each clip, with `copy` from 0: noise, echo and distance, each at even odds and in a random order.

    A copy's random numbers follow from seed, clip and copy alone, so a task that runs again gives the same. noise and rir
    are tables of waveforms of any size: they are numbered by content, and each copy is joined to the ones that its hash picks. Give training clips only.
    """
    names = clips.columns
    schema = StructType([StructField(samples, ArrayType(FloatType())) if f.name == samples else f for f in clips.schema.fields] + [StructField("copy", IntegerType())])
    copies = clips.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for salt, (name, waves) in enumerate((("_noise", noise), ("_response", rir))):
        table, size = _numbered_waves(waves, samples, name) if waves is not None else (None, 0)
        if not size:
            copies = copies.withColumn(name, F.lit(None).cast("array<double>"))
            continue
        pick = F.pmod(F.xxhash64(F.col(clip), "copy", F.lit(seed), F.lit(salt)), F.lit(size))
        copies = copies.withColumn("_i", pick).join(table, "_i", "left").drop("_i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            waves = []
            for name, copy, wave, *others in zip(*(rows[c] for c in (clip, "copy", samples, "_noise", "_response")), strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(str(name).encode()), int(copy)])
                waves.append(None if wave is None else kernels.augmented(np.asarray(wave, float), rng, *(None if x is None else np.asarray(x, float) for x in others), rate))
            yield rows.assign(**{samples: waves})[[*names, "copy"]]

    return copies.mapInPandas(run, schema)


def train_head(df: DataFrame, label: str = "label", embedding: str = "embedding", reg: float = 0.01, max_iter: int = 50) -> PipelineModel:
    """A multinomial logistic head on embeddings, each class weighing the same in total."""
    text = df.withColumn("_label", F.col(label).cast("string"))
    weighed = text.join(F.broadcast(class_weights(text, "_label").select("_label", "weight")), "_label")  # a row per class
    ready = weighed.select("_label", "weight", array_to_vector(F.col(embedding).cast("array<double>")).alias("_features"))
    index = StringIndexer(inputCol="_label", outputCol="_index", stringOrderType="alphabetAsc").fit(ready)
    head = LogisticRegression(featuresCol="_features", labelCol="_index", weightCol="weight", family="multinomial", regParam=reg, maxIter=max_iter, predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw")
    return PipelineModel([head.fit(index.transform(ready)), IndexToString(inputCol="_pred", outputCol="pred", labels=index.labels)])


def predict_head(model: PipelineModel, df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """df with pred and confidence."""
    told = model.transform(df.withColumn("_features", array_to_vector(F.col(embedding).cast("array<double>"))))
    return told.withColumn("confidence", F.array_max(vector_to_array("_prob"))).drop("_features", "_raw", "_prob", "_pred")


@dataclass
class HiddenHead:
    """A head with one hidden layer: labels in order, and weights (embedding x hidden, hidden, hidden x labels, labels)."""

    labels: list[str]
    weights: list[np.ndarray]
    losses: list[float]

    def told(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the labels, a row for each embedding."""
        a, b, c, d = self.weights
        return _softmax(np.maximum(x @ a + b, 0) @ c + d)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _backwards(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: list[np.ndarray], kept: np.ndarray | float = 1.0) -> tuple[float, list[np.ndarray]]:
    """The weighted cross entropy of some rows, summed, and its gradient. kept: by what the hidden units are multiplied."""
    a, b, c, d = weights
    hidden = np.maximum(x @ a + b, 0) * kept
    p = _softmax(hidden @ c + d)
    loss = float(-(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
    out = p
    out[np.arange(len(y)), y] -= 1
    out *= w[:, None]
    back = (out @ c.T) * kept * (hidden > 0)
    return loss, [x.T @ back, back.sum(0), hidden.T @ out, out.sum(0)]


def train_hidden_head(df: DataFrame, label: str = "label", embedding: str = "embedding", hidden: int = 256, epochs: int = 40, batches: int = 4, rate: float = 0.003, dropout: float = 0.4, patience: int = 6, seed: int = 42) -> HiddenHead:
    """A head with a layer of hidden relu units, classes weighing the same in total, by Adam over minibatches, stopped early.

    A tenth of the rows, by a hash of the embedding, only says when to stop: after `patience` epochs without a smaller loss there; the best
    weights are kept. Each step is a job: every task sums the gradient of its rows of the minibatch, Spark adds the tasks' sums up, and one
    small table of weights goes back out, whatever the number of rows. Minibatches and units left out follow from seed alone.
    """
    text = df.where(F.col(label).isNotNull() & F.col(embedding).isNotNull()).select(F.col(label).cast("string").alias("_label"), F.col(embedding).cast("array<double>").alias("x"))
    weighed = class_weights(text, "_label").select("_label", "weight").orderBy("_label").collect()  # a row per class
    labels = [r["_label"] for r in weighed]
    names = F.broadcast(df.sparkSession.createDataFrame([(r["_label"], i, float(r["weight"])) for i, r in enumerate(weighed)], "_label string, y int, w double"))
    part = F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(10 * 9973)).cast("int")
    rows = written(text.join(names, "_label").select("x", "y", "w", part.alias("part")), "head")
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("no labelled embedding to learn from")
    rng = np.random.default_rng(seed)
    shapes = [(first[0], hidden), (hidden,), (hidden, len(labels)), (len(labels),)]
    weights = [rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
    moments, squares = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    cut = np.cumsum([w.size for w in weights])[:-1]

    def summed(chosen: DataFrame, now: list[np.ndarray], drop: float, salt: int) -> np.ndarray:
        """Loss, weight and gradient over chosen rows."""

        def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + sum(w.size for w in now))
            units = np.random.default_rng([seed, salt]).random((9973, now[0].shape[1])) >= drop if drop else None
            for batch in tables:
                if not batch.num_rows:
                    continue
                x, y, w, part = np.array(batch.column(0).to_pylist(), float), *(batch.column(i).to_numpy() for i in (1, 2, 3))
                kept = units[part % 9973] / (1 - drop) if drop else 1.0
                loss, gradient = _backwards(x, y, w, now, kept)
                total += np.concatenate([[loss, w.sum()], *(g.ravel() for g in gradient)])
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})

        sums = chosen.mapInArrow(run, "sums array<double>").select(Summarizer.sum(array_to_vector("sums")).alias("s")).first()
        return sums["s"].toArray()

    step, best, losses, waited = 0, weights, [], 0
    for epoch in range(epochs):
        for k in range(batches):
            order = F.pmod(F.xxhash64("part", F.lit(seed + epoch)), F.lit(batches)) == k
            sums = summed(rows.where("part % 10 <> 0").where(order), weights, dropout, step)
            step += 1
            if not sums[1]:
                continue
            gradient = [g.reshape(s) / sums[1] for g, s in zip(np.split(sums[2:], cut), shapes, strict=True)]
            moments = [0.9 * m + 0.1 * g for m, g in zip(moments, gradient, strict=True)]
            squares = [0.999 * v + 0.001 * g * g for v, g in zip(squares, gradient, strict=True)]
            weights = [w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) for w, m, v in zip(weights, moments, squares, strict=True)]
        told = summed(rows.where("part % 10 = 0"), weights, 0.0, 0)
        losses.append(told[0] / told[1] if told[1] else 0.0)
        if losses[-1] <= min(losses):
            best, waited = weights, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return HiddenHead(labels, best, losses)


def predict_hidden_head(head: HiddenHead, df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """df with pred and confidence; null for a null embedding."""

    @F.pandas_udf("pred string, confidence double")
    def tell(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"pred": pd.Series([None] * len(vectors), dtype=object), "confidence": np.nan})
        some = vectors.notna().to_numpy()
        if some.any():
            p = head.told(np.array(vectors[some].tolist(), float))
            out.loc[some, "pred"] = np.array(head.labels, object)[p.argmax(1)]
            out.loc[some, "confidence"] = p.max(1)
        return out

    told = df.withColumn("_told", tell(F.col(embedding).cast("array<double>")))
    return told.withColumns({"pred": F.col("_told.pred"), "confidence": F.when(F.col("_told.pred").isNotNull(), F.col("_told.confidence"))}).drop("_told")
