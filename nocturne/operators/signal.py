"""Breathing features of sampled radar signals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import kernels

KEYS = ("device_id",)


def signal_windows(samples: DataFrame, size_s: int = 12, hop_s: int = 1, keys: Sequence[str] = KEYS, ts: str = "t", value: str = "value") -> DataFrame:
    """Keys, window_end (seconds, exclusive) and samples: the values of the last size_s seconds in order, one row per hop_s.

    Values are first gathered by hop; windows then put the arrays of their hops together, so a sample goes through the
    exchange once and not once for each window. Windows at the start are partial; size_s is a multiple of hop_s.
    """
    hop = F.floor(F.col(ts) / hop_s).cast("long")
    chunks = samples.groupBy(*keys, hop.alias("_hop")).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))).alias("_chunk"))
    w = Window.partitionBy(*keys).orderBy("_hop").rangeBetween(-(size_s // hop_s) + 1, 0)
    joined = F.flatten(F.collect_list("_chunk").over(w))
    return chunks.withColumn("samples", F.transform(joined, lambda x: x["v"])).select(*keys, ((F.col("_hop") + 1) * hop_s).alias("window_end"), "samples")


def fixed_windows(samples: DataFrame, size_s: float, keys: Sequence[str] = KEYS, ts: str = "t", value: str = "value") -> DataFrame:
    """Windows of size_s that don't overlap."""
    of = F.floor(F.col(ts) / size_s).cast("long")
    listed = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))))
    return samples.groupBy(*keys, of.alias("window_id")).agg(F.transform(listed, lambda x: x["v"]).alias("samples"))


def _scalar(kernel, kind: str, empty):
    """A column function: kernel over the arrays of a batch, equal lengths together."""

    @F.pandas_udf(kind)
    def run(signals: pd.Series) -> pd.Series:
        return pd.Series(kernels.by_length(signals, kernel, empty))

    return run


def estimate_bpm(samples: Column, fs: float, low: float = 15.0, high: float = 70.0) -> Column:
    """Breathing rate per minute: the strongest frequency from low to high per minute, under a Hann window; 0 without one."""
    return _scalar(lambda x: kernels.bpm(x, fs, low, high), "double", 0.0)(samples)


def detect_apnea(samples: Column, fs: float, window_s: float = 4.0, ratio: float = 0.2) -> Column:
    """Whether the last window_s swing less than ratio of what comes before. Plain expressions, no Python."""
    n = int(window_s * fs)
    size = F.size(samples)

    def rms(x: Column) -> Column:
        count = F.size(x).cast("double")
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / count
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / count) + 1e-12

    values = F.transform(samples, lambda v: v.cast("double"))
    recent = F.slice(values, F.greatest(size - n, F.lit(0)) + 1, n)
    before = F.when(size > n, F.slice(values, F.lit(1), F.greatest(size - n, F.lit(0)))).otherwise(values)
    return F.coalesce((size >= max(2, n)) & (rms(recent) < ratio * rms(before)), F.lit(False))


def detect_motion(samples: Column, fs: float, window_s: float = 2.0, from_hz: float = 1.5, ratio: float = 2.0) -> Column:
    """Whether the energy above from_hz of the last window_s is over ratio times that of what comes before."""
    return _scalar(lambda x: kernels.motion(x, fs, window_s, from_hz, ratio), "boolean", False)(samples)


def process_windows(windows: DataFrame, fs: float, samples: str = "samples") -> DataFrame:
    """windows with breathing_bpm, breathing_rate (0 in apnea), apnea, motion and movement (1.0 in motion, else 0.1), from one pass over the arrays."""

    @F.pandas_udf("breathing_bpm double, apnea boolean, motion boolean")
    def run(signals: pd.Series) -> pd.DataFrame:
        kernel = lambda x: zip(kernels.bpm(x, fs), kernels.apnea(x, fs), kernels.motion(x, fs), strict=True)
        rows = kernels.by_length(signals, lambda x: list(kernel(x)), (0.0, False, False))
        return pd.DataFrame(rows, columns=["breathing_bpm", "apnea", "motion"])

    told = windows.withColumn("_r", run(samples))
    return told.withColumns({
        "breathing_bpm": F.col("_r.breathing_bpm"),
        "breathing_rate": F.when(F.col("_r.apnea"), 0.0).otherwise(F.col("_r.breathing_bpm")),
        "apnea": F.col("_r.apnea"),
        "motion": F.col("_r.motion"),
        "movement": F.when(F.col("_r.motion"), 1.0).otherwise(0.1),
    }).drop("_r")


def band_energy(samples: Column, fs: float, low: float = 0.1, high: float = 1.0) -> Column:
    return _scalar(lambda x: kernels.band_energy(x, fs, low, high), "double", 0.0)(samples)


def select_range_bin(bins: DataFrame, fs: float, window: Sequence[str] = ("device_id", "window_id"), bin_: str = "bin", samples: str = "samples") -> DataFrame:
    """Of each window's range bins (a row each) the one with the most breathing energy; of equals the lowest."""
    told = bins.withColumn("energy", band_energy(F.col(samples), fs))
    best = F.row_number().over(Window.partitionBy(*window).orderBy(F.desc("energy"), bin_))
    return told.withColumn("_best", best).where("_best = 1").drop("_best")


def detrend(samples: Column) -> Column:
    """samples less their least-squares line."""
    return _scalar(lambda x: kernels.detrend(x), "array<double>", None)(samples)


def bandpass(samples: Column, fs: float, low: float = 0.1, high: float = 1.0) -> Column:
    return _scalar(lambda x: kernels.bandpass(x, fs, low, high), "array<double>", None)(samples)


def with_trend(samples: DataFrame, keys: Sequence[str] = KEYS, index: str = "i", value: str = "value") -> DataFrame:
    """Long form of detrend: samples with trend and detrended, by least squares per key."""
    w = Window.partitionBy(*keys)
    x, y = F.col(index).cast("double"), F.col(value).cast("double")
    slope = F.coalesce(F.covar_pop(y, x).over(w) / F.when(F.var_pop(x).over(w) > 0, F.var_pop(x).over(w)), F.lit(0.0))
    trend = F.avg(y).over(w) + slope * (x - F.avg(x).over(w))
    return samples.withColumn("trend", trend).withColumn("detrended", y - F.col("trend"))


def estimate_bpm_multibin(bins: DataFrame, fs: float, window: Sequence[str] = ("device_id", "window_id"), bin_: str = "bin", samples: str = "samples") -> DataFrame:
    """Per window the best bin and its rate, after the trend and all but the breathing band are taken out."""

    def clean(x: np.ndarray) -> np.ndarray:
        return kernels.bpm(kernels.bandpass(kernels.detrend(x), fs), fs)

    chosen = select_range_bin(bins, fs, window, bin_, samples)
    return chosen.select(*window, bin_, _scalar(clean, "double", 0.0)(F.col(samples)).alias("bpm"))


def estimate_bpm_naive(bins: DataFrame, fs: float, window: Sequence[str] = ("device_id", "window_id"), samples: str = "samples") -> DataFrame:
    """Per window the rate of the mean over its bins, place by place; a window's bins are equally long, null ones take no part."""
    rows = bins.where(F.col(samples).isNotNull()).select(*window, array_to_vector(F.col(samples).cast("array<double>")).alias("_v"))
    mean = rows.groupBy(*window).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("_m"))
    return mean.select(*window, estimate_bpm(F.col("_m"), fs).alias("bpm"))


def apnea_delay(samples: DataFrame, truth: DataFrame, fs: float, window_s: float = 4.0, step_s: float = 0.5, ratio: float = 0.2, keys: Sequence[str] = KEYS, index: str = "i", value: str = "value") -> DataFrame:
    """Per key the time at which apnea is first detected, as the signal grows by step_s from window_s on, and its delay to onset_s of truth.

    samples has the place of each value, from 0. Running sums give the spread of every prefix's last window and of what
    comes before it in one pass; a key without a detection has null.
    """
    n, step = int(window_s * fs), int(step_s * fs)
    w = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mean = F.avg(value).over(Window.partitionBy(*keys))  # keeps the sums of squares small
    shifted = samples.withColumn("_v", F.col(value) - mean)
    sums = shifted.withColumns({"_s": F.sum("_v").over(w), "_q": F.sum(F.col("_v") * F.col("_v")).over(w)})
    back = Window.partitionBy(*keys).orderBy(index)
    sums = sums.withColumns({"_s0": F.coalesce(F.lag("_s", n).over(back), F.lit(0.0)), "_q0": F.coalesce(F.lag("_q", n).over(back), F.lit(0.0))})
    size = F.col(index) + 1
    spread = lambda q, s, m: F.sqrt(F.greatest(q / m - (s / m) * (s / m), F.lit(0.0))) + 1e-12
    recent = spread(F.col("_q") - F.col("_q0"), F.col("_s") - F.col("_s0"), F.lit(float(n)))
    before = spread(F.col("_q0"), F.col("_s0"), F.when(size > n, (size - n).cast("double")))
    hit = (size > n) & ((size - n) % step == 0) & (recent < ratio * before)
    first = sums.groupBy(*keys).agg((F.min(F.when(hit, size)) / fs).alias("detected_s"))
    return first.join(truth, list(keys), "left").withColumn("delay_s", F.col("detected_s") - F.col("onset_s"))
