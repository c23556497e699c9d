"""Sleep rhythm over several nights of minute states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .timeline import longest_run, place, with_onset

KEYS = ("device_id", "night_id")
STATES = ("calm_sleep", "restless", "awake")


def _placed(states: DataFrame, keys: Sequence[str], ts: str, chunk_s: float | None = None) -> DataFrame:
    """states with the place of each minute in its night, from 0, and whether an awakening starts there."""
    return with_onset(place(states, keys, ts, (), "_place", chunk_s), F.col("state") == "awake", keys, ts, name="_woke", chunk_s=chunk_s)


def night_rhythm(states: DataFrame, keys: Sequence[str] = KEYS, ts: str = "minute", minutes_per_hour: int = 60, chunk_s: float | None = None) -> DataFrame:
    """Per night: minutes, awakenings, longest_calm, wake_hours (in order) and the share of each state, to three digits."""
    hour = F.floor(F.col("_place") / minutes_per_hour).cast("long")
    listed = F.array_sort(F.collect_list(F.when(F.col("_woke"), F.struct("_place", hour.alias("hour")))))
    share = lambda s: F.round(F.sum((F.col("state") == s).cast("long")) / F.count(F.lit(1)), 3).alias(s)
    out = _placed(states, keys, ts, chunk_s).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("minutes"),
        F.sum(F.col("_woke").cast("long")).alias("awakenings"),
        F.transform(listed, lambda x: x["hour"]).alias("wake_hours"),
        *(share(s) for s in STATES),
    )
    return out.join(longest_run(states, F.col("state") == "calm_sleep", keys, ts, name="longest_calm", chunk_s=chunk_s), list(keys))


def sleep_rhythm(nightly: DataFrame, device: Sequence[str] = ("device_id",)) -> DataFrame:
    """Per device: nights, and the means over its nights of awakenings, longest calm stretch and shares."""
    means = {"awakenings": "avg_awakenings", "longest_calm": "avg_longest_calm", **{s: f"avg_{s}" for s in STATES}}
    return nightly.groupBy(*device).agg(F.count(F.lit(1)).alias("nights"), *(F.avg(c).alias(name) for c, name in means.items()))


def wake_hours(states: DataFrame, keys: Sequence[str] = KEYS, ts: str = "minute", device: Sequence[str] = ("device_id",), minutes_per_hour: int = 60) -> DataFrame:
    """Awakenings of all nights by hour, with is_peak for the most frequent one; of equals, the one met first by night and time."""
    woke = _placed(states, keys, ts).where("_woke").withColumn("hour", F.floor(F.col("_place") / minutes_per_hour).cast("long"))
    nights = [k for k in keys if k not in device]
    hours = woke.groupBy(*device, "hour").agg(F.count(F.lit(1)).alias("awakenings"), F.min(F.struct(*nights, "_place")).alias("_first"))
    peak = F.row_number().over(Window.partitionBy(*device).orderBy(F.desc("awakenings"), "_first")) == 1
    return hours.withColumn("is_peak", peak).drop("_first")


def rhythm_insights(states: DataFrame, keys: Sequence[str] = KEYS, ts: str = "minute", device: Sequence[str] = ("device_id",), minutes_per_hour: int = 60) -> DataFrame:
    """Per device: the means of sleep_rhythm, the peak wake hour with its awakenings (null if nobody woke), and the text."""
    rhythm = sleep_rhythm(night_rhythm(states, keys, ts, minutes_per_hour), device)
    peak = wake_hours(states, keys, ts, device, minutes_per_hour).where("is_peak").select(*device, F.col("hour").alias("peak_hour"), F.col("awakenings").alias("peak_awakenings"))
    out = rhythm.join(peak, list(device), "left")
    text = F.concat_ws(
        "; ",
        F.format_string("%.1f awakenings a night, longest calm stretch %.0f min", "avg_awakenings", "avg_longest_calm"),
        F.when(F.col("peak_hour").isNotNull(), F.format_string("most often awake in hour %d (%d times in %d nights)", "peak_hour", "peak_awakenings", "nights")),
    )
    return out.withColumn("text", text)
