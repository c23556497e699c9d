"""Minute records, night summaries and the context of crying."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import at_least, field, has, yes
from .baseline import personal_baseline
from .timeline import count_onsets, longest_run

KEYS = ("device_id",)


def minute_features(signals: DataFrame, keys: Sequence[str] = KEYS, ts: str = "t", size_s: float = 60.0, cry_threshold: float = 0.7) -> DataFrame:
    """The de-identified record of each minute, from rows with radar, cry and env structs (null where a row has none).

    minute counts from the epoch; breathing_rate is the mean of the positive rates that were measured, movement the
    largest, cry and apnea are 1 if any row has them, co2, temp and humidity are means.
    """
    rate = F.coalesce(field(signals, "radar", "breathing_rate"), field(signals, "radar", "breathing_bpm"))
    measured = F.coalesce(field(signals, "radar", "breath_valid", "boolean"), F.lit(True)) & (rate > 0)
    sure = at_least(F.coalesce(field(signals, "cry", "confidence"), field(signals, "cry", "cry_score"), F.lit(0.0)), cry_threshold)
    crying = has(signals, "cry") & yes(field(signals, "cry", "is_crying", "boolean")) & sure
    any_of = lambda c: F.max(c.cast("int"))
    return signals.groupBy(*keys, F.floor(F.col(ts) / size_s).cast("long").alias("minute")).agg(
        F.avg(F.when(measured, rate)).alias("breathing_rate"),
        any_of(crying).alias("cry"),
        any_of(yes(field(signals, "radar", "apnea", "boolean"))).alias("apnea"),
        F.max(field(signals, "radar", "movement")).alias("movement"),
        F.avg(field(signals, "env", "co2")).alias("co2"),
        F.avg(field(signals, "env", "temp")).alias("temp"),
        F.avg(field(signals, "env", "humidity")).alias("humidity"),
    )


def _hour(minutes_per_hour: int) -> Column:
    return F.floor(F.col("minute") / minutes_per_hour).cast("long")


def cry_hours(minutes: DataFrame, keys: Sequence[str] = KEYS, minutes_per_hour: int = 60) -> DataFrame:
    """Cry minutes of each hour, with the first one."""
    crying = minutes.where(F.col("cry") > 0)
    return crying.groupBy(*keys, _hour(minutes_per_hour).alias("hour")).agg(F.count(F.lit(1)).alias("cry_minutes"), F.min("minute").alias("first_minute"))


def cry_by_hour(minutes: DataFrame, keys: Sequence[str] = KEYS, minutes_per_hour: int = 60) -> DataFrame:
    """Cry minutes of each hour and is_peak, the hour with the most (of equals the one seen first)."""
    hours = cry_hours(minutes, keys, minutes_per_hour)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cry_minutes"), "first_minute")) == 1
    return hours.withColumn("is_peak", first).drop("first_minute")


def night_summary(minutes: DataFrame, keys: Sequence[str] = KEYS, minutes_per_hour: int = 60, alpha: float = 0.02) -> DataFrame:
    """One row per night: events and minutes of crying and apnea, breathing outside apnea, ranges of CO2 and temperature, the
    longest calm stretch, cry minutes by hour (a map) and the personal range."""
    calm = (F.col("cry") == 0) & (F.col("apnea") == 0) & (F.col("movement") < 0.3)
    still = F.when(F.col("apnea") == 0, F.col("breathing_rate"))
    order = {"keys": keys, "ts": "minute"}
    out = minutes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("monitored_min"),
        F.sum(F.col("cry").cast("long")).alias("cry_minutes"),
        F.avg(still).alias("avg_bpm"),
        F.min(still).alias("bpm_min"),
        F.max(still).alias("bpm_max"),
        *(f(c).alias(f"{c}_{n}") for c in ("co2", "temp") for n, f in (("min", F.min), ("max", F.max))),
    )
    hours = cry_hours(minutes, keys, minutes_per_hour).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour", "cry_minutes")))).alias("cry_by_hour"))
    personal = personal_baseline(minutes, alpha, keys=keys, ts="minute", seq=()).select(*keys, "bpm_low", "bpm_high")
    for part in (
        count_onsets(minutes, F.col("cry") > 0, name="cry_events", **order),
        count_onsets(minutes, F.col("apnea") > 0, name="apnea_events", **order),
        longest_run(minutes, calm, name="longest_calm_min", **order),
        personal,
        hours,
    ):
        out = out.join(part, list(keys), "left")
    return out.withColumn("cry_by_hour", F.coalesce("cry_by_hour", F.create_map().cast("map<bigint,bigint>")))


def cry_context(minutes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per measure (humidity, co2, temp): its mean in cry minutes, in the others, and the difference; only where both kinds are there."""
    crying = F.col("cry") > 0
    measures = ("humidity", "co2", "temp")
    wide = minutes.groupBy(*keys).agg(
        F.sum(crying.cast("long")).alias("cry_minutes"),
        F.count(F.lit(1)).alias("minutes"),
        *(F.avg(F.when(crying == of, F.col(m))).alias(f"{m}_{of}") for m in measures for of in (True, False)),
    )
    both = wide.where((F.col("cry_minutes") > 0) & (F.col("cry_minutes") < F.col("minutes")))
    rows = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"{m}_True").alias("cry_mean"), F.col(f"{m}_False").alias("other_mean")) for m in measures))
    return both.select(*keys, F.inline(rows)).withColumn("diff", F.col("cry_mean") - F.col("other_mean"))


def cry_insights(minutes: DataFrame, keys: Sequence[str] = KEYS, minutes_per_hour: int = 60) -> DataFrame:
    """One row per insight of each key: insufficient (only one kind of minutes), dry, stuffy, warm, cool, peak_hour or none."""
    context = cry_context(minutes, keys)
    diff = F.col("diff")
    code = (
        F.when((F.col("measure") == "humidity") & (diff < -5), "dry")
        .when((F.col("measure") == "co2") & (diff > 80), "stuffy")
        .when((F.col("measure") == "temp") & (diff > 1), "warm")
        .when((F.col("measure") == "temp") & (diff < -1), "cool")
    )
    found = context.withColumn("insight", code).where("insight is not null").select(*keys, "insight", F.col("diff").alias("value"))
    known = context.select(*keys).distinct()
    peaks = cry_by_hour(minutes, keys, minutes_per_hour).where("is_peak").join(known, list(keys), "left_semi")
    found = found.unionByName(peaks.select(*keys, F.lit("peak_hour").alias("insight"), F.col("hour").cast("double").alias("value")))
    other = minutes.select(*keys).distinct().join(known, list(keys), "left_anti")
    return found.unionByName(other.select(*keys, F.lit("insufficient").alias("insight"), F.lit(None).cast("double").alias("value")))
