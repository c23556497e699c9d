"""Evaluation of policies, estimators and classifiers against labelled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .baseline import personal_baseline
from .fusion import POLICIES, emit_alerts, with_place_in_run


def score_policies(df: DataFrame, policies: Sequence[str] = POLICIES, truth: str = "expected", rates: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """False alarms and misses of each policy's level column; an alarm is the level alert. One pass for all policies."""
    rows = F.array(*(F.struct(F.lit(p).alias("policy"), (F.col(p) == "alert").alias("alarm")) for p in policies))
    long = df.select(*keys, F.col(truth).alias("_truth"), F.inline(rows))
    count = lambda c: F.sum(c.cast("long"))
    out = long.groupBy(*keys, "policy").agg(
        F.count(F.lit(1)).alias("rows"),
        count(F.col("_truth")).alias("alerts"),
        count(F.col("alarm") & ~F.col("_truth")).alias("false_alarms"),
        count(~F.col("alarm") & F.col("_truth")).alias("misses"),
    )
    if not rates:
        return out
    normals = F.col("rows") - F.col("alerts")
    return out.withColumns({
        "false_alarm_rate": F.when(normals > 0, F.col("false_alarms") / normals).otherwise(0.0),
        "miss_rate": F.col("misses") / F.greatest(F.lit(1), F.col("alerts")),
    })


def level_matrix(df: DataFrame, policies: Sequence[str] = POLICIES, truth: str = "expected", row: Sequence[str] = ("scenario",)) -> DataFrame:
    return df.select(*row, truth, *policies)


def agreement(df: DataFrame, pred: str, truth: str, keys: Sequence[str] = ()) -> DataFrame:
    """rows, correct and accuracy of pred against truth; arrays are compared as sets."""
    return with_agreement(df, pred, truth).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("ok").cast("long")).alias("correct"), F.avg(F.col("ok").cast("double")).alias("accuracy")
    )


def with_agreement(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """df with ok and, for arrays, both sides as sorted texts joined by |."""

    def plain(c: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(c)), "|") if df.schema[c].dataType.typeName() == "array" else F.col(c)

    out = df.withColumn("ok", plain(pred).eqNullSafe(plain(truth)))
    if df.schema[pred].dataType.typeName() == "array":
        out = out.withColumns({f"{pred}_text": plain(pred), f"{truth}_text": plain(truth)})
    return out


def mae_by(df: DataFrame, pred: str, truth: str, keys: Sequence[str], pivot: str | None = None, values: Sequence | None = None) -> DataFrame:
    """Mean absolute error per keys, or with pivot a column for each of its values (give them, and no pass is needed to find them)."""
    error = F.avg(F.abs(F.col(pred) - F.col(truth)))
    if pivot is None:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), error.alias("mae"))
    return df.groupBy(*keys).pivot(pivot, list(values) if values is not None else None).agg(error)


def alert_quality(alerts: DataFrame, intervals: DataFrame, transients: DataFrame | None = None, keys: Sequence[str] = ("device_id",), config: Sequence[str] = (), ts: str = "t", bucket_s: float = 3600.0, settings: Sequence[Sequence] | None = None) -> DataFrame:
    """Per config and labelled interval [start_ts, end_ts): the alerts in it and the latency of the first; with transients also false_alerts.

    Alerts and intervals meet on keys and a bucket of time, an interval in each bucket that it touches, so neither
    side has to be small. settings has the values of config that there are; without it they are looked up in alerts.
    """
    of = lambda t: F.floor(t / bucket_s).cast("long")
    last = F.greatest(of(F.col("start_ts")), F.ceil(F.col("end_ts") / bucket_s).cast("long") - 1)
    spans = intervals.withColumn("_b", F.explode(F.sequence(of(F.col("start_ts")), last)))
    hits = alerts.withColumn("_b", of(F.col(ts))).join(spans, [*keys, "_b"]).where((F.col(ts) >= F.col("start_ts")) & (F.col(ts) < F.col("end_ts")))
    found = hits.groupBy(*config, *keys, "start_ts", "end_ts").agg(F.count(F.lit(1)).alias("alerts_in"), (F.min(ts) - F.first("start_ts")).alias("latency_s"))
    every = intervals
    if config:  # settings are a handful
        kinds = {f.name: f.dataType for f in alerts.schema.fields}
        values = settings if settings is not None else [tuple(r) for r in alerts.select(*config).distinct().collect()]
        rows = [F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(config, vs, strict=True))) for vs in values]
        every = intervals.select(F.explode(F.array(*rows)).alias("_c"), "*").select("_c.*", *intervals.columns) if rows else intervals.limit(0).withColumns({c: F.lit(None).cast(kinds[c]) for c in config})
    out = every.join(found, [*config, *keys, "start_ts", "end_ts"], "left").withColumn("alerts_in", F.coalesce("alerts_in", F.lit(0)))
    totals = alerts.groupBy(*config, *keys).agg(F.count(F.lit(1)).alias("total_alerts"))
    out = out.join(totals, [*config, *keys], "left").withColumn("total_alerts", F.coalesce("total_alerts", F.lit(0)))
    if transients is not None:
        false = alerts.join(transients.select(*keys, ts).distinct(), [*keys, ts], "left_semi").groupBy(*config, *keys).agg(F.count(F.lit(1)).alias("false_alerts"))
        out = out.join(false, [*config, *keys], "left").withColumn("false_alerts", F.coalesce("false_alerts", F.lit(0)))
    return out


def alert_sweep(decided: DataFrame, configs: Sequence[tuple[int, float]], keys: Sequence[str] = ("device_id",), ts: str = "t", seq: Sequence[str] = ("seq",), chunk_s: float | None = None) -> DataFrame:
    """Alerts under several settings (debounce n, cooldown seconds), marked by debounce_n and cooldown_s.

    One pass: how long a level has lasted is told once, then each row comes once for each setting, which is one more key.
    """
    settings = F.array(*(F.struct(F.lit(n).alias("debounce_n"), F.lit(float(c)).alias("cooldown_s")) for n, c in configs))
    placed = with_place_in_run(decided, F.col("raw_level"), keys, ts, seq, "_nth", chunk_s)
    every = placed.select(*keys, ts, *seq, "raw_level", "reasons", "_nth", F.inline(settings))
    level = every.withColumn("level", F.when(F.col("_nth") >= F.col("debounce_n"), F.col("raw_level")).otherwise("normal"))
    return emit_alerts(level, "cooldown_s", [*keys, "debounce_n", "cooldown_s"], ts, seq, chunk_s)


def baseline_error(df: DataFrame, truth: DataFrame, keys: Sequence[str] = ("device_id",), alpha: float = 0.05, ts: str = "t", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """Distance of each learned breathing mean to true_bpm."""
    learned = personal_baseline(df, alpha, keys=keys, ts=ts, seq=seq).select(*keys, "samples", "bpm_mean")
    return learned.join(truth, list(keys)).withColumn("error", F.abs(F.col("bpm_mean") - F.col("true_bpm")))


def confusion_matrix(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("rows"))


def classification_report(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """precision, recall, f1 and support of each class that is true or predicted anywhere, with macro_f1, their mean, beside them."""
    pairs = confusion_matrix(df, truth, pred)
    rows = F.array(
        F.struct(F.col("truth").alias("label"), F.when(F.col("truth").eqNullSafe(F.col("pred")), F.col("rows")).otherwise(0).alias("hit"), F.col("rows").alias("own"), F.lit(0).cast("long").alias("told")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("own"), F.col("rows").alias("told")),
    )
    sums = pairs.select(F.inline(rows)).groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("own").alias("support"), F.sum("told").alias("predicted"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.withColumns({"precision": ratio(F.col("hit"), F.col("predicted")), "recall": ratio(F.col("hit"), F.col("support"))})
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    every = Window.partitionBy()  # a row per class
    return out.select("label", "precision", "recall", "f1", "support", F.avg("f1").over(every).alias("macro_f1"))
