"""Personal baselines: exponential means of breathing and movement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

KEYS = ("device_id",)
#: Rows that one fold goes through.
PART = 256
STATE = ("samples", "mean", "var", "move")
SERIES = ("samples", "bpm_mean", "bpm_low", "bpm_high", "restless_threshold")


def _struct(**values: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in values.items()))


def _double(value: float | None = None) -> Column:
    return F.lit(value).cast("double")


def _empty() -> Column:
    """What no update at all does: of each measure the weight that is left to what was before, the own mean, its spread, and the first value."""
    none = {"left": _double(1.0), "own": _double(0.0), "spread": _double(0.0), "first": _double()}
    return _struct(rows=F.lit(0).cast("long"), x=_struct(**none), m=_struct(**none))


def _with_value(own: Column, value: Column, alpha: float) -> Column:
    """A measure's summary after one more value, if it isn't null: the mean and spread of the values by the weights they have now."""
    left = own["left"] * (1 - alpha)
    share = alpha / (1 - left)
    apart = value - own["own"]
    grown = _struct(left=left, own=own["own"] + share * apart, spread=(1 - share) * (own["spread"] + share * apart * apart), first=F.coalesce(own["first"], value))
    return F.when(value.isNull(), own).otherwise(grown)


def _joined(a: Column, b: Column) -> Column:
    """The summary of one stretch and the next, which is associative."""

    def measure(one: Column, two: Column) -> Column:
        left = one["left"] * two["left"]
        share = (1 - two["left"]) / (1 - left)
        apart = two["own"] - one["own"]
        both = _struct(left=left, own=one["own"] + share * apart, spread=(1 - share) * one["spread"] + share * two["spread"] + share * (1 - share) * apart * apart, first=F.coalesce(one["first"], two["first"]))
        return F.when(left < 1, both).otherwise(one)

    return _struct(rows=a["rows"] + b["rows"], x=measure(a["x"], b["x"]), m=measure(a["m"], b["m"]))


def _start() -> Column:
    return _struct(samples=F.lit(0).cast("long"), mean=_double(), var=_double(0.0), move=_double())


def _carried(state: Column, total: Column) -> Column:
    """The baseline after a stretch, from the one before it. Where nothing was before, the first value stands for it."""
    x, m = total["x"], total["m"]
    mean, move = F.coalesce(state["mean"], x["first"]), F.coalesce(state["move"], m["first"])
    apart = mean - x["own"]
    grown = x["left"] * mean + (1 - x["left"]) * x["own"], x["left"] * state["var"] + (1 - x["left"]) * x["spread"] + x["left"] * (1 - x["left"]) * apart * apart
    return _struct(
        samples=state["samples"] + total["rows"],
        mean=F.when(x["left"] < 1, grown[0]).otherwise(state["mean"]),
        var=F.when(x["left"] < 1, grown[1]).otherwise(state["var"]),
        move=F.when(m["left"] < 1, m["left"] * move + (1 - m["left"]) * m["own"]).otherwise(state["move"]),
    )


def _updated(state: Column, row: Column, alpha: float) -> Column:
    """The baseline after one row."""
    apart = row["x"] - state["mean"]
    seen, first = row["x"].isNotNull(), state["mean"].isNull()
    return _struct(
        samples=state["samples"] + 1,
        mean=F.when(~seen, state["mean"]).when(first, row["x"]).otherwise(state["mean"] + alpha * apart),
        var=F.when(~seen | first, state["var"]).otherwise((1 - alpha) * (state["var"] + alpha * apart * apart)),
        move=F.when(row["m"].isNull(), state["move"]).otherwise(F.coalesce(state["move"] + alpha * (row["m"] - state["move"]), row["m"])),
    )


def measures(rate: Column, movement: Column) -> tuple[Column, Column]:
    """What moves the means: positive rates and known movements, else null (NaN is neither)."""
    return F.when((rate > 0) & ~F.isnan(rate), rate.cast("double")).alias("x"), F.when(~F.isnan(movement), movement.cast("double")).alias("m")


def in_parts(rows: Column) -> Column:
    """An array cut into parts of PART elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / PART).cast("int")), lambda i: F.slice(rows, i * PART + 1, PART))


def sums_of(parts: Column, alpha: float) -> Column:
    """What each part of rows (with x and m) does to a baseline."""
    add = lambda s, r: _struct(rows=s["rows"] + 1, x=_with_value(s["x"], r["x"], alpha), m=_with_value(s["m"], r["m"], alpha))
    return F.transform(parts, lambda part: F.aggregate(part, _empty(), add))


def states_before(totals: Column, start: Column | None = None) -> Column:
    """The baseline before each of some stretches."""
    start = _start() if start is None else start
    follow = lambda out, total: F.concat(out, F.array(_carried(F.element_at(out, -1), total)))
    return F.slice(F.aggregate(totals, F.array(start), follow), 1, F.size(totals))


def states_after(parts: Column, states: Column, alpha: float) -> Column:
    """For each row of all parts (struct row) the baseline after it (struct state), from the baselines before the parts."""

    def through(part: Column, state: Column) -> Column:
        none = F.transform(F.slice(part, 1, 0), lambda r: _struct(row=r, state=state))
        step = lambda acc, r: _struct(now=_updated(acc["now"], r, alpha), out=F.concat(acc["out"], F.array(_struct(row=r, state=_updated(acc["now"], r, alpha)))))
        return F.aggregate(part, _struct(now=state, out=none), step, lambda acc: acc["out"])

    return F.flatten(F.zip_with(parts, states, through))


def told(state: Column, k: float) -> list[Column]:
    """SERIES from a baseline's state."""
    sd = F.sqrt(F.greatest(state["var"], F.lit(0.0)))
    threshold = F.greatest(F.lit(0.4), F.coalesce(state["move"], F.lit(0.1)) * 2 + 0.2)
    return [c.alias(n) for c, n in zip((state["samples"], state["mean"], state["mean"] - k * sd, state["mean"] + k * sd, threshold), SERIES, strict=True)]


def personal_baseline_series(df: DataFrame, alpha: float = 0.05, k: float = 2.0, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",), rate: str = "breathing_rate", movement: str = "movement", chunk_s: float = 86400.0) -> DataFrame:
    """The baseline after every update: samples, bpm_mean, bpm_low, bpm_high and restless_threshold.

    Only positive breathing rates and non-null movements move the means; samples counts every row. The running
    value is a recurrence, but what a stretch of time does to it can be told without what came before, and stretches can be put
    together. So each chunk of chunk_s becomes an array in order, cut into parts of PART rows; parts and chunks are summed up, the
    sums of a key (one small struct a chunk) give the baseline before each chunk, and each part is gone through from the
    baseline before it. Folds of built-in functions all the way; a task holds a chunk of a key.
    """
    row = F.struct(ts, *seq, *measures(F.col(rate), F.col(movement)))
    chunks = df.groupBy(*keys, F.floor(F.col(ts) / chunk_s).cast("long").alias("_chunk")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    summed = chunks.withColumn("_parts", in_parts(F.col("_rows"))).withColumn("_sums", sums_of(F.col("_parts"), alpha))
    totals = summed.select(*keys, "_chunk", F.aggregate("_sums", _empty(), _joined).alias("_total"))
    listed = totals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_total"))).alias("_all"))
    before = F.arrays_zip(F.transform("_all", lambda c: c["_chunk"]).alias("_chunk"), states_before(F.transform("_all", lambda c: c["_total"])).alias("_state"))
    starts = listed.select(*(F.col(c).alias(f"_key_{i}") for i, c in enumerate(keys)), F.inline(before)).withColumnRenamed("_chunk", "_key_chunk")
    same = F.col("_chunk") == F.col("_key_chunk")
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_key_{i}"))
    met = summed.join(starts, same)
    after = states_after(F.col("_parts"), states_before(F.col("_sums"), F.col("_state")), alpha)
    rows = met.select(*keys, F.explode(after).alias("_r"))
    return rows.select(*keys, *(F.col(f"_r.row.{c}").alias(c) for c in (ts, *seq)), *told(F.col("_r.state"), k))


def fused_baseline_series(fused: DataFrame, per_message: bool = True, alpha: float = 0.05, k: float = 2.0, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",), topic: str = "sensor/radar", chunk_s: float = 86400.0) -> DataFrame:
    """personal_baseline_series() of fused rows (topic, and radar as of each message).

    per_message: every message of any topic feeds the latest radar reading once more, as a live service does, so readings weigh by how many
    messages follow them; otherwise each radar reading counts once. Messages before the first radar reading feed nothing and give no row.
    """
    fed = fused.where(F.col("radar").isNotNull() if per_message else F.col("topic") == topic)
    return personal_baseline_series(fed.select(*keys, ts, *seq, "radar.breathing_rate", "radar.movement"), alpha, k, keys, ts, seq, chunk_s=chunk_s)


def personal_baseline(df: DataFrame, alpha: float = 0.05, k: float = 2.0, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",), rate: str = "breathing_rate", movement: str = "movement") -> DataFrame:
    """The baseline after the last update, as a plain weighted aggregate.

    The i-th of n values weighs alpha * (1 - alpha)^(n - i), the first (1 - alpha)^(n - 1); the variance of the
    recurrence is the weighted variance. So one exchange and no state from row to row are enough.
    """

    def weighted(value: str, positive: bool, name: str) -> DataFrame:
        rows = df.where(F.col(value).isNotNull() & ~F.isnan(value) & ((F.col(value) > 0) if positive else F.lit(True)))
        back = Window.partitionBy(*keys).orderBy(F.desc(ts), *(F.desc(c) for c in seq))
        rows = rows.withColumns({"_back": F.row_number().over(back) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
        decay = F.pow(F.lit(1.0 - alpha), F.col("_back").cast("double"))
        rows = rows.withColumn("_w", F.when(F.col("_back") == F.col("_n") - 1, decay).otherwise(decay * alpha))
        # the mean first, then the squares around it: no difference of large numbers
        rows = rows.withColumn("_m", F.sum(F.col("_w") * F.col(value)).over(Window.partitionBy(*keys)))
        apart = F.col(value) - F.col("_m")
        return rows.groupBy(*keys).agg(F.first("_m").alias(f"{name}_mean"), F.sum(F.col("_w") * apart * apart).alias(f"{name}_var"))

    samples = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    out = samples.join(weighted(rate, True, "bpm"), list(keys), "left").join(weighted(movement, False, "move").drop("move_var"), list(keys), "left")
    sd = F.sqrt(F.greatest(F.col("bpm_var"), F.lit(0.0)))
    threshold = F.greatest(F.lit(0.4), F.coalesce(F.col("move_mean"), F.lit(0.1)) * 2 + 0.2)
    return out.select(*keys, "samples", "bpm_mean", (F.col("bpm_mean") - k * sd).alias("bpm_low"), (F.col("bpm_mean") + k * sd).alias("bpm_high"), threshold.alias("restless_threshold"))
