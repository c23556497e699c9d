"""Raw device states to clean radar readings, one a second."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import above, at_least, yes
from . import chunks
from .timeline import ordered, up_to_now, with_runs

KEYS = ("device_id",)
PREFIX = "mr60bha2"
STALE_S, MOVE_WINDOW_S, MOVE_SCALE_CM = 10.0, 2.0, 30.0
APNEA_HOLD_S, APNEA_PRIOR_S, RECENT_S, SMOOTH_S = 6.0, 120.0, 1.5, 8.0
RATE_RANGE, DISTANCE_RANGE, MOVE_REJECT = (5.0, 60.0), (20.0, 150.0), 0.5


def parse_device_states(raw: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """The columns of raw without topic and payload, and breath, heart, distance and presence, of which each row sets one.

    Rows of other topics and payloads that are no number go. NaN is a number.
    """
    value = F.expr("try_cast(trim(payload) AS double)")
    of = lambda name: F.col("topic") == f"{prefix}/{name}"
    parsed = raw.withColumns({
        "breath": F.when(of("breath_rate"), value),
        "heart": F.when(of("heart_rate"), value),
        "distance": F.when(of("distance"), value),
        "presence": F.when(of("presence"), F.upper(F.trim("payload")).isin("ON", "TRUE", "1")),
    })
    return parsed.where(F.coalesce(F.col("breath"), F.col("heart"), F.col("distance"), F.col("presence").cast("double")).isNotNull()).drop("topic", "payload")


def _back(keys: Sequence[str], ts: str, seconds: float) -> WindowSpec:
    """The rows of the last seconds, to the microsecond."""
    return Window.partitionBy(*keys).orderBy(F.round(F.col(ts) * 1e6).cast("long")).rangeBetween(-round(seconds * 1e6), 0)


def _seen_at(near: DataFrame, ticks: DataFrame, period: int, window: int, keys: Sequence[str], ts: str, chunk_s: float) -> DataFrame:
    """ticks (with their number _k) with _n and _span: how many values _near the last window microseconds have, and their span.

    Values are summed up by the tick that ends their period, so a tick looks back on one row a period, however many messages there are:
    on all of the periods that its window holds, and on the end of the one that the window begins in.
    """
    whole, rest = window // period, window % period
    of = lambda k: F.floor(k * (period / 1e6) / chunk_s).cast("long")
    cells = near.withColumn("_us", F.round(F.col(ts) * 1e6).cast("long")).withColumn("_k", F.expr(f"-((-_us - pmod(-_us, {period}L)) div {period}L)"))
    late = F.when(F.col("_k") * period - F.col("_us") <= rest, F.col("_near"))
    cells = cells.groupBy(*keys, "_k").agg(*(f(c).alias(f"_{f.__name__}_{name}") for name, c in (("all", F.col("_near")), ("late", late)) for f in (F.count, F.min, F.max)))
    # a period is also copied to the chunks that it reaches into
    cells = cells.withColumn("_part", F.explode(F.sequence(of(F.col("_k")), of(F.col("_k") + whole))))
    both = ticks.withColumns({"_part": of(F.col("_k")), "_tick": F.lit(True)}).unionByName(cells, allowMissingColumns=True)
    back = Window.partitionBy(*keys, "_part").orderBy("_k")
    over = {"late": back.rangeBetween(-whole, -whole)} | ({"all": back.rangeBetween(-whole + 1, 0)} if whole else {})
    found = lambda of, f: [of(f"_{f}_{name}").over(w) for name, w in over.items()]
    one = lambda f, columns: f(*columns) if whole else columns[0]
    count = sum((F.coalesce(n, F.lit(0)) for n in found(F.sum, "count")), F.lit(0))
    span = one(F.greatest, found(F.max, "max")) - one(F.least, found(F.min, "min"))
    return both.withColumns({"_n": count, "_span": span}).where("_tick").select(*ticks.columns, "_n", "_span")


def sample_ticks(states: DataFrame, period_s: float = 1.0, stale_s: float = STALE_S, move_window_s: float = MOVE_WINDOW_S, move_scale: float = MOVE_SCALE_CM, keys: Sequence[str] = KEYS, ts: str = "t", chunk_s: float | None = None, silent_until: Column | None = None) -> DataFrame:
    """The state at each tick of a grid of period_s: breath, heart, distance, presence and movement.

    Ticks run over the time that each key reported, on whole multiples of period_s, so grids of keys agree. A tick sees
    the last value of each state up to it; presence counts as true until it is known. There is no tick before
    the first breath, nor when nothing at all was received for over stale_s. With silent_until ticks also go on after a key's last message, as long
    as it is fresh, if that ends before the moment silent_until.
    movement is the span of the distances of the last move_window_s over move_scale, cut to 0..1; 0.1 for under two.

    Only grid points within stale_s of a message can count, so the grid is built around messages and
    doesn't grow with the silences between them.
    """
    known = ("breath", "heart", "distance", "presence")
    messages = states.select(*keys, ts, *known)
    if chunk_s:
        told = chunks.filled_until(messages, known, keys, ts, chunk_s, "_next")
    else:
        # messages of one moment see each other, and the last of them has the ticks
        w = Window.partitionBy(*keys).orderBy(ts)
        now = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        told = messages.withColumns({**{c: F.last(c, ignorenulls=True).over(now) for c in known}, "_next": F.lead(ts).over(w)})
    # each message brings the ticks from it on, until the next one comes or it is stale
    lo, until = F.ceil(F.col(ts) / period_s), F.col(ts)
    if silent_until is not None:
        until = F.when(F.col(ts) + stale_s < silent_until, F.col(ts) + stale_s).otherwise(F.col(ts))
    hi = F.floor(F.least(F.col(ts) + stale_s, F.coalesce("_next", until)) / period_s)
    ticks = told.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi AND breath IS NOT NULL").withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn("_t", F.col("_k") * period_s)
    own = (F.col("_t") >= F.col(ts)) & F.coalesce(F.col("_t") < F.col("_next"), F.lit(True)) & (F.col("_t") - F.col(ts) <= stale_s)
    ticks = ticks.where(own).select(*keys, F.col("_t").alias(ts), *known, "_k")
    near = messages.where("NOT isnan(distance)").select(*keys, ts, F.col("distance").alias("_near"))
    if chunk_s and (period_s * 1e6).is_integer():
        seen = _seen_at(near, ticks, round(period_s * 1e6), round(move_window_s * 1e6), keys, ts, chunk_s)
    else:
        both, parts = ticks.unionByName(near, allowMissingColumns=True), [*keys]
        if chunk_s:
            # a distance is also copied to the chunk that it reaches into
            of = lambda t: F.floor(t / chunk_s).cast("long")
            reach = F.when(F.col("_near").isNull(), of(F.col(ts))).otherwise(of(F.col(ts) + move_window_s))
            both = both.withColumn("_part", F.explode(F.sequence(of(F.col(ts)), reach)))
            parts = [*keys, "_part"]
        back = _back(parts, ts, move_window_s)
        seen = both.withColumns({"_n": F.count("_near").over(back), "_span": F.max("_near").over(back) - F.min("_near").over(back)}).where("_k IS NOT NULL")
    moving = F.when(F.col("_n") < 2, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_span") / move_scale)))
    return seen.select(*keys, ts, "breath", "heart", "distance", F.coalesce("presence", F.lit(True)).alias("presence"), moving.alias("movement"))


def measurable(presence: Column, distance: Column, movement: Column) -> Column:
    """Someone is there, near enough and still."""
    low, high = DISTANCE_RANGE
    return yes(presence) & yes((distance <= high)) & at_least(distance, low) & (movement <= MOVE_REJECT)


def breath_is_trustworthy(breath: Column, distance: Column, presence: Column, movement: Column) -> Column:
    low, high = RATE_RANGE
    return measurable(presence, distance, movement) & at_least(breath, low) & yes(breath <= high)


def with_smooth_breath(ticks: DataFrame, window_s: float = SMOOTH_S, keys: Sequence[str] = KEYS, ts: str = "t") -> DataFrame:
    """ticks with trusted and smooth, the median of the trusted rates of the last window_s; null without any."""
    trusted = breath_is_trustworthy(F.col("breath"), F.col("distance"), F.col("presence"), F.col("movement"))
    ticks = ticks.withColumn("trusted", trusted)
    values = F.array_sort(F.collect_list(F.when(F.col("trusted"), F.col("breath"))).over(_back(keys, ts, window_s)))
    ticks = ticks.withColumn("_v", values)
    n = F.size("_v")
    middle = lambda i: F.element_at("_v", i.cast("int"))
    smooth = F.when(n > 0, (middle(F.floor((n + 1) / 2)) + middle(F.floor((n + 2) / 2))) / 2)
    return ticks.withColumn("smooth", smooth).drop("_v")


def with_apnea(ticks: DataFrame, hold_s: float = APNEA_HOLD_S, prior_s: float = APNEA_PRIOR_S, keys: Sequence[str] = KEYS, ts: str = "t") -> DataFrame:
    """ticks (with trusted) with apnea: a breath that was measured has been gone for hold_s although it could be measured.

    The condition: measurable, a trusted breath in the last prior_s, none in the last RECENT_S. It must hold at
    every tick from its first one on; any other tick starts over. Ticks that weren't emitted don't count.
    """
    last_valid = F.last(F.when(F.col("trusted"), F.col(ts)), ignorenulls=True).over(up_to_now(ordered(keys, ts)))
    gone = F.col(ts) - last_valid
    missing = measurable(F.col("presence"), F.col("distance"), F.col("movement")) & yes((gone <= prior_s) & (gone > RECENT_S))
    runs = with_runs(ticks.withColumn("_missing", missing), F.col("_missing"), keys, ts, name="_run")
    since = F.min(ts).over(Window.partitionBy(*keys, "_run"))
    return runs.withColumn("apnea", F.col("_missing") & (F.col(ts) - since >= hold_s)).drop("_missing", "_run")


def readings(ticks: DataFrame, keys: Sequence[str] = KEYS, ts: str = "t", source: str = PREFIX) -> DataFrame:
    """The outgoing reading of each tick; the rate is 0 where nothing was measured and in apnea."""
    rate = F.when(F.col("apnea") | F.col("smooth").isNull(), 0.0).otherwise(F.col("smooth"))
    return ticks.select(
        *keys,
        ts,
        rate.alias("breathing_rate"),
        "movement",
        "presence",
        "apnea",
        above(F.col("movement"), MOVE_REJECT).alias("motion"),
        F.lit(source).alias("source"),
        F.col("heart").alias("heart_rate"),
        "distance",
        F.col("breath").alias("raw_breath"),
        F.col("smooth").isNotNull().alias("breath_valid"),
    )


def normalize_radar(raw: DataFrame, keys: Sequence[str] = KEYS, ts: str = "t", prefix: str = PREFIX, period_s: float = 1.0, **seconds: float) -> DataFrame:
    """Readings from the raw device states (keys, ts, topic, payload). seconds: stale_s, move_window_s, smooth_s, hold_s, prior_s."""
    ticks = sample_ticks(parse_device_states(raw, prefix), period_s, seconds.get("stale_s", STALE_S), seconds.get("move_window_s", MOVE_WINDOW_S), keys=keys, ts=ts)
    ticks = with_smooth_breath(ticks, seconds.get("smooth_s", SMOOTH_S), keys, ts)
    return readings(with_apnea(ticks, seconds.get("hold_s", APNEA_HOLD_S), seconds.get("prior_s", APNEA_PRIOR_S), keys, ts), keys, ts, prefix)


def normalize_cry(scores: DataFrame, threshold: float = 0.3, score: str = "score") -> DataFrame:
    """scores with is_crying, cls and confidence (to two digits)."""
    return scores.withColumns({"is_crying": above(F.col(score), threshold), "cls": F.lit("none"), "confidence": F.round(F.col(score), 2)})


def normalize_env(env: DataFrame, lux: float = 15.0) -> DataFrame:
    """env with lux where the sensor has none."""
    own = F.col("lux").cast("double") if "lux" in env.columns else F.lit(None).cast("double")
    return env.withColumn("lux", F.coalesce(own, F.lit(lux)))
