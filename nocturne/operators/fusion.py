"""Fusion of radar, cry and environment readings into levels, sleep states, recommendations and alerts.

The readings of a moment are three struct columns, radar, cry and env; a null struct is a modality that
isn't there, a null or missing field a key that wasn't sent, which gets each rule's own default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import above, at_least, field, has, present, yes
from . import chunks
from .timeline import filled, latest, ordered, with_parts, with_runs

KEYS = ("device_id",)


def latest_signals(radar: DataFrame, cry: DataFrame, env: DataFrame, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",), chunk_s: float | None = None) -> DataFrame:
    """A row for each message of any modality with the latest payload of all three so far.

    Each input has keys, ts, seq and its struct column. There is no limit to a payload's age: a modality
    that stopped stays in force. A union and a fill instead of a range join: one exchange. A log that has all three structs
    in its rows needs no union: fill_signals().
    """
    both = radar.unionByName(cry, allowMissingColumns=True).unionByName(env, allowMissingColumns=True)
    return fill_signals(both, keys, ts, seq, chunk_s)


def fill_signals(log: DataFrame, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",), chunk_s: float | None = None) -> DataFrame:
    """log, whose rows have the payload of one modality each, with the latest payload of all three so far; with chunk_s for devices of any length."""
    return filled(log, ("radar", "cry", "env"), keys, ts, seq, chunk_s)


def tick_signals(radar: DataFrame, cry: DataFrame, env: DataFrame, keys: Sequence[str] = KEYS, ts: str = "t", chunk_s: float | None = None) -> DataFrame:
    """A row for each moment at which any modality reported, with all three readings filled up to it.

    Each input has one row per key and moment.
    """
    on = [*keys, ts]
    return filled(radar.join(cry, on, "full").join(env, on, "full"), ("radar", "cry", "env"), keys, ts, chunk_s=chunk_s)


def _rules(df: DataFrame) -> dict[str, Column]:
    rate = F.coalesce(field(df, "radar", "breathing_rate"), field(df, "radar", "breathing_bpm"), F.lit(99.0))
    apnea, here = yes(field(df, "radar", "apnea", "boolean")), yes(field(df, "radar", "presence", "boolean"))
    valid = F.coalesce(field(df, "radar", "breath_valid", "boolean"), F.lit(True))
    sure = F.coalesce(field(df, "cry", "confidence"), field(df, "cry", "cry_score"), F.lit(0.0))
    cry = has(df, "cry") & yes(field(df, "cry", "is_crying", "boolean")) & at_least(sure, 0.7)
    moving = above(F.coalesce(field(df, "radar", "movement"), F.lit(0.0)), 0.6)
    bad_air = above(F.coalesce(field(df, "env", "co2"), F.lit(0.0)), 1000)
    temp = field(df, "env", "temp")
    borderline = here & ~apnea & valid & (((rate >= 8) & (rate <= 15)) | above(rate, 55))
    return {
        "apnea_suspected": has(df, "radar") & here & (apnea | (valid & (rate < 8))),
        "cry_detected": cry,
        # neither presence nor a valid breath is asked for here
        "multi_signal": cry & has(df, "radar") & (moving | apnea | (rate < 8)),
        "borderline_cross": has(df, "radar") & borderline & (cry | bad_air),
        "co2_high": bad_air,
        "temp_abnormal": F.coalesce((temp < 18), F.lit(False)) | above(temp, 26),
    }


def with_decision(df: DataFrame, level: str = "raw_level", reasons: str = "reasons") -> DataFrame:
    """df with the level (normal, attention, alert) and the reasons' codes, in the order of the rules."""
    rules = _rules(df)
    alert = rules["apnea_suspected"] | rules["multi_signal"] | rules["borderline_cross"]
    attention = rules["cry_detected"] | rules["co2_high"] | rules["temp_abnormal"]
    named = {k: F.lit(k) for k in rules} | {"cry_detected": F.concat(F.lit("cry_detected("), F.coalesce(field(df, "cry", "cls", "string"), F.lit("None")), F.lit(")"))}
    return df.withColumns({level: F.when(alert, "alert").when(attention, "attention").otherwise("normal"), reasons: present(*(F.when(rules[k], named[k]) for k in rules))})


def with_single_sensor(df: DataFrame, name: str = "single_sensor") -> DataFrame:
    """df with the level of the plain policy: the first abnormal signal alone raises an alert."""
    any_one = (
        yes(field(df, "cry", "is_crying", "boolean"))
        | yes(field(df, "radar", "apnea", "boolean"))
        | above(F.coalesce(field(df, "radar", "movement"), F.lit(0.0)), 0.5)
        | above(F.coalesce(field(df, "env", "co2"), F.lit(0.0)), 800)
    )
    return df.withColumn(name, F.when(any_one, "alert").otherwise("normal"))


POLICIES = ("single_sensor", "radar_only", "audio_only", "env_only", "full_fusion")


def with_policies(df: DataFrame, policies: Sequence[str] = POLICIES) -> DataFrame:
    """df with one level column for each policy, all in one pass. cry_rules and env_rules decide by one modality alone."""
    columns = df.columns
    temp = F.coalesce(field(df, "env", "temp"), F.lit(22.0))
    sure = at_least(F.coalesce(field(df, "cry", "confidence"), F.lit(0.0)), 0.7)
    plain = {
        "audio_only": yes(field(df, "cry", "is_crying", "boolean")) & sure,
        "env_only": has(df, "env") & (above(F.coalesce(field(df, "env", "co2"), F.lit(0.0)), 1000) | (temp < 18) | above(temp, 26)),
    }
    shown = {"full_fusion": ("radar", "cry", "env"), "radar_only": ("radar",), "cry_rules": ("cry",), "env_rules": ("env",)}
    for policy in policies:
        if policy == "single_sensor":
            df = with_single_sensor(df)
        elif policy in plain:
            df = df.withColumn(policy, F.when(plain[policy], "alert").otherwise("normal"))
        else:
            # the decision without the structs of the other modalities
            rules = _rules(df.select(*shown[policy]))
            alert = rules["apnea_suspected"] | rules["multi_signal"] | rules["borderline_cross"]
            attention = rules["cry_detected"] | rules["co2_high"] | rules["temp_abnormal"]
            df = df.withColumn(policy, F.when(alert, "alert").when(attention, "attention").otherwise("normal"))
    return df.select(*columns, *policies)


def with_sleep_state(df: DataFrame, state: str = "sleep_state", reason: str = "sleep_reason", cry_threshold: float = 0.7) -> DataFrame:
    """df with calm_sleep, restless, awake, hold or unknown, and the reason's code. A cry without a confidence counts as sure here."""
    rate = F.coalesce(field(df, "radar", "breathing_rate"), field(df, "radar", "breathing_bpm"))
    valid = F.coalesce(field(df, "radar", "breath_valid", "boolean"), F.lit(True))
    moving = F.coalesce(field(df, "radar", "movement"), F.lit(0.0))
    crying = yes(field(df, "cry", "is_crying", "boolean")) & at_least(F.coalesce(field(df, "cry", "confidence"), F.lit(1.0)), cry_threshold)
    cases = (
        (~(has(df, "radar") & yes(field(df, "radar", "presence", "boolean"))), "unknown", "no_presence"),
        (yes(field(df, "radar", "apnea", "boolean")) | (valid & yes(rate < 8)), "hold", "breathing_abnormal"),
        (~valid, "hold", "breathing_not_measured"),
        (crying | at_least(moving, 0.7), "awake", "cry_or_movement"),
        (at_least(moving, 0.4), "restless", "movement"),
    )
    states, why = F, F
    for condition, a, b in cases:
        states, why = states.when(condition, a), why.when(condition, b)
    return df.withColumns({state: states.otherwise("calm_sleep"), reason: why.otherwise("regular_breathing")})


def with_recommendations(df: DataFrame, state: str = "sleep_state", actions: str = "actions") -> DataFrame:
    """df with the actions' codes that the environment calls for; dim_light only in sleep."""
    value = lambda name, default: F.coalesce(field(df, "env", name), F.lit(float(default)))
    co2, humidity, temp, lux = value("co2", 0), value("humidity", 50), value("temp", 22), value("lux", 0)
    asleep = yes(F.col(state).isin("calm_sleep", "restless")) if state in df.columns else F.lit(False)
    chosen = present(
        F.when(above(co2, 1000), "ventilate"),
        F.when(humidity < 35, "humidify").when(above(humidity, 60), "dehumidify"),
        F.when(above(temp, 26), "cool").when(temp < 18, "heat"),
        F.when(asleep & above(lux, 40), "dim_light"),
    )
    return df.withColumn(actions, F.when(has(df, "env"), chosen).otherwise(F.array().cast("array<string>")))


def with_place_in_run(df: DataFrame, value: Column, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",), name: str = "nth", chunk_s: float | None = None) -> DataFrame:
    """df with name: how many rows in a row, this one included, have had the same value so far."""
    runs = with_runs(df, value, keys, ts, seq, "_run", chunk_s)
    if chunk_s:
        return chunks.place_in_run(runs, "_run", keys, ts, seq, chunk_s, name).drop("_run")
    return runs.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(ts, *seq))).drop("_run")


def debounce(df: DataFrame, n: int = 2, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",), raw: str = "raw_level", level: str = "level", chunk_s: float | None = None) -> DataFrame:
    """df with the level that passes: an abnormal raw level counts from its n-th row in a row on, until then it is normal."""
    placed = with_place_in_run(df, F.col(raw), keys, ts, seq, "_nth", chunk_s)
    return placed.withColumn(level, F.when(F.col("_nth") >= n, F.col(raw)).otherwise("normal")).drop("_nth")


def alert_candidates(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",), chunk_s: float | None = None) -> DataFrame:
    """Rows where the debounced level turns to something else than normal, with the alert's key."""
    if chunk_s:
        known = chunks.neighbour(df, F.col("level"), keys, ts, seq, chunk_s, "_before")
    else:
        known = df.withColumn("_before", F.lag("level").over(ordered(keys, ts, seq)))
    turned = known.where((F.col("level") != F.coalesce("_before", F.lit("normal"))) & (F.col("level") != "normal"))
    return turned.select(*keys, ts, *seq, "level", "reasons", F.concat_ws("|", F.col("level"), F.array_join("reasons", "|")).alias("alert_key"))


def emit_alerts(df: DataFrame, cooldown_s: float | str = 10.0, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",), chunk_s: float | None = None) -> DataFrame:
    """Alerts that go out, from rows with level and reasons: keys, ts, seq, level and reason.

    A candidate is held back if it has the key of the last alert that went out, less than cooldown_s before (a number, or one of
    keys). One whose key differs from the candidate before it always goes out: if that one went out, the last key is another
    one; if it was held back, the last key was its own. So does one that comes cooldown_s or more after the candidate before it. So
    candidates fall into stretches, each of one key and without such a gap, that don't depend on each other; only inside a stretch,
    a fold over its moments tells who goes out.
    """
    wait = F.col(cooldown_s) if isinstance(cooldown_s, str) else F.lit(float(cooldown_s))
    found = alert_candidates(df, keys, ts, seq, chunk_s).withColumn("_wait", wait)
    free = lambda a, b: (a["key"] != b["key"]) | (b["t"] - a["t"] >= b["wait"])
    parts = with_parts(found, F.struct(F.col("alert_key").alias("key"), F.col(ts).alias("t"), F.col("_wait").alias("wait")), free, keys, ts, seq, "_part", chunk_s)
    moments = F.array_sort(F.collect_list(F.struct(ts, *seq)))
    stretch = parts.groupBy(*keys, "_part").agg(moments.alias("_moments"), F.first("level").alias("level"), F.first("reasons").alias("reasons"), F.first("_wait").alias("_wait"))
    first = F.slice("_moments", 1, 1)

    def step(out: Column, now: Column) -> Column:
        return F.when(now[ts] - F.element_at(out, -1)[ts] >= F.col("_wait"), F.concat(out, F.array(now))).otherwise(out)

    sent = F.when(F.size("_moments") == 1, first).otherwise(F.aggregate(F.slice("_moments", 2, F.size("_moments")), first, step))
    return stretch.select(*keys, F.inline(sent), "level", F.array_join("reasons", ", ").alias("reason"))


def fusion_states(df: DataFrame, n: int = 2, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """The state of every moment: level, raw_level, reasons (of the debounced level), sleep, actions. `personal` passes through."""
    told = debounce(with_recommendations(with_sleep_state(with_decision(df, reasons="raw_reasons"))), n, keys, ts, seq)
    reasons = F.when(F.col("level") != "normal", F.col("raw_reasons")).otherwise(F.array().cast("array<string>"))
    sleep = F.struct(F.col("sleep_state").alias("state"), F.col("sleep_reason").alias("reason"))
    more = ["personal"] if "personal" in df.columns else []
    return told.select(*keys, ts, *seq, "level", "raw_level", reasons.alias("reasons"), sleep.alias("sleep"), "actions", *more)


def control_actions(states: DataFrame, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """The control events: states with at least one action."""
    return states.where(F.size("actions") > 0).select(*keys, ts, *seq, "actions")


def status_board(states: DataFrame, alerts: DataFrame, k_radar: int = 60, k_events: int = 12, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """One row per key for a dashboard, from fused rows (topic, radar, level) and alerts (level, reason).

    The latest moment, level and number of messages; the last k_radar breathing rates, oldest first; the last
    k_events alerts, newest first; and what to show: at level normal, `unmeasurable` where someone is
    there whose breath isn't measured, else the level.
    """
    moment = F.struct(ts, *seq)
    unclear = yes(F.col("radar.presence")) & ~F.coalesce(F.col("radar.breath_valid"), F.lit(True))
    shown = F.when((F.col("level") == "normal") & unclear, "unmeasurable").otherwise(F.col("level"))
    # one pass over the states: radar rows are counted from the newest back in the window that the aggregate then uses
    of_radar = F.col("topic") == "sensor/radar"
    back = Window.partitionBy(*keys).orderBy(F.desc(ts), *(F.desc(c) for c in seq))
    nth = F.sum(of_radar.cast("int")).over(back)
    rate = F.coalesce(F.col("radar.breathing_rate"), F.lit(0.0))
    in_place = lambda rows: F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["v"])
    board = states.withColumns({"_shown": shown, "_nth": nth}).groupBy(*keys).agg(
        F.max(ts).alias("last_ts"),
        F.max_by("level", moment).alias("level"),
        F.max_by("_shown", moment).alias("display"),
        F.count(F.lit(1)).alias("messages"),
        in_place(F.when(of_radar & (F.col("_nth") <= k_radar), F.struct((-F.col("_nth")).alias("n"), rate.alias("v")))).alias("breathing"),
    )
    event = F.concat(F.lit("["), F.upper("level"), F.lit("] "), F.col("reason"))
    events = latest(alerts, k_events, keys, ts, seq).groupBy(*keys).agg(in_place(F.struct(F.col("nth").alias("n"), event.alias("v"))).alias("events"))
    return board.join(events, list(keys), "left").withColumn("events", F.coalesce("events", F.array().cast("array<string>")))


def latest_per_topic(raw: DataFrame, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """The latest payload of each topic."""
    moment = F.struct(ts, *seq)
    return raw.groupBy(*keys, "topic").agg(F.max_by("payload", moment).alias("payload"), F.max(ts).alias("last_ts"))


def with_personal(df: DataFrame, series: DataFrame, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """df with personal, the baseline after each row, from personal_baseline_series()."""
    names = [c for c in series.columns if c not in (*keys, ts, *seq)]
    return df.join(series.select(*keys, ts, *seq, F.struct(*names).alias("personal")), [*keys, ts, *seq], "left")

