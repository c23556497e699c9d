"""The overnight report: one row per device and night over the raw log."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import above, yes
from . import folds
from .baseline import in_parts, measures, states_after, states_before, sums_of, told
from .timeline import episodes, latest, ordered

KEYS = ("device_id", "night_id")
GAP_S, EXIT_MIN_S, MOVE_MIN_S, MOVE_MERGE_S = 5.0, 30.0, 3.0, 10.0
RATE_LOW, RATE_HIGH = 5.0, 60.0


def night_of(ts: Column, tz: str = "UTC") -> Column:
    """The night that epoch seconds belong to: the local date twelve hours before, so a night runs from noon to noon."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(ts - 43200.0), tz))


def collection_gaps(radar: DataFrame, gap_s: float = GAP_S, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """Keys, gap_start, gap_end and gap_s of the times between two readings that are longer than gap_s."""
    before = F.lag(ts).over(ordered(keys, ts, seq))
    gaps = radar.withColumn("gap_start", before).where(F.col(ts) - F.col("gap_start") > gap_s)
    return gaps.select(*keys, "gap_start", F.col(ts).alias("gap_end"), (F.col(ts) - F.col("gap_start")).alias("gap_s"))


def coverage(radar: DataFrame, gap_s: float = GAP_S, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """rows, start_ts, end_ts, gaps, gap_total_s and coverage (1 less the gaps' share of the span; 0 without a span)."""
    step = F.col(ts) - F.lag(ts).over(ordered(keys, ts, seq))
    out = radar.withColumn("_step", step).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.sum((F.col("_step") > gap_s).cast("long")).alias("gaps"),
        F.sum(F.when(F.col("_step") > gap_s, F.col("_step"))).alias("gap_total_s"),
    )
    out = out.withColumns({"gaps": F.coalesce("gaps", F.lit(0)), "gap_total_s": F.coalesce("gap_total_s", F.lit(0.0))})
    span = F.col("end_ts") - F.col("start_ts")
    return out.withColumn("coverage", F.when(span > 0, 1 - F.col("gap_total_s") / span).otherwise(0.0))


def presence_stats(radar: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return radar.groupBy(*keys).agg(F.avg(yes(F.col("presence")).cast("double")).alias("presence_ratio"))


def exit_episodes(radar: DataFrame, min_len_s: float = EXIT_MIN_S, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """Stretches without presence of at least min_len_s; they are not merged."""
    return episodes(radar, ~yes(F.col("presence")), keys, min_len_s, 0.0, ts, seq)


def movement_episodes(radar: DataFrame, min_len_s: float = MOVE_MIN_S, merge_gap_s: float = MOVE_MERGE_S, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",)) -> DataFrame:
    moving = yes(F.col("motion")) | above(F.coalesce("movement", F.lit(0.0)), 0.5)
    return episodes(radar, moving, keys, min_len_s, merge_gap_s, ts, seq)


def breathing_distribution(radar: DataFrame, keys: Sequence[str] = KEYS, least: int = 10) -> DataFrame:
    """samples, median, p10 and p90 of the breathing rates of sleep: present, still, RATE_LOW to RATE_HIGH.

    p10 and p90 are exclusive quantiles: the place is (n + 1) / 10 and 9 (n + 1) / 10, between neighbours in
    proportion. With fewer than least samples they are null.
    """
    rate = F.coalesce("breathing_rate", F.lit(0.0))
    asleep = radar.where(yes(F.col("presence")) & ~yes(F.col("motion")) & (rate >= RATE_LOW) & (rate <= RATE_HIGH)).withColumn("_x", rate)
    w = Window.partitionBy(*keys)
    placed = asleep.withColumns({"_i": F.row_number().over(w.orderBy("_x")), "_n": F.count(F.lit(1)).over(w)})

    def quantile(i: int) -> Column:
        # whole numbers: place i * (n + 1) / 10 cut to 1 .. n - 1
        j = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * i + i) / 10, F.col("_n") - 1)).cast("long")
        share = (F.lit(float(i)) * (F.col("_n") + 1) - j * 10) / 10
        return F.sum(F.when(F.col("_i") == j, F.col("_x") * (1 - share)).when(F.col("_i") == j + 1, F.col("_x") * share))

    return placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        *(F.when(F.count(F.lit(1)) >= least, e).alias(name) for name, e in (("median", F.median("_x")), ("p10", quantile(1)), ("p90", quantile(9)))),
    )


def night_alerts(alerts: DataFrame, limit: int = 20, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """The first `limit` alerts of each night, with nth from 1 and how many there are of all and of the same level."""
    w = Window.partitionBy(*keys)
    counted = alerts.withColumns({"total": F.count(F.lit(1)).over(w), "level_total": F.count(F.lit(1)).over(Window.partitionBy(*keys, "level"))})
    return latest(counted, limit, keys, ts, seq, first=True).select(*keys, ts, *seq, "nth", "level", "reason", "total", "level_total")


def sleep_state_share(states: DataFrame, state: str = "sleep_state", keys: Sequence[str] = KEYS) -> DataFrame:
    counts = states.where(F.col(state).isNotNull()).groupBy(*keys, state).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(*keys)))


def baseline_convergence(series: DataFrame, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",)) -> DataFrame:
    """The first, middle (place n // 2 from 0) and last row that has a normal range; one row may be two or all of them."""
    w = Window.partitionBy(*keys)
    known = series.where(F.col("bpm_low").isNotNull())
    known = known.withColumns({"_i": F.row_number().over(w.orderBy(ts, *seq)) - 1, "_n": F.count(F.lit(1)).over(w)})
    stages = F.filter(
        F.array(F.when(F.col("_i") == 0, "1_first"), F.when(F.col("_i") == F.floor(F.col("_n") / 2), "2_middle"), F.when(F.col("_i") == F.col("_n") - 1, "3_last")),
        lambda x: x.isNotNull(),
    )
    return known.withColumn("stage", F.explode(stages)).drop("_i", "_n")


def night_header(radar: DataFrame, keys: Sequence[str] = KEYS, ts: str = "t") -> DataFrame:
    source = F.coalesce(F.col("source"), F.lit("?"))
    return radar.groupBy(*keys).agg(F.array_sort(F.collect_set(source)).alias("sources"), ((F.max(ts) - F.min(ts)) / 3600).alias("span_h"), F.count(F.lit(1)).alias("rows"))


#: How many gaps, movements and alerts a report lists; exits are all listed.
LISTED_GAPS, LISTED_MOVES, LISTED_ALERTS = 10, 30, 20


def night_report(radar: DataFrame, alerts: DataFrame | None = None, states: DataFrame | None = None, series: DataFrame | None = None, min_rows: int = 10, keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",), baseline_alpha: float | None = None, **limits: float) -> DataFrame:
    """One wide row per night with at least min_rows radar rows. limits: gap_s, exit_min_s, move_min_s, move_merge_s.

    Beside totals it lists, with their times, the first gaps (gap_list), all exits (exit_list), the first movements (move_list) and, given
    alerts, the first of them with their reasons (alert_list). alerts also give how many there were of each level, states the share of each
    sleep state. normal_range is the normal range of the personal baseline at first, in the middle and at last, with its time and
    samples: of series, or, with baseline_alpha, of a baseline that starts anew each night. Nights without any have 0, empty lists or null.

    radar is dealt out by keys once: a night becomes one array in order, and everything is told from it. The parts that are
    joined have one row per night.
    """
    gap_s, exit_min = limits.get("gap_s", GAP_S), limits.get("exit_min_s", EXIT_MIN_S)
    move_min, move_merge = limits.get("move_min_s", MOVE_MIN_S), limits.get("move_merge_s", MOVE_MERGE_S)
    on = list(keys)
    rate, present = F.coalesce("breathing_rate", F.lit(0.0)), yes(F.col("presence"))
    asleep = present & ~yes(F.col("motion")) & (rate >= RATE_LOW) & (rate <= RATE_HIGH)
    moving = yes(F.col("motion")) | above(F.coalesce("movement", F.lit(0.0)), 0.5)
    row = F.struct(F.col(ts).alias("t"), *seq, present.alias("here"), moving.alias("moving"), F.when(asleep, rate).alias("rate"), *measures(F.col("breathing_rate"), F.col("movement")))
    nights = radar.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.array_sort(F.collect_set(F.coalesce("source", F.lit("?")))).alias("sources"))
    rows = F.col("_rows")
    nights = nights.where(F.size(rows) >= min_rows).withColumns({
        "_gaps": folds.gaps(rows, gap_s),
        "exit_list": folds.lasting(folds.stretches(rows, lambda r: ~r["here"]), exit_min),
        "_spans": folds.stretches(rows, lambda r: r["moving"]),
        "_rates": F.array_sort(F.filter(F.transform(rows, lambda r: r["rate"]), lambda x: x.isNotNull())),
    })
    nights = nights.withColumn("_moves", folds.lasting(folds.merged(F.col("_spans"), move_merge) if move_merge else F.col("_spans"), move_min))
    if baseline_alpha:
        nights = nights.withColumn("_known", _known(rows, baseline_alpha))
    start, end = F.element_at(rows, 1)["t"], F.element_at(rows, -1)["t"]
    enough = lambda value: F.when(F.size("_rates") >= 10, value)
    missing = folds.total(F.col("_gaps"))
    out = nights.select(
        *keys,
        F.size(rows).cast("long").alias("rows"),
        start.alias("start_ts"),
        end.alias("end_ts"),
        F.size("_gaps").cast("long").alias("gaps"),
        missing.alias("gap_total_s"),
        F.when(end > start, 1 - missing / (end - start)).otherwise(0.0).alias("coverage"),
        "sources",
        ((end - start) / 3600).alias("span_h"),
        (F.size(F.filter(rows, lambda r: r["here"])) / F.size(rows)).alias("presence_ratio"),
        F.size("exit_list").cast("long").alias("exits"),
        folds.total(F.col("exit_list")).alias("exit_s"),
        F.size("_moves").cast("long").alias("movements"),
        folds.total(F.col("_moves")).alias("movement_s"),
        F.size("_rates").cast("long").alias("samples"),
        enough(folds.middle(F.col("_rates"))).alias("median"),
        enough(folds.quantile(F.col("_rates"), 1)).alias("p10"),
        enough(folds.quantile(F.col("_rates"), 9)).alias("p90"),
        F.slice("_gaps", 1, LISTED_GAPS).alias("gap_list"),
        "exit_list",
        F.slice("_moves", 1, LISTED_MOVES).alias("move_list"),
        *([_normal_range(F.col("_known")).alias("normal_range")] if baseline_alpha else []),
    )
    if alerts is not None:
        listed = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), *seq, "level", "reason")))
        sent = alerts.groupBy(*keys).agg(listed.alias("_sent"))
        of_level = F.transform(F.array_distinct(F.transform("_sent", lambda a: a["level"])), lambda level: F.concat_ws(" ", F.size(F.filter("_sent", lambda a: a["level"] == level)).cast("string"), level))
        first = F.transform(F.slice("_sent", 1, LISTED_ALERTS), lambda a: F.struct(a["t"].alias("t"), a["level"].alias("level"), a["reason"].alias("reason")))
        out = out.join(sent.select(*keys, F.size("_sent").cast("long").alias("alerts"), F.array_join(F.array_sort(of_level), ", ").alias("alert_levels"), first.alias("alert_list")), on, "left")
    if states is not None:
        share = sleep_state_share(states, keys=keys)
        out = out.join(share.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sleep_state", "share")))).alias("sleep_share")), on, "left")
    if series is not None and not baseline_alpha:
        stages = baseline_convergence(series, keys, ts, seq).groupBy(*keys)
        stage = F.struct("bpm_low", "bpm_high", F.col(ts).alias("t"), F.col("samples").cast("long").alias("samples"))
        out = out.join(stages.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", stage)))).alias("normal_range")), on, "left")
    return out.fillna(0, [c for c in ("alerts",) if c in out.columns])


def _known(rows: Column, alpha: float) -> Column:
    """The rows of a night from its first breath on, with the baseline after each."""
    parts = in_parts(rows)
    after = states_after(parts, states_before(sums_of(parts, alpha)), alpha)
    return F.filter(after, lambda r: r["state"]["mean"].isNotNull())


def _normal_range(known: Column, k: float = 2.0) -> Column:
    """By stage (1_first, 2_middle, 3_last) the normal range of a baseline, its time and samples; null without a breath. known is a column, so it is told once."""

    def at(place: Column) -> Column:
        r = F.get(known, place)
        samples, _, low, high, _ = told(r["state"], k)
        return F.struct(low, high, r["row"]["t"].alias("t"), samples)

    stages = {"1_first": F.lit(0), "2_middle": F.floor(F.size(known) / 2).cast("int"), "3_last": F.size(known) - 1}
    return F.when(F.size(known) > 0, F.map_from_entries(F.array(*(F.struct(F.lit(name), at(place)) for name, place in stages.items()))))


def report_text(report: DataFrame) -> DataFrame:
    """report with `text`, the morning report in Markdown. Parts that the report has no column for are left out."""
    clock = lambda c: F.date_format(F.timestamp_seconds(c), "HH:mm:ss")
    # rounds halves up and keeps the sign of what rounds to zero; round() would lose it
    rounded = lambda c, n: F.format_string(f"%.{n}f", c.cast("double"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    span = lambda s, value, n, unit: F.concat(clock(s["start"]), F.lit(" to "), clock(s["end"]), F.lit(" ("), rounded(value, n), F.lit(f" {unit})"))

    def listed(name: str, line: Callable[[Column], Column]) -> Column:
        """A line for each element, none for an empty list."""
        return F.when(F.size(name) > 0, F.array_join(F.transform(name, lambda x: F.concat(F.lit("  - "), line(x))), "\n"))

    lines = [
        text("# Night report ", F.concat_ws(" / ", *(F.col(k).cast("string") for k in KEYS if k in report.columns))),
        text("- span: ", clock(F.col("start_ts")), " to ", clock(F.col("end_ts")), " (", rounded(F.col("span_h"), 1), " h), ", F.col("rows"), " radar rows"),
        text("- sources: ", F.array_join("sources", ", ")),
        text("- coverage ", rounded(F.col("coverage") * 100, 2), "% (", F.col("gaps"), " gaps, ", rounded(F.col("gap_total_s"), 0), " s)"),
        listed("gap_list", lambda g: span(g, g["seconds"], 0, "s")),
        text("- presence ", rounded(F.col("presence_ratio") * 100, 1), "%, ", F.col("exits"), " exits (", rounded(F.col("exit_s"), 0), " s)"),
        listed("exit_list", lambda e: span(e, e["seconds"] / 60, 1, "min")),
        F.when(F.col("median").isNotNull(), text("- breathing ", rounded(F.col("median"), 1), " /min (p10 ", rounded(F.col("p10"), 1), ", p90 ", rounded(F.col("p90"), 1), ", ", F.col("samples"), " samples)")).otherwise(
            text("- too few breathing samples (", F.col("samples"), ")")
        ),
        text("- ", F.col("movements"), " movement episodes"),
        listed("move_list", lambda e: span(e, e["seconds"], 0, "s")),
    ]
    if "alerts" in report.columns:
        lines.append(F.when(F.col("alerts") > 0, text("- ", F.col("alerts"), " alerts: ", F.col("alert_levels"))).otherwise("- no alerts"))
        lines.append(listed("alert_list", lambda a: F.concat(clock(a["t"]), F.lit(" ["), a["level"], F.lit("] "), a["reason"])))
    if "sleep_share" in report.columns:
        shares = F.transform(F.map_entries("sleep_share"), lambda e: F.concat(e["key"], F.lit(" "), rounded(e["value"] * 100, 1), F.lit("%")))
        lines.append(F.when(F.col("sleep_share").isNotNull(), text("- sleep: ", F.array_join(shares, ", "))))
    if "normal_range" in report.columns:
        ranges = F.transform(F.map_values("normal_range"), lambda e: F.concat(rounded(e["bpm_low"], 1), F.lit(" to "), rounded(e["bpm_high"], 1), F.lit(" ("), clock(e["t"]), F.lit(", "), e["samples"].cast("string"), F.lit(" samples)")))
        lines.append(F.when(F.col("normal_range").isNotNull(), text("- normal breathing: ", F.array_join(ranges, ", then "))))
    lines.append(F.lit("> A functional summary, not a medical finding."))
    return report.withColumn("text", F.concat_ws("\n", *lines))
