"""Episodes against a diary, how long recommendations take to clear, and nights under two conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rhythm import STATES
from .timeline import episodes

KEYS = ("device_id",)


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, least_s: float = 0.0, bucket_s: float = 3600.0) -> DataFrame:
    """The pairs of intervals [start_ts, end_ts] of two tables that overlap by more than least_s: keys, all columns of left, those of right
    after `other_`, and overlap_s. Each pair comes once.

    Intervals meet in buckets of time, each in all buckets that it touches; a pair counts in the bucket in which the later of the two
    starts, where both are. So neither side has to be small, and no pair needs to be told apart from its copies. Null keys and ends overlap
    nothing. Choose bucket_s near the length of the longer intervals.
    """
    names = [c for c in right.columns if c not in keys]
    of = lambda t: F.floor(t / bucket_s).cast("long")
    spread = lambda df, a, b: df.where(F.col(a) <= F.col(b)).withColumn("_bucket", F.explode(F.sequence(of(F.col(a)), of(F.col(b)))))
    other = right.select(*keys, *(F.col(c).alias(f"other_{c}") for c in names))
    met = spread(left, "start_ts", "end_ts").join(spread(other, "other_start_ts", "other_end_ts"), [*keys, "_bucket"])
    start, end = F.greatest("start_ts", "other_start_ts"), F.least("end_ts", "other_end_ts")
    pairs = met.where(of(start) == F.col("_bucket")).withColumn("overlap_s", end - start).where(F.col("overlap_s") > least_s)
    return pairs.select(*left.columns, *(f"other_{c}" for c in names), "overlap_s")


def diary_agreement(found: DataFrame, diary: DataFrame, keys: Sequence[str] = KEYS, bucket_s: float = 3600.0) -> DataFrame:
    """Per key: diary_entries, matched_entries (that some found episode overlaps), episodes, matched_episodes, and the seconds that overlap.

    Keys that one side alone has are there, with 0 for the other. Entries of one diary don't overlap each other.
    """
    pairs = overlapping(found.select(*keys, "start_ts", "end_ts"), diary.select(*keys, "start_ts", "end_ts"), keys, 0.0, bucket_s)
    hits = pairs.groupBy(*keys).agg(
        F.count_distinct("other_start_ts", "other_end_ts").alias("matched_entries"),
        F.count_distinct("start_ts", "end_ts").alias("matched_episodes"),
        F.sum("overlap_s").alias("overlap_s"),
    )
    sizes = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    out = sizes(diary, "diary_entries").join(sizes(found, "episodes"), list(keys), "full").join(hits, list(keys), "left")
    counts = ("diary_entries", "matched_entries", "episodes", "matched_episodes")
    return out.fillna(0, list(counts)).fillna(0.0, ["overlap_s"]).select(*keys, *counts, "overlap_s")


def action_episodes(states: DataFrame, actions: Sequence[str], keys: Sequence[str] = KEYS, ts: str = "t", seq: Sequence[str] = ("seq",), merge_gap_s: float = 0.0, chunk_s: float | None = None) -> DataFrame:
    """The stretches in which each of actions is recommended: keys, action, start_ts, end_ts and duration_s, the time that it took to clear.

    An action that is no longer recommended has cleared; one that still is at the last row lasts until there. States carry all
    actions of a moment in the array `actions`.
    """
    rows = F.array(*(F.struct(F.lit(a).alias("action"), F.array_contains("actions", a).alias("_on")) for a in actions))
    each = states.select(*keys, ts, *seq, F.inline(rows))
    return episodes(each, F.col("_on"), [*keys, "action"], 0.0, merge_gap_s, ts, seq, chunk_s)


def recovery_times(stretches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per action (and keys) how many stretches there were, and the mean, the median and the longest time until they cleared."""
    return stretches.groupBy(*keys, "action").agg(
        F.count(F.lit(1)).alias("episodes"), F.avg("duration_s").alias("mean_s"), F.median("duration_s").alias("median_s"), F.max("duration_s").alias("longest_s")
    )


def compare_conditions(nightly: DataFrame, nights: DataFrame, keys: Sequence[str] = ("device_id", "night_id"), condition: str = "condition") -> DataFrame:
    """night_rhythm() by the condition that the table nights (keys, condition) gives each night: nights, and the means of awakenings, of the longest calm stretch and of the shares."""
    means = ("awakenings", "longest_calm", *STATES)
    return nightly.join(nights.select(*keys, condition), list(keys)).groupBy(condition).agg(F.count(F.lit(1)).alias("nights"), *(F.avg(c).alias(f"avg_{c}") for c in means))
