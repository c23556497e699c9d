"""Runs, episodes, onsets and as-of fills over keyed, time-ordered rows.

Every function takes the key columns; rows are ordered by `ts` and then by the tie-breakers in `seq`.
All windows have the same keys and order, so one exchange and one sort serve them together.
Without keys a window would put all rows in one task, so keys are required.

A key's rows are in one task, unless chunk_s is given: then they are dealt out by chunks of so many seconds (chunks.py), with the same
results. Keys with a night need no chunks; devices that report for years, or one that sends a third of all rows, do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import chunks


def ordered(keys: Sequence[str], ts: str = "t", seq: Sequence[str] = ()) -> WindowSpec:
    if not keys:
        raise ValueError("keys are required: a window without them puts all rows in one task")
    return Window.partitionBy(*keys).orderBy(ts, *seq)


def up_to_now(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_runs(df: DataFrame, value: Column, keys: Sequence[str], ts: str = "t", seq: Sequence[str] = (), name: str = "run", chunk_s: float | None = None) -> DataFrame:
    """df with the number of each row's run: rows in a row whose value is the same (nulls equal each other)."""
    w = ordered(keys, ts, seq)
    if chunk_s:
        return chunks.segments(df, F.struct(value.alias("v")), lambda a, b: ~a["v"].eqNullSafe(b["v"]), keys, ts, seq, chunk_s, name)
    marked = df.withColumn("_value", value).withColumn("_n", F.row_number().over(w))
    new = (F.col("_n") == 1) | ~F.col("_value").eqNullSafe(F.lag("_value").over(w))
    return marked.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(up_to_now(w))).drop("_value", "_new", "_n")


def with_parts(df: DataFrame, value: Column, starts: Callable[[Column, Column], Column], keys: Sequence[str], ts: str = "t", seq: Sequence[str] = (), name: str = "part", chunk_s: float | None = None) -> DataFrame:
    """df with the number of each row's part: one starts at a key's first row and where starts(value before, value) holds. value is a struct."""
    w = ordered(keys, ts, seq)
    if chunk_s:
        return chunks.segments(df, value, starts, keys, ts, seq, chunk_s, name)
    before = df.withColumn("_value", value).withColumn("_before", F.lag("_value").over(w))
    new = F.col("_before").isNull() | F.coalesce(starts(F.col("_before"), F.col("_value")), F.lit(False))
    return before.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(up_to_now(w))).drop("_value", "_before", "_new")


def episodes(df: DataFrame, flag: Column, keys: Sequence[str], min_len: float = 0.0, merge_gap: float = 0.0, ts: str = "t", seq: Sequence[str] = (), chunk_s: float | None = None) -> DataFrame:
    """Keys, start_ts, end_ts and duration_s of the longest stretches where flag holds.

    A stretch ends at its last true row, not at the false one after it; an open one ends at the
    last row. Stretches at most merge_gap apart are put together first (merge_gap 0: none are), then
    those shorter than min_len are left out. A null flag is false.
    """
    runs = with_runs(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), F.col("_flag"), keys, ts, seq, "_run", chunk_s)
    found = runs.where("_flag").groupBy(*keys, "_run").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
    if merge_gap:
        far = lambda a, b: b["start_ts"] - a["end_ts"] > merge_gap
        found = with_parts(found, F.struct("start_ts", "end_ts"), far, keys, "start_ts", ["_run"], "_part", chunk_s)
        found = found.groupBy(*keys, "_part").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    found = found.withColumn("duration_s", F.col("end_ts") - F.col("start_ts"))
    return found.where(F.col("duration_s") >= min_len).select(*keys, "start_ts", "end_ts", "duration_s")


def with_onset(df: DataFrame, flag: Column, keys: Sequence[str], ts: str = "t", seq: Sequence[str] = (), name: str = "onset", chunk_s: float | None = None) -> DataFrame:
    """df with name: flag holds here and didn't in the row before (before the first row it doesn't)."""
    marked = df.withColumn("_on", F.coalesce(flag, F.lit(False)))
    if chunk_s:
        before = chunks.neighbour(marked, F.col("_on"), keys, ts, seq, chunk_s, "_was")
    else:
        before = marked.withColumn("_was", F.lag("_on").over(ordered(keys, ts, seq)))
    return before.withColumn(name, F.col("_on") & ~F.coalesce("_was", F.lit(False))).drop("_on", "_was")


def count_onsets(df: DataFrame, flag: Column, keys: Sequence[str], ts: str = "t", seq: Sequence[str] = (), name: str = "events", chunk_s: float | None = None) -> DataFrame:
    return with_onset(df, flag, keys, ts, seq, "_onset", chunk_s).groupBy(*keys).agg(F.sum(F.col("_onset").cast("long")).alias(name))


def longest_run(df: DataFrame, condition: Column, keys: Sequence[str], ts: str = "t", seq: Sequence[str] = (), name: str = "longest", chunk_s: float | None = None) -> DataFrame:
    """Per key, the number of rows of the longest stretch where condition holds; 0 if there is none."""
    runs = with_runs(df.withColumn("_calm", F.coalesce(condition, F.lit(False))), F.col("_calm"), keys, ts, seq, "_run", chunk_s)
    sizes = runs.groupBy(*keys, "_run").agg(F.sum(F.col("_calm").cast("long")).alias("_size"))
    return sizes.groupBy(*keys).agg(F.max("_size").alias(name))


def filled(df: DataFrame, columns: Sequence[str], keys: Sequence[str], ts: str = "t", seq: Sequence[str] = (), chunk_s: float | None = None) -> DataFrame:
    """df with each of columns replaced by its latest value so far that isn't null."""
    if chunk_s:
        return chunks.filled(df, columns, keys, ts, seq, chunk_s)
    w = up_to_now(ordered(keys, ts, seq))
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def place(df: DataFrame, keys: Sequence[str], ts: str = "t", seq: Sequence[str] = (), name: str = "place", chunk_s: float | None = None) -> DataFrame:
    """df with the place of each row of a key, from 0."""
    if chunk_s:
        return chunks.running_sum(df, F.lit(1), keys, ts, seq, chunk_s, name).withColumn(name, F.col(name) - 1)
    return df.withColumn(name, F.row_number().over(ordered(keys, ts, seq)) - 1)


def latest(df: DataFrame, k: int, keys: Sequence[str], ts: str = "t", seq: Sequence[str] = (), first: bool = False) -> DataFrame:
    """The last (or first) k rows of each key, with `nth` from 1 on."""
    order = [F.asc(c) if first else F.desc(c) for c in (ts, *seq)]
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= k)
