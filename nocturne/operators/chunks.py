"""Scans over keys of any length: a key's rows are dealt out by chunks of time.

A window over a key puts all its rows into one task. Here each chunk (chunk_s seconds of a key) is summed up by itself, the
summaries of a key, one small row a chunk, are carried over its chunks, and what a chunk needs from before comes to it as one more
row in front (or behind). No task holds more rows of a key than a chunk has, and results are the same for every chunk_s.
Nulls in keys are a key like any other; rows that are equal in ts and seq are put in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

CHUNK = "_chunk"


def in_chunks(df: DataFrame, chunk_s: float, ts: str = "t") -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(ts) / chunk_s).cast("long"))


def _carried(df: DataFrame, carry: DataFrame, own: str) -> DataFrame:
    """The rows of df and of carry, told apart by own: true for those of df."""
    return df.withColumn(own, F.lit(True)).unionByName(carry.withColumn(own, F.lit(False)), allowMissingColumns=True)


def filled(df: DataFrame, columns: Sequence[str], keys: Sequence[str], ts: str, seq: Sequence[str], chunk_s: float) -> DataFrame:
    """df with each of columns replaced by its latest value so far that isn't null."""
    rows, moment = in_chunks(df, chunk_s, ts), F.struct(ts, *seq)
    ends = rows.groupBy(*keys, CHUNK).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), moment)).alias(c) for c in columns))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, CHUNK, *(F.last(c, ignorenulls=True).over(before).alias(c) for c in columns))
    now = Window.partitionBy(*keys, CHUNK).orderBy("_own", ts, *seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _carried(rows, carry, "_own").withColumns({c: F.last(c, ignorenulls=True).over(now) for c in columns}).where("_own").select(*df.columns)


def filled_until(df: DataFrame, columns: Sequence[str], keys: Sequence[str], ts: str, chunk_s: float, name: str) -> DataFrame:
    """df with each of columns replaced by its latest value up to the row's moment that isn't null, and name: the moment of the row after, null for the last one.

    Rows of one moment see each other; name is theirs, but for the last of them.
    """
    rows = in_chunks(df, chunk_s, ts)
    ends = rows.groupBy(*keys, CHUNK).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in columns), F.min(ts).alias(name))
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, CHUNK, *(F.last(c, ignorenulls=True).over(before).alias(c) for c in columns), F.lead(name).over(chunks).alias(name))
    inside = Window.partitionBy(*keys, CHUNK).orderBy("_own", ts)
    now = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    told = {c: F.last(c, ignorenulls=True).over(now) for c in columns} | {name: F.coalesce(F.lead(ts).over(inside), F.last(name, ignorenulls=True).over(now))}
    return _carried(rows, carry, "_own").withColumns(told).where("_own").select(*df.columns, name)


def neighbour(df: DataFrame, value: Column, keys: Sequence[str], ts: str, seq: Sequence[str], chunk_s: float, name: str, ahead: bool = False) -> DataFrame:
    """df with name: value of the row before (or, ahead, of the row after), null where there is none. value must not be null itself; a struct isn't."""
    rows, moment = in_chunks(df.withColumn(name, value), chunk_s, ts), F.struct(ts, *seq)
    end = (F.min_by if ahead else F.max_by)(name, moment)
    chunks = Window.partitionBy(*keys).orderBy(F.desc(CHUNK) if ahead else F.asc(CHUNK))
    carry = rows.groupBy(*keys, CHUNK).agg(end.alias(name)).withColumn(name, F.lag(name).over(chunks))
    order = [F.desc(c) if ahead else F.asc(c) for c in (ts, *seq)]
    now = Window.partitionBy(*keys, CHUNK).orderBy("_own", *order)
    return _carried(rows, carry, "_own").withColumn(name, F.lag(name).over(now)).where("_own").select(*(c for c in df.columns if c != name), name)


def running_sum(df: DataFrame, value: Column, keys: Sequence[str], ts: str, seq: Sequence[str], chunk_s: float, name: str) -> DataFrame:
    """df with name: the sum of the whole numbers value up to each row."""
    rows = in_chunks(df.withColumn(name, value.cast("long")), chunk_s, ts)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, CHUNK).agg(F.sum(name).alias(name)).withColumn(name, F.sum(name).over(before))
    now = Window.partitionBy(*keys, CHUNK).orderBy("_own", ts, *seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _carried(rows, carry, "_own").withColumn(name, F.sum(name).over(now)).where("_own").select(*(c for c in df.columns if c != name), name)


def segments(df: DataFrame, value: Column, starts: Callable[[Column, Column], Column], keys: Sequence[str], ts: str, seq: Sequence[str], chunk_s: float, name: str) -> DataFrame:
    """df with the number of each row's segment, from 1: a segment starts at a key's first row, and where starts(value before, value) holds.

    A chunk's summary is its first and last value and how many segments start inside it; whether one starts at
    its first row follows from the last value of the chunk before. value must not be null itself; a struct isn't.
    """
    rows, moment = in_chunks(df.withColumn("_v", value), chunk_s, ts), F.struct(ts, *seq)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(ts, *seq)
    new = F.coalesce(starts(F.lag("_v").over(inside), F.col("_v")), F.lit(False)) & F.lag("_v").over(inside).isNotNull()
    rows = rows.withColumn("_new", new.cast("long"))
    rows = rows.withColumn(name, F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = rows.groupBy(*keys, CHUNK).agg(F.min_by("_v", moment).alias("_a"), F.max_by("_v", moment).alias("_z"), F.sum("_new").alias("_n"))
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    last = F.lag("_z").over(chunks)
    sums = sums.withColumn("_starts", F.when(last.isNull() | F.coalesce(starts(last, F.col("_a")), F.lit(False)), 1).otherwise(0))
    so_far = F.sum(F.col("_n") + F.col("_starts")).over(chunks.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = sums.select(*keys, CHUNK, (so_far - F.col("_n")).alias("_before"))
    both = _carried(rows.drop("_v", "_new"), carry, "_own")
    return both.withColumn(name, F.col(name) + F.max("_before").over(Window.partitionBy(*keys, CHUNK))).where("_own").select(*(c for c in df.columns if c != name), name)


def place_in_run(df: DataFrame, run: str, keys: Sequence[str], ts: str, seq: Sequence[str], chunk_s: float, name: str) -> DataFrame:
    """df with name: the number of each row in its run, from 1; a run may go on for any number of chunks."""
    rows = in_chunks(df, chunk_s, ts)
    counts = rows.groupBy(*keys, run, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys, run).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*keys, run, CHUNK, F.sum("_n").over(before).alias("_before"))
    part = Window.partitionBy(*keys, CHUNK, run)
    nth = F.row_number().over(part.orderBy("_own", ts, *seq)) - 1 + F.coalesce(F.max("_before").over(part), F.lit(0))
    return _carried(rows, carry, "_own").withColumn(name, nth).where("_own").select(*(c for c in df.columns if c != name), name)
