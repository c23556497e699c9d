"""Episodes, gaps and quantiles of a night that is one array: built-in functions over rows in order, each in one pass.

A night has at most a row a second, so its array is bounded; for keys without a night use timeline.py with chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _near(rows: Column, i: Column, by: int) -> Column:
    """The element `by` places after the one with index i (from 0), null beyond the ends."""
    return F.get(rows, i + by)


def gaps(rows: Column, gap_s: float, ts: str = "t") -> Column:
    """(start, end, seconds) of the times between neighbours that are longer than gap_s."""
    n = F.greatest(F.size(rows) - 1, F.lit(0))
    steps = F.zip_with(F.slice(rows, 1, n), F.slice(rows, 2, n), lambda a, b: F.struct(a[ts].alias("start"), b[ts].alias("end"), (b[ts] - a[ts]).alias("seconds")))
    return F.filter(steps, lambda s: s["seconds"] > gap_s)


def stretches(rows: Column, flag: Callable[[Column], Column], ts: str = "t") -> Column:
    """(start, end) of each longest stretch of rows for which flag, never null, holds."""
    on = lambda r: F.coalesce(flag(r), F.lit(False))
    first = F.filter(rows, lambda r, i: on(r) & ~on(_near(rows, i, -1)))
    last = F.filter(rows, lambda r, i: on(r) & ~on(_near(rows, i, 1)))
    return F.zip_with(first, last, lambda a, b: F.struct(a[ts].alias("start"), b[ts].alias("end")))


def merged(spans: Column, gap_s: float) -> Column:
    """Spans at most gap_s apart put together."""
    apart = lambda a, b: F.coalesce(b["start"] - a["end"] > gap_s, F.lit(True))
    first = F.filter(spans, lambda s, i: apart(_near(spans, i, -1), s))
    last = F.filter(spans, lambda s, i: apart(s, _near(spans, i, 1)))
    return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def lasting(spans: Column, least_s: float) -> Column:
    """(start, end, seconds) of the spans that last at least least_s."""
    timed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (s["end"] - s["start"]).alias("seconds")))
    return F.filter(timed, lambda s: s["seconds"] >= least_s)


def total(spans: Column, field: str = "seconds") -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda a, s: a + s[field])


def quantile(values: Column, tenths: int) -> Column:
    """The exclusive quantile of sorted values: place tenths * (n + 1) / 10, cut to 1 .. n - 1, between neighbours in proportion."""
    n = F.size(values)
    j = F.greatest(F.lit(1), F.least(F.floor((n + 1) * tenths / 10), n - 1)).cast("int")
    share = (F.lit(float(tenths)) * (n + 1) - j * 10) / 10
    return F.element_at(values, j) * (1 - share) + F.element_at(values, j + 1) * share


def middle(values: Column) -> Column:
    """The median of sorted values."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2
