"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def field(df: DataFrame, group: str, name: str, kind: str = "double") -> Column:
    """A field of a struct column; null where the struct is null, lacks the field or isn't there at all."""
    if group in df.columns and isinstance(df.schema[group].dataType, StructType) and name in df.schema[group].dataType.names:
        return F.col(group)[name].cast(kind)
    return F.lit(None).cast(kind)


def has(df: DataFrame, group: str) -> Column:
    return F.col(group).isNotNull() if group in df.columns else F.lit(False)


def above(x: Column, limit: Column | float) -> Column:
    """x > limit, false for null and for NaN, which Spark orders above all numbers."""
    return F.coalesce((x > limit) & ~F.isnan(x), F.lit(False))


def at_least(x: Column, limit: Column | float) -> Column:
    return F.coalesce((x >= limit) & ~F.isnan(x), F.lit(False))


def yes(x: Column) -> Column:
    """x, null counted as false."""
    return F.coalesce(x, F.lit(False))


def present(*items: Column) -> Column:
    """An array of the items that aren't null, in this order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())
