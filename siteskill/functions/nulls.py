"""Strict and null-skipping aggregates.

Spark's aggregates skip nulls. A strict aggregate gives null as soon as one input is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every float column; do this once where data comes in."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def finite(c: str | Column) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    x = _col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _if_complete(c: Column, value: Column) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), value)


def strict_mean(c: str | Column) -> Column:
    x = _col(c)
    return _if_complete(x, F.avg(x))


def strict_sum(c: str | Column) -> Column:
    x = _col(c)
    return _if_complete(x, F.sum(x))


def skip_sum(c: str | Column) -> Column:
    """Sum of the non-null values; nothing to add gives 0."""
    return F.coalesce(F.sum(_col(c)), F.lit(0.0))


def not_true(c: str | Column) -> Column:
    """True for false and for null."""
    return ~F.coalesce(_col(c), F.lit(False))


def not_in(c: str | Column, values: list) -> Column:
    """Negated membership that keeps null rows."""
    return ~F.coalesce(_col(c).isin(values), F.lit(False))
