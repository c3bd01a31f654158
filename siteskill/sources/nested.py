"""Nested series (one row holds an array of rows) and struct columns.

The flat long table is the working form. Nesting happens at the edge, and one nested row holds one
site and calendar year, so that no row grows with the length of a series.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest_series(
    df: DataFrame, columns: Sequence[str], key: str = "sitename", order: str = "date", into: str = "data"
) -> DataFrame:
    """One row per (site, year); `into` is the array of rows, sorted by the order column."""
    row = F.struct(order, *[c for c in columns if c != order])
    return df.groupBy(key, F.year(order).alias("chunk_year")).agg(F.sort_array(F.collect_list(row)).alias(into))


def unnest_series(nested: DataFrame, column: str = "data", key: str = "sitename") -> DataFrame:
    """Back to flat rows. Sites with an empty or null series vanish."""
    return nested.select(key, F.inline(column))


def map_series(nested: DataFrame, fn: Callable[[Column], Column], column: str = "data") -> DataFrame:
    """Apply an array expression to each nested series without flattening it."""
    return nested.withColumn(column, fn(F.col(column)))


def non_empty(nested: DataFrame, column: str = "data") -> DataFrame:
    """Rows that hold a series of one row or more."""
    return nested.where(F.size(column) > 0)


def spread_struct(df: DataFrame, column: str) -> DataFrame:
    """Replace a struct column by its fields."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, f"{column}.*")


def set_fields(df: DataFrame, column: str, fields: Mapping[str, Column]) -> DataFrame:
    """Add or override fields of a struct column."""
    changed = F.col(column)
    for name, value in fields.items():
        changed = changed.withField(name, value)
    return df.withColumn(column, changed)


def pivot_sources(df: DataFrame, ids: Sequence[str], columns: Sequence[str], value: str, source: str = "source") -> DataFrame:
    """Wide to long: one row per id and source column."""
    return df.unpivot(list(ids), list(columns), source, value)


def stack_tables(tables: Mapping[str, DataFrame], label: str = "level") -> DataFrame:
    """Union of tables with a label column; a column that a table lacks is null there."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(label, *[c for c in out.columns if c != label])
