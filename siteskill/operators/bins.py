"""Bins in time and along a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import week_start


def break_sequence(first: Column, last: Column, width: int) -> Column:
    """Array of dates from `first` in steps of `width` days, none after `last`."""
    return F.sequence(first, last, F.make_interval(days=F.lit(width)))


def breaks_table(df: DataFrame, width: int, date: str = "date") -> DataFrame:
    """Regular breaks over the span of a table, one row per break."""
    span = df.agg(F.min(date).alias("first"), F.max(date).alias("last"))
    return span.select(F.explode(break_sequence(F.col("first"), F.col("last"), width)).alias("brk"))


def week_breaks(df: DataFrame, date: str = "date") -> DataFrame:
    """Week starts that occur in the data, without the first one.

    One scan: the set of weeks is as small as the calendar, on the map side already.
    """
    weeks = df.agg(F.array_sort(F.collect_set(week_start(date))).alias("weeks"))
    return weeks.select(F.explode(F.slice("weeks", 2, F.size("weeks"))).alias("brk"))


def regular_bin(date: Column, first: Column, width: int, last: Column, include_last: bool = False) -> Column:
    """Start of the left-closed bin of `width` days; null outside the breaks.

    Breaks run from `first` in steps of `width` up to `last`. The last break closes the last bin: a
    date on it belongs to that bin only with `include_last`.
    """
    steps = F.floor(F.datediff(last, first) / F.lit(width)).cast("int")
    step = F.floor(F.datediff(date, first) / F.lit(width)).cast("int")
    step = F.when(F.lit(include_last) & (F.datediff(date, first) == steps * F.lit(width)), steps - 1).otherwise(step)
    return F.when((step >= 0) & (step < steps), F.date_add(first, step * F.lit(width)))


def regular_bins(
    df: DataFrame, width: int, first: str | None = None, last: str | None = None, include_last: bool = False, date: str = "date"
) -> DataFrame:
    """Add `inbin` by `regular_bin`. A limit that is not given comes from the data, so that no day is beyond it."""
    limits = bin_limits(df, width, first, last, date).select(F.struct("first", "last")).scalar()
    bin_start = regular_bin(F.col(date), F.col("_limits.first"), width, F.col("_limits.last"), include_last)
    return df.withColumn("_limits", limits).withColumn("inbin", bin_start).drop("_limits")


def bin_limits(df: DataFrame, width: int, first: str | None = None, last: str | None = None, date: str = "date") -> DataFrame:
    """One row `(first, last)`: the given limits, else the first day and a day that the last break still covers."""
    given = [F.lit(x).cast("date") for x in (first, last)]
    return df.agg(
        F.coalesce(given[0], F.min(date)).alias("first"), F.coalesce(given[1], F.date_add(F.max(date), width)).alias("last")
    )


def bin_days(breaks: DataFrame, include_last: bool = False, brk: str = "brk") -> DataFrame:
    """One row `(date, inbin)` per calendar day that lies in a bin.

    Breaks are distinct calendar days, so they fit one array, and the day table is as short as the
    calendar. It turns bin assignment into an equi-join on the date.
    """
    edges = breaks.agg(F.array_sort(F.collect_set(brk)).alias("edges"))
    bins = edges.select(F.size("edges").alias("n"), "edges", F.posexplode("edges")).where(F.col("pos") < F.col("n") - 1)
    upper = F.col("edges")[F.col("pos") + 1]
    is_last = F.lit(include_last) & (F.col("pos") == F.col("n") - 2)
    end = F.when(is_last, upper).otherwise(F.date_sub(upper, 1))
    return bins.select(F.explode(F.sequence("col", end)).alias("date"), F.col("col").alias("inbin"))


def assign_bins(df: DataFrame, breaks: DataFrame, include_last: bool = False) -> DataFrame:
    """Add `inbin`, the start of the bin each date falls in; null outside the breaks."""
    return df.join(bin_days(breaks, include_last), "date", "left")


def assign_breaks(df: DataFrame, value: str, breaks: DataFrame, include_last: bool = False, brk: str = "brk", into: str = "inbin") -> DataFrame:
    """Add the start of the left-closed bin a value falls in, for breaks of any spacing and ordered type; null outside them.

    The breaks are one sorted array in one row, and each value is found in it by bisection: no join, no shuffle, and no
    row per instant. `include_last` counts the last break itself to the last bin.
    """
    edges = breaks.where(F.col(brk).isNotNull()).agg(F.array_sort(F.collect_set(brk)).alias("edges")).scalar()
    middle = "CAST((s.low + s.high) DIV 2 AS INT)"
    up = f"named_struct('low', {middle} + 1, 'high', s.high)"
    down = f"named_struct('low', s.low, 'high', {middle})"
    step = f"(s, k) -> CASE WHEN s.low >= s.high THEN s WHEN _edges[{middle}] <= _value THEN {up} ELSE {down} END"
    turns = "sequence(0, CAST(log2(size(_edges) + 1) AS INT))"
    upto = F.expr(f"aggregate({turns}, named_struct('low', 0, 'high', size(_edges)), {step}, s -> s.low)")  # breaks up to the value
    rows = df.withColumns({"_edges": F.coalesce(edges, F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")), "_value": F.col(value)})
    at = rows.withColumn("_at", F.when(F.col("_value").isNotNull(), upto))
    n, last = F.size("_edges"), F.col("_value") == F.get("_edges", F.size("_edges") - 1)
    found = F.when((F.col("_at") > 0) & (F.col("_at") < n), F.get("_edges", F.col("_at") - 1))
    if include_last:
        found = F.when(last, F.get("_edges", n - 2)).otherwise(found)
    return at.withColumn(into, found).drop("_edges", "_value", "_at")


def offset_bin(value: Column, before: int, after: int, nbins: int) -> Column:
    """Number (from 1) of the right-closed bin of an offset in `-before .. after`.

    Bins are `(after + before + 1) / nbins` wide from `-before`; the lowest edge and the tail beyond
    the last edge belong to no bin.
    """
    width = (after + before + 1) / nbins
    n_edges = int((after + before) / width + 1e-10) + 1
    number = F.ceil((value + F.lit(before)) / F.lit(width)).cast("int")
    return F.when((number >= 1) & (number <= n_edges - 1), number)


def grid_cell(value: Column, low: Column, high: Column, cells: int) -> Column:
    """Grid cell 1..cells of a value between `low` and `high`; halves round to even. A constant axis is all in cell 1."""
    raw = F.bround(F.try_divide(value - low, high - low) * F.lit(cells) + F.lit(0.5))
    return F.when(value.isNotNull(), F.least(F.greatest(raw, F.lit(1.0)), F.lit(float(cells))).cast("int"))
