"""Linear interpolation of inner gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import nearest_known, running_totals

POSITION = "_position"


def _lerp(df: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    def filled(c: str) -> Column:
        a, b = f"{c}_before", f"{c}_after"
        inner = f"{a}.v + ({b}.v - {a}.v) * ({POSITION} - {a}.p) / ({b}.p - {a}.p)"
        return F.expr(f"CASE WHEN {c}_known < 2 THEN NULL WHEN {c} IS NOT NULL THEN {c} "
                      f"WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {inner} END")

    out = df.withColumns({f"_filled_{c}": filled(c) for c in columns})
    out = out.drop(*[f"{c}_{part}" for c in columns for part in ("before", "after", "known")])
    if not suffix:
        out = out.drop(*columns)
    return out.withColumnsRenamed({f"_filled_{c}": f"{c}{suffix}" for c in columns}).drop(POSITION)


def interpolate(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], suffix: str = "",
    by: str = "row", chunk: Column | None = None, staged: str | None = None,
) -> DataFrame:
    """Fill nulls between known values on a straight line; leading and trailing nulls stay.

    Distance is counted in rows, or along a numeric `order` column with `by="key"`. A group with
    fewer than two known values becomes all null. With a `suffix` the filled columns are added
    beside the given ones. `staged` names a table to write the numbered rows to, so that a costly
    `df` is computed once (see `running_totals`).
    """
    placed = (
        running_totals(df, keys, order, {POSITION: F.lit(1)}, chunk, staged, keep_chunk=True) if by == "row"
        else df.withColumn(POSITION, F.col(order).cast("double"))
    )
    known = {c: (F.when(F.col(c).isNotNull(), F.col(POSITION)), F.col(c)) for c in columns}
    return _lerp(nearest_known(placed, keys, order, known, chunk), columns, suffix)


def interpolate_cycle(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], suffix: str = "", by: str = "row"
) -> DataFrame:
    """`interpolate` for a mean seasonal cycle: one row per group and day of year.

    A group has 366 rows at most by construction, so plain windows per group are enough.
    """
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy(order)
    forward = ordered.rowsBetween(Window.unboundedPreceding, 0)
    backward = whole.orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    position = F.row_number().over(ordered) if by == "row" else F.col(order).cast("double")
    placed = df.withColumn(POSITION, position)
    placed = placed.withColumns({
        k: c for col in columns for k, c in (
            (f"{col}_before", F.last(_known_at(col), ignorenulls=True).over(forward)),
            (f"{col}_after", F.last(_known_at(col), ignorenulls=True).over(backward)),
            (f"{col}_known", F.count(col).over(whole)),
        )
    })
    return _lerp(placed, columns, suffix)


def _known_at(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.struct(F.col(POSITION).alias("p"), F.col(c).alias("v")))
