"""Comparison of two tables within a tolerance, by a tree of digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

BUCKETS = 4096
LEVELS = 2
# Where this share of the buckets differs, smaller ones would hardly leave rows out.
MOST = 0.5


def _side(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int) -> DataFrame:
    """Keys and values under names of their own, and the buckets of a row from the root down."""
    named = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    spot = f"xxhash64({', '.join(f'_k{i}' for i in range(len(keys)))})"
    return named.withColumns({f"_b{level}": F.expr(f"CAST(pmod({spot} DIV {buckets**level}L, {buckets}L) AS INT)") for level in range(LEVELS)})


def _digested(df: DataFrame, by: Sequence[str], fields: Sequence[str], side: str) -> DataFrame:
    """Per bucket the number of rows and two sums of row digests: no order, and every copy counts."""
    sums = [F.sum(F.xxhash64(F.lit(salt), *fields).cast("decimal(20,0)")).alias(f"_d{salt}") for salt in (1, 2)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *sums).withColumn("_side", F.lit(side))


def _unequal(sides: dict[str, DataFrame], by: Sequence[str], fields: Sequence[str], label: str) -> tuple[DataFrame, int, float]:
    """The buckets in which the tables differ, the number of rows in all others, and the share of differing buckets."""
    both = _digested(sides["t"], by, fields, "t").unionByName(_digested(sides["c"], by, fields, "c"))
    same = F.count(F.lit(1)) == 2
    for c in ("_n", "_d1", "_d2"):
        same = same & (F.min(c) == F.max(c))
    told = stage(both.groupBy(*by).agg(same.alias("_same"), F.max("_n").alias("_n")), label)
    equal, share = told.agg(F.coalesce(F.sum(F.when(F.col("_same"), F.col("_n"))), F.lit(0)), F.avg((~F.col("_same")).cast("int"))).first()
    return told.where("NOT _same").select(*by), equal, share or 0.0


def _pairs(sides: dict[str, DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of both sides beside each other: equal rows first, what is left of a key in the order of its values; `_w` counts copies."""
    counted = {s: df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias(f"_n{s}")) for s, df in sides.items()}
    renamed = counted["c"].withColumnsRenamed({c: f"_c{c}" for c in (*keys, *values)})
    met = counted["t"].join(renamed, [F.col(c).eqNullSafe(F.col(f"_c{c}")) for c in (*keys, *values)], "full")
    met = stage(met.withColumns({"_nt": F.coalesce("_nt", F.lit(0)), "_nc": F.coalesce("_nc", F.lit(0))}), "compared_rows")
    equal = met.where("_nt > 0 AND _nc > 0").select(F.least("_nt", "_nc").alias("_w"), *[F.col(v).alias(f"_t{v}") for v in values], *[F.col(v).alias(f"_c{v}") for v in values])

    def left_over(side: str) -> DataFrame:
        """Copies that the other side has not, one row each."""
        own = "" if side == "t" else "_c"
        other = "_nc" if side == "t" else "_nt"
        rows = met.where(f"_n{side} > {other}").selectExpr(*[f"{own}{c} AS {c}" for c in (*keys, *values)], f"_n{side} - {other} AS _w")
        return rows.select(*keys, *values, F.explode(F.sequence(F.lit(1), F.col("_w"))).alias("_copy"))

    place = lambda df: df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*values, "_copy")))
    t = place(left_over("t")).select(*keys, "_place", *[F.col(v).alias(f"_t{v}") for v in values], F.lit(True).alias("_t"))
    c = place(left_over("c")).select(*[F.col(k).alias(f"_c{k}") for k in keys], F.col("_place").alias("_c_place"), *[F.col(v).alias(f"_c{v}") for v in values], F.lit(True).alias("_c"))
    rest = t.join(c, [*[F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in keys], F.col("_place") == F.col("_c_place")], "full")
    known = lambda x: F.coalesce(F.col(x), F.lit(False)).alias(x)
    shown = [*[f"_t{v}" for v in values], *[f"_c{v}" for v in values]]
    return equal.select("_w", *shown, F.lit(True).alias("_t"), F.lit(True).alias("_c")).unionByName(
        rest.select(F.lit(1).cast("bigint").alias("_w"), *shown, known("_t"), known("_c")))


def compare_tables(
    target: DataFrame, current: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-5, buckets: int = BUCKETS
) -> DataFrame:
    """One row per column: are both tables equal up to `tolerance`?

    The difference is the mean absolute difference over the rows that differ, relative to the mean
    absolute target there (absolute if that mean is not above the tolerance). Rows that only one
    table has, or that are null in one only, make a column unequal.

    Both tables are first reduced to digests of buckets of keys, which are compared; buckets that differ are looked at again in
    smaller ones, and only rows of those that still differ are joined. Equal tables are told equal without a join of
    rows. Keys may repeat: equal rows of a key are matched first, the others in the order of their values, and copies
    that one table has more of are unmatched.
    """
    sides = {"t": _side(target, keys, columns, buckets), "c": _side(current, keys, columns, buckets)}
    k, v = [f"_k{i}" for i in range(len(keys))], [f"_v{i}" for i in range(len(columns))]
    matched = 0
    for level in range(LEVELS):
        by = [f"_b{i}" for i in range(level + 1)]
        unequal, equal, share = _unequal(sides, by, [*k, *v], f"compared_level_{level}")
        matched += equal
        sides = {s: df.join(unequal, by, "left_semi") for s, df in sides.items()} if share < 1 else sides
        if not 0 < share < MOST:
            break
    pairs = _pairs(sides, k, v)

    def sums(i: int) -> Column:
        t, c, both = F.col(f"_t_v{i}"), F.col(f"_c_v{i}"), F.col("_t") & F.col("_c")
        count = lambda x: F.coalesce(F.sum(F.when(x, F.col("_w"))), F.lit(0))
        differs = both & (t != c)
        n = F.sum(F.when(differs, F.col("_w")))
        mean = lambda x: F.try_divide(F.sum(F.when(differs, x * F.col("_w"))), n)
        return F.struct(
            F.lit(columns[i]).alias("column"), (count(both) + F.lit(matched)).alias("n_matched"), count(~both).alias("n_unmatched"),
            count(both & (t.isNull() != c.isNull())).alias("n_null_mismatch"), count(differs).alias("n_differ"),
            mean(F.abs(t - c)).alias("_gap"), mean(F.abs(t)).alias("_scale"))

    found = pairs.agg(*[sums(i).alias(f"_s{i}") for i in range(len(columns))]).select(F.inline(F.array(*[f"_s{i}" for i in range(len(columns))])))
    relative = F.when(F.col("_scale") > tolerance, F.col("_gap") / F.col("_scale")).otherwise(F.col("_gap"))
    difference = F.coalesce(relative, F.lit(0.0))
    equal = (F.col("n_unmatched") == 0) & (F.col("n_null_mismatch") == 0) & (difference <= tolerance)
    return found.select(
        "column", "n_matched", "n_unmatched", "n_null_mismatch", "n_differ",
        difference.alias("difference"), equal.alias("is_equal"),
    )
