"""Exact quantiles (linear between order statistics) of groups of any size.

The built-in exact percentile keeps all values of a group in one buffer. Here groups are counted first. If
some are large, an approximate quantile sketch brackets each wanted quantile of theirs, and one more
pass keeps the values inside the brackets and replaces the others, already on the map side, by counts.
What is left of a group is cut into parts along the value, and running counts over parts and within
them find the exact order statistics.

The brackets only decide which rows may be counted together. Any bracket that holds the wanted order
statistics gives the same result, so a recomputed sketch (lost executor) cannot change it; and if a
bracket ever missed, the query stops with an error instead of returning a wrong number.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .joins import join_null_safe

# The sketch promises a rank error of at most rows / ACCURACY; the brackets are four times as wide.
# Groups of up to 2 * ACCURACY rows are kept whole, so a bracket reaches 8 rows or more to each side.
ACCURACY = 50_000
MARGINS = 4
SMALL_GROUPS = 2
SLICES = 256
PARTS = 64


MISSED = "raise_error('a quantile bracket missed its order statistic')"


def _order_statistic(position: str) -> str:
    holds = f"{position} >= _cum - _count AND {position} < _cum"
    return f"max(CASE WHEN {holds} THEN CASE WHEN _kept THEN _rep ELSE cast({MISSED} AS double) END END)"


def _quantile(p: float) -> str:
    at = f"{p!r}D * (_n - 1)"
    first, second = _order_statistic(f"floor({at})"), _order_statistic(f"ceil({at})")
    return f"{first} + ({second} - {first}) * max({at} - floor({at}))"


def quantiles(
    df: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[str, float]], accuracy: int = ACCURACY
) -> DataFrame:
    """One row per group; `wanted` maps an output column to (value column, probability).

    Nulls are skipped. A group without any value gives null, not a missing row.
    """
    columns = sorted({c for c, _ in wanted.values()})
    probs = sorted({p for _, p in wanted.values()})
    keys = [f"_key_{k}" for k in by]
    cells = ", ".join(f"struct('{c}' AS _var, cast(`{c}` AS double) AS _v)" for c in columns)
    long = df.selectExpr(*[f"`{k}` AS `_key_{k}`" for k in by], f"inline(array({cells}))")
    group = [*keys, "_var"]

    counts = long.groupBy(*group).agg(F.count("_v").alias("_rows"))
    large = stage(counts.where(F.col("_rows") > SMALL_GROUPS * accuracy).drop("_rows"), "large_groups")
    if large.isEmpty():
        counted = long.groupBy(*group, F.col("_v").alias("_rep"), F.lit(True).alias("_kept")).agg(F.count("_v").alias("_count"))
        upto = Window.partitionBy(*group).orderBy(F.col("_rep").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counted.withColumns({
            "_cum": F.sum("_count").over(upto), "_n": F.sum("_count").over(Window.partitionBy(*group))
        })
    else:
        ranked = _ranked_large(long, large, group, probs, accuracy)
    per_var = ranked.groupBy(*group).agg(*[F.expr(f"{_quantile(p)} AS _q{i}") for i, p in enumerate(probs)])
    out = per_var.groupBy(*keys).agg(*[
        F.expr(f"max(CASE WHEN _var = '{c}' THEN _q{probs.index(p)} END) AS `{name}`") for name, (c, p) in wanted.items()
    ])
    return out.withColumnsRenamed({f"_key_{k}": k for k in by})


def _ranked_large(long: DataFrame, large: DataFrame, group: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """Values with their running count; those outside the brackets of a large group are counted together."""
    edges = [min(max(p + side * MARGINS / accuracy, 0.0), 1.0) for p in probs for side in (-1, 1)]
    # Sketches of a hot group come from every task, so they are first merged in slices of the tasks. In
    # no slice do more rows than its share lie below its own bracket; hence none of the slices' outer
    # edges cuts off the quantile of the whole.
    sketched = join_null_safe(long, large, group, "left_semi").groupBy(*group, (F.spark_partition_id() % SLICES).alias("_slice")).agg(
        F.percentile_approx("_v", edges, accuracy).alias("_edges")
    )
    outer = ", ".join(f"{'max' if i % 2 else 'min'}(_edges[{i}])" for i in range(len(edges)))
    # Written, so that their size is known: values then meet them in a map-side join wherever they are few.
    brackets = stage(sketched.groupBy(*group).agg(F.expr(f"array({outer}) AS _edges")), "brackets")
    inside = " OR ".join(f"_v BETWEEN _edges[{2 * i}] AND _edges[{2 * i + 1}]" for i in range(len(probs)))
    highs = [f"_edges[{2 * i + 1}]" for i in range(len(probs))]
    below = f"greatest(cast(NULL AS double), {', '.join(f'CASE WHEN {h} < _v THEN {h} END' for h in highs)})"
    # A part rises with the value: it cuts each bracket into equal lengths, and its rows are ordered by themselves.
    parts = " + ".join(
        f"CASE WHEN _rep >= _edges[{2 * i + 1}] THEN {PARTS} WHEN _rep > _edges[{2 * i}] THEN "
        f"cast(least({PARTS} - 1, floor(try_divide(_rep - _edges[{2 * i}], _edges[{2 * i + 1}] - _edges[{2 * i}]) * {PARTS})) AS int) ELSE 0 END"
        for i in range(len(probs))
    )
    counted = (
        join_null_safe(long, brackets, group, "left")
        .selectExpr(*group, "_v", "_edges", f"_edges IS NULL OR {inside} AS _kept")
        .selectExpr(*group, "_kept", "_edges", f"CASE WHEN _kept THEN _v ELSE {below} END AS _rep", "_v")
        .selectExpr(*group, "_kept", "_rep", "_v", f"CASE WHEN _edges IS NULL THEN 0 ELSE {parts} END AS _part")
        .groupBy(*group, "_part", "_rep", "_kept")
        .agg(F.count("_v").alias("_count"))
    )
    counted = stage(counted, "counted")
    inner = Window.partitionBy(*group, "_part")
    upto = inner.orderBy(F.col("_rep").asc_nulls_first(), F.col("_kept").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)  # some hundred rows a group
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy(*group, "_part").agg(F.sum("_count").alias("_sum")).select(
        *group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.sum("_sum").over(whole).alias("_n")
    )
    local = counted.withColumn("_local", F.sum("_count").over(upto))
    return join_null_safe(local, sums, [*group, "_part"]).withColumn("_cum", F.col("_local") + F.col("_before"))


def median_and_terciles(variables: Sequence[str]) -> dict[str, tuple[str, float]]:
    """Median and the 33 % and 66 % quantiles. With one variable the names carry no prefix."""
    stats = {"median": 0.5, "q33": 0.33, "q66": 0.66}  # fixed values
    if len(variables) == 1:
        return {name: (variables[0], p) for name, p in stats.items()}
    return {f"{v}_{name}": (v, p) for name, p in stats.items() for v in variables}


#: Summaries by name (the probabilities are fixed values): a probability is an exact quantile, a function makes an aggregate of a column.
SUMMARIES: Mapping[str, float | Callable[[str], Column]] = {
    "median": 0.5, "q33": 0.33, "q66": 0.66, "mean": F.avg, "min": F.min, "max": F.max, "sd": F.stddev_samp, "sum": F.sum, "n": F.count,
}


def summaries(
    df: DataFrame, by: Sequence[str], variables: Sequence[str], names: Sequence[str] = ("median", "q33", "q66"),
    registry: Mapping[str, float | Callable[[str], Column]] = SUMMARIES,
) -> DataFrame:
    """One row per group with every named summary of every variable, quantiles and plain aggregates mixed.

    With one variable the columns are called like the summaries, with several `<variable>_<summary>`. Pass a `registry` of
    your own to add names.
    """
    unknown = [n for n in names if n not in registry]
    if unknown:
        raise ValueError(f"unknown summaries {unknown}; known are {sorted(registry)}")
    label = (lambda v, n: n) if len(variables) == 1 else (lambda v, n: f"{v}_{n}")
    chosen = [(v, n) for n in names for v in variables]
    exact = {label(v, n): (v, registry[n]) for v, n in chosen if not callable(registry[n])}
    plain = [registry[n](v).alias(label(v, n)) for v, n in chosen if callable(registry[n])]
    if not plain:
        return quantiles(df, by, exact)
    keyed = df.withColumn("_all", F.lit(0))
    out = keyed.groupBy("_all", *by).agg(*plain)
    if exact:
        out = join_null_safe(out, quantiles(keyed, ["_all", *by], exact), ["_all", *by])
    return out.select(*by, *[label(v, n) for v, n in chosen])
