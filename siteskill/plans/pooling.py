"""Pooled and per-site scores of several levels from one summary table.

A summary table has one row per cell (site and day of year, for instance) with the co-moments of its
pairs and the means of its known values. Moments of shifted values, and of the union of cells,
follow from the moments of the cells. So one aggregate over the raw rows, with partial sums on the
map side, gives the pooled scores, the mean cycle and the anomaly scores: no anomaly row is built
and no raw row is joined to its mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators.joins import join_null_safe

KNOWN = ("avg(mod) AS mod_mean", "avg(obs) AS obs_mean", "count(mod) AS n_mod", "count(obs) AS n_obs")


def summarise(df: DataFrame, by: Sequence) -> DataFrame:
    """Moments of the pairs, and mean and count of the known values, per cell."""
    return df.groupBy(*by).agg(*S.moment_columns(), *[F.expr(e) for e in KNOWN])


def pool(cells: DataFrame, by: Sequence[str] = (), anomalies: bool = False) -> DataFrame:
    """Merge cells into one row of moments per group; with `anomalies`, of values minus the cell mean.

    Deviations are taken from the group's mean before squaring, so nothing cancels. `by` is a prefix
    of the cell keys; the one-row mean of the pooled form is a scalar subquery.
    """
    x, y = ("mx - mod_mean", "my - obs_mean") if anomalies else ("mx", "my")
    cells = cells.selectExpr(*by, "n", "sxx", "syy", "sxy", "sdd", "n_mod", "n_obs", f"{x} AS x", f"{y} AS y")
    mean = "try_divide(sum(n * {c}), sum(CASE WHEN {c} IS NOT NULL THEN n END))"
    centre = F.expr(f"struct({mean.format(c='x')} AS x, {mean.format(c='y')} AS y) AS centre")
    means = cells.groupBy(*by).agg(centre)
    placed = join_null_safe(cells, means, by) if by else cells.withColumn("centre", means.scalar())
    deviations = placed.selectExpr("*", "x - centre.x AS dx", "y - centre.y AS dy")
    return deviations.groupBy(*by).agg(*[F.expr(e) for e in (
        "coalesce(sum(n), 0) AS n", "any_value(centre.x) AS mx", "any_value(centre.y) AS my",
        "sum(sxx + n * dx * dx) AS sxx", "sum(syy + n * dy * dy) AS syy", "sum(sxy + n * dx * dy) AS sxy",
        "sum(sdd + n * (dx - dy) * (dx - dy)) AS sdd",
        "coalesce(sum(n_mod), 0) AS n_mod", "coalesce(sum(n_obs), 0) AS n_obs",
    )])
