"""One model column against one observation column: metrics, the fitted line and what a plot shows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.correlation import correlation_matrix
from ..operators.density import density_classes, hex_bins, kernel_density
from ..operators.prep import finite_pairs
from ..operators.score import linear_fit, metric_set, metrics_long
from ..sources.nested import stack_tables

KINDS = ("points", "hex", "heat", "density")


@dataclass(frozen=True)
class Comparison:
    """`metrics` is long, `results` the short row (relative, if asked for), `line` the fit, `layer` the points.

    `outside` counts the complete pairs that are not in a `heat` or `density` layer (`n_outside`): outside the
    limits, or not finite. `hex` has that count in its layer, `points` leaves none out.
    """

    metrics: DataFrame
    results: DataFrame
    line: DataFrame
    layer: DataFrame
    outside: DataFrame | None = None


def model_against_obs(
    df: DataFrame, mod: str, obs: str, kind: str = "points", relative: bool = False,
    xlim: tuple[float, float] | None = None, ylim: tuple[float, float] | None = None,
) -> Comparison:
    """Score the complete pairs and give the table behind the chosen view.

    `points` are the pairs, `hex` hexagon counts, `heat` the pairs with their density class, and
    `density` the kernel density grid with `nlevel`, the density relative to its peak.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    pairs = df.select(F.col(mod).alias("mod"), F.col(obs).alias("obs")).dropna()
    if kind == "density":
        xlim, ylim = xlim or (0.0, float("inf")), ylim or (0.0, float("inf"))
    outside = None
    if kind in ("heat", "density"):
        number = F.count(F.lit(1)).alias("n")
        inside = finite_pairs(pairs, "mod", "obs", xlim, ylim).agg(number)
        outside = pairs.agg(number).select((F.col("n") - inside.scalar()).alias("n_outside"))
    if kind == "points":
        layer = pairs
    elif kind == "hex":
        layer = hex_bins(pairs)
    elif kind == "heat":
        layer = density_classes(pairs, "mod", "obs", xlim=xlim, ylim=ylim)
    else:
        grid = kernel_density(pairs, "mod", "obs", xlim=xlim, ylim=ylim)
        layer = grid.withColumn("peak", grid.agg(F.max("z")).scalar()).selectExpr("ix", "iy", "gx", "gy", "z", "z / peak AS nlevel")
    return Comparison(
        metrics=metrics_long(metric_set(pairs)),
        results=metric_set(pairs, relative=relative).select("rsq", "rmse", "mae", "bias", "slope", "n"),
        line=linear_fit(pairs),
        layer=layer,
        outside=outside,
    )


def heat_pairs(
    df: DataFrame, columns: Sequence[str], method: str = "spearman", n: int = 100, classes: int = 30, log: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Correlation matrix of several columns, and the density-classed points of every pair of them.

    On a log scale only rows with all columns positive count.
    """
    if log:
        for c in columns:
            df = df.where(F.col(c) > 0)
    layers = {}
    for a, b in combinations(columns, 2):
        points = df.select(F.col(a).alias("x"), F.col(b).alias("y"))
        layers[f"{a}|{b}"] = density_classes(points, "x", "y", n=n, classes=classes, log=log)
    return correlation_matrix(df, columns, method), stack_tables(layers, "pair")
