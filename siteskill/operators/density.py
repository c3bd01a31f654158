"""Densities of points: histograms, hexagonal bins, 2-D kernel density and density classes.

The number of bins or grid cells is a parameter, so these tables stay small whatever the data. What
the driver sees is one row of summary values (range, count, spread).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .bins import grid_cell
from .prep import finite_pairs
from .quantiles import quantiles

# Fixed value: a point this share of a bin above an edge still counts to the lower bin.
EDGE_TOLERANCE = 1e-7
# Fixed value: distance of the first hexagon row and column from the lower bound.
HEX_PAD = 1e-6
HEX_SCHEMA = "x double, y double, n bigint, n_outside bigint"
# A task holds this many cells of a grid at a time; larger grids are summed in stripes of rows.
STRIPE_CELLS = 1_000_000
POINTS = 10_000
GATHERED = 200_000
# A kernel this many bandwidths away is below 1e-17 of its peak.
REACH = 9.0


def pretty_breaks(low: float, high: float, n: int) -> tuple[float, float, int]:
    """First edge, width and number of about `n` bins with round edges that cover `low .. high`."""
    span = high - low
    cell = max(abs(low), abs(high)) or 1.0
    if span > 0:
        cell = span / n
    base = 10.0 ** math.floor(math.log10(cell))
    width = base
    # Steps of 1, 2, 5 and 10, and how far each is favoured over the next smaller one.
    for factor, bias in ((2, 1.5), (5, 2.75), (10, 1.5)):
        if factor * base - cell < bias * (cell - width):
            width = factor * base
    slack = 1e-10
    first = math.floor(low / width + slack)
    last = max(math.ceil(high / width - slack), first + 1)
    return first * width, width, last - first


def _edge_bin(value: Column, first: float, width: float, bins: int) -> Column:
    """Right-closed bin 1..bins; the first bin also holds its lower edge; null outside."""
    place = (value - F.lit(first)) / F.lit(width)
    inside = (place >= -EDGE_TOLERANCE) & (place <= bins + EDGE_TOLERANCE)
    number = F.ceil(place - F.lit(EDGE_TOLERANCE))
    return F.when(inside, F.least(F.greatest(number, F.lit(1)), F.lit(bins)).cast("int"))


def histogram(df: DataFrame, columns: Sequence[str], breaks: int) -> DataFrame:
    """Counts and densities of several columns over the pretty bins of the first one.

    One row per (series, bin), empty bins included. Values outside the bins and values that are not finite are in
    no bin; `n_outside` counts them, and densities are relative to the values inside.
    """
    finite = F.when(F.abs(F.col(columns[0]).cast("double")) < float("inf"), F.col(columns[0]).cast("double"))
    low, high = df.agg(F.min(finite), F.max(finite)).first()
    if low is None:
        raise ValueError(f"no values in {columns[0]}")
    first, width, bins = pretty_breaks(low, high, breaks)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("v")) for c in columns]))
    values = df.select(cells.alias("cell")).select("cell.*").where(F.col("v").isNotNull())
    counts = values.groupBy("series", _edge_bin(F.col("v"), first, width, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counts.groupBy("series").agg(
        F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).alias("_inside"),
        F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("n"))), F.lit(0)).alias("n_outside"),
    )
    frame = totals.select("series", "_inside", "n_outside", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    filled = frame.join(counts, ["series", "bin"], "left")
    n = F.coalesce("n", F.lit(0))
    return filled.select(
        "series", "bin",
        (F.lit(first) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
        (F.lit(first) + F.col("bin") * F.lit(width)).alias("upper"),
        n.alias("n"), (n / (F.col("_inside") * F.lit(width))).alias("density"), "n_outside",
    )


def axis_limit(df: DataFrame, x: str = "mod", y: str = "obs", p: float = 0.9999) -> DataFrame:
    """One row: the larger of both high quantiles over complete pairs, rounded half to even."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    q = quantiles(pairs, [], {"qx": (x, p), "qy": (y, p)})
    return q.select(F.bround(F.greatest("qx", "qy")).alias("limit"))


def hex_bins(
    df: DataFrame, x: str = "mod", y: str = "obs", bins: int = 50, limits: tuple[float, float] | None = None
) -> DataFrame:
    """Counts per hexagon over `limits` on both axes; points outside are dropped, and `n_outside` is their number.

    Hexagon centres lie on two interleaved rectangular lattices. A point is rounded on each, and the
    nearer centre wins. Without `limits` the axes run from 0 to `axis_limit`. Limits without extent or without
    points give an empty table.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    low, high = limits or (0.0, axis_limit(df, x, y).first()["limit"])
    if high is None or high <= low:
        return df.sparkSession.createDataFrame([], HEX_SCHEMA)
    inside = F.col(x).between(low, high) & F.col(y).between(low, high)
    shown = pairs.where(inside)
    width = (high - low) / bins
    corner = pairs.agg(*[F.min(F.when(inside, F.col(c))).alias(a) for a, c in (("x", x), ("y", y))], F.count_if(~inside).alias("outside")).first()
    if corner["x"] is None:
        return df.sparkSession.createDataFrame([], HEX_SCHEMA)
    x0, y0 = (math.floor(corner[a] / width) * width - HEX_PAD for a in ("x", "y"))
    row = width * math.sqrt(3.0)

    u, v = (F.col(x) - F.lit(x0)) / F.lit(width), (F.col(y) - F.lit(y0)) / F.lit(row)
    even_u, even_v = F.floor(u + 0.5).cast("double"), F.floor(v + 0.5).cast("double")
    odd_u, odd_v = F.floor(u) + 0.5, F.floor(v) + 0.5
    placed = shown.select(u.alias("u"), v.alias("v"), even_u.alias("eu"), even_v.alias("ev"), odd_u.alias("ou"), odd_v.alias("ov"))

    def far(a: str, b: str) -> Column:
        du, dv = F.col("u") - F.col(a), F.col("v") - F.col(b)
        return du * du + 3 * dv * dv

    even = far("eu", "ev") <= far("ou", "ov")
    cells = placed.groupBy(
        F.when(even, F.col("eu")).otherwise(F.col("ou")).alias("cu"), F.when(even, F.col("ev")).otherwise(F.col("ov")).alias("cv")
    ).agg(F.count(F.lit(1)).alias("n"))
    return cells.select(
        (F.lit(x0) + F.col("cu") * F.lit(width)).alias("x"), (F.lit(y0) + F.col("cv") * F.lit(row)).alias("y"), "n",
        F.lit(corner["outside"]).cast("bigint").alias("n_outside"),
    )


def _bandwidths(n: int, spread: dict[str, tuple[float, float]]) -> tuple[float, float]:
    """Normal-reference bandwidth per axis; an axis without spread takes the other one's."""
    # 4 * 1.06, 1.34, the power -1/5, 4, and 0.01 for data without spread.
    raw = {a: 4 * 1.06 * min(sd, iqr / 1.34) * n ** (-0.2) for a, (sd, iqr) in spread.items()}
    if not any(raw.values()):
        return 0.01 / 4, 0.01 / 4
    if not all(raw.values()):
        return (max(raw.values()) / 4,) * 2
    return raw["x"] / 4, raw["y"] / 4


def _log_points(df: DataFrame, x: str, y: str, log: str, xlim, ylim) -> DataFrame:
    kept = finite_pairs(df, x, y, xlim, ylim, log)
    scaled = [(F.log10(c) if a in log else F.col(c)).cast("double").alias(a) for a, c in (("x", x), ("y", y))]
    return kept.select("*", *[s.alias(f"_{a}") for s, a in zip(scaled, ("x", "y"))])


def _summary(points: DataFrame) -> dict:
    ranges = points.agg(*[
        f(f"_{a}").alias(f"{name}_{a}") for a in ("x", "y")
        for name, f in (("min", F.min), ("max", F.max), ("sd", F.stddev_samp))
    ], F.count(F.lit(1)).alias("n")).first().asDict()
    quart = quantiles(points, [], {f"q{i}_{a}": (f"_{a}", i / 4) for a in ("x", "y") for i in (1, 3)}).first().asDict()
    if not ranges["n"]:
        raise ValueError("no finite point pairs")
    return {**ranges, **quart}


def _grid(points: DataFrame, s: dict, n: int, only: str) -> DataFrame:
    spread = {a: (s[f"sd_{a}"] or 0.0, s[f"q3_{a}"] - s[f"q1_{a}"]) for a in ("x", "y")}
    hx, hy = _bandwidths(s["n"], spread)
    gx = np.linspace(s["min_x"], s["max_x"], n)
    gy = np.linspace(s["min_y"], s["max_y"], n)

    def near(grid: np.ndarray, at: np.ndarray, h: float, used: bool, first: int, end: int):
        """The part of an axis that the points reach, and the kernel there (1 everywhere on an axis that is left out)."""
        if not used:
            return (first, end), np.ones((end - first, len(at)))
        low, high = np.searchsorted(grid, [at.min() - REACH * h, at.max() + REACH * h], side="left")
        low, high = min(max(int(low), first), end), min(max(int(high) + 1, first), end)
        u = (grid[low:high, None] - at[None, :]) / h
        return (low, high), np.exp(-0.5 * u * u) / math.sqrt(2.0 * math.pi)

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some batches at once, so that tiles hold several points."""
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= GATHERED:
                yield tuple(np.concatenate([h[c].to_numpy() for h in held]) for c in ("_x", "_y"))
                held = []
        if sum(map(len, held)):
            yield tuple(np.concatenate([h[c].to_numpy() for h in held]) for c in ("_x", "_y"))

    def stripe(first: int, end: int) -> DataFrame:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((end - first, n))
            seen = False
            for xs, ys in gathered(batches):
                add_tiles(total, xs, ys)
                seen = True
            if seen:
                yield pd.DataFrame({"ix": np.arange(first + 1, end + 1), "zs": list(total)})

        def add_tiles(total: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> None:
            """Points of a tile, nine bandwidths wide, meet only the rows and columns of the grid within nine bandwidths."""
            tile = [np.floor((v - low) / (REACH * h)) for v, low, h in ((xs, gx[0], hx), (ys, gy[0], hy))]
            tile = [np.zeros_like(t) if only == other else t for t, other in zip(tile, ("y", "x"))]
            order = np.lexsort((tile[1], tile[0]))
            cuts = np.flatnonzero(np.r_[True, (np.diff(tile[0][order]) != 0) | (np.diff(tile[1][order]) != 0), True])
            for a, z in zip(cuts[:-1], cuts[1:]):
                for k in range(a, z, POINTS):
                    some = order[k : min(k + POINTS, z)]
                    rows, kx = near(gx, xs[some], hx, only != "y", first, end)
                    columns, ky = near(gy, ys[some], hy, only != "x", 0, n)
                    total[rows[0] - first : rows[1] - first, columns[0] : columns[1]] += kx @ ky.T

        return points.select("_x", "_y").mapInPandas(partial, "ix int, zs array<double>")

    rows = max(1, STRIPE_CELLS // n)
    sums = functools.reduce(DataFrame.unionAll, [stripe(a, min(a + rows, n)) for a in range(0, n, rows)])
    cells = sums.select("ix", F.posexplode("zs").alias("iy", "z")).groupBy("ix", (F.col("iy") + 1).alias("iy"))
    scale = s["n"] * hx * hy
    z = cells.agg((F.sum("z") / F.lit(scale)).alias("z"))

    def at(index: str, low: float, high: float) -> Column:
        step = (high - low) / (n - 1)
        return F.lit(low) + (F.col(index) - 1) * F.lit(step)

    return z.select("ix", "iy", at("ix", s["min_x"], s["max_x"]).alias("gx"), at("iy", s["min_y"], s["max_y"]).alias("gy"), "z")


def _check_grid(n: int, only: str) -> None:
    if n < 2:
        raise ValueError("the grid must have at least 2 cells per axis")
    if only not in ("none", "x", "y"):
        raise ValueError("only must be none, x or y")


def kernel_density(
    df: DataFrame, x: str, y: str, n: int = 100, only: str = "none", log: str = "",
    xlim: tuple[float, float] | None = None, ylim: tuple[float, float] | None = None,
) -> DataFrame:
    """Gaussian density of the points on an n x n grid over their range: `ix, iy, gx, gy, z`.

    Each task of the scan adds up a grid for its points (a matrix product per tile of points, over the part of the grid within nine
    bandwidths; in stripes of rows if the grid is large), and the grids are summed by cell. No point is shuffled.
    """
    _check_grid(n, only)
    points = _log_points(df, x, y, log, xlim, ylim)
    return _grid(points, _summary(points), n, only)


def density_classes(
    df: DataFrame, x: str, y: str, n: int = 100, classes: int = 30, only: str = "none", log: str = "",
    xlim: tuple[float, float] | None = None, ylim: tuple[float, float] | None = None,
) -> DataFrame:
    """The finite pairs with their grid cell, its density and the density's class 1..classes."""
    _check_grid(n, only)
    points = _log_points(df, x, y, log, xlim, ylim)
    s = _summary(points)
    grid = stage(_grid(points, s, n, only).select("ix", "iy", "z"), "grid")
    low, high = grid.agg(F.min("z"), F.max("z")).first()
    cells = grid.withColumn("density_class", grid_cell(F.col("z"), F.lit(low), F.lit(high), classes))
    placed = points.withColumns({
        f"i{a}": grid_cell(F.col(f"_{a}"), F.lit(s[f"min_{a}"]), F.lit(s[f"max_{a}"]), n) for a in ("x", "y")
    })
    return placed.drop("_x", "_y").join(cells, ["ix", "iy"])
