"""Scores of many candidate simulations in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "rmse": lambda mod, obs: F.sqrt(F.avg((mod - obs) * (mod - obs))),
    "mae": lambda mod, obs: F.avg(F.abs(mod - obs)),
    "bias": lambda mod, obs: F.abs(F.avg(mod - obs)),
}


def score_runs(
    sim: DataFrame, obs: DataFrame, keys: Sequence[str], metric: str | Callable[[Column, Column], Column] = "rmse",
    by: str = "param_set", target: str = "mod", observed: str = "obs",
) -> DataFrame:
    """`(by, cost, n)`: cost of each candidate against the same observations.

    `metric` is a name or a function of the model and observation columns that gives an aggregate; both columns
    are null where a pair is incomplete. A candidate without a complete pair has a null cost and `n = 0`.
    """
    cost = METRICS[metric] if isinstance(metric, str) else metric
    joined = sim.join(obs.select(*keys, F.col(observed).alias("_obs")), list(keys), "left")
    whole = F.col(target).isNotNull() & F.col("_obs").isNotNull()
    mod, seen = F.when(whole, F.col(target)), F.when(whole, F.col("_obs"))
    return joined.groupBy(by).agg(cost(mod, seen).alias("cost"), F.count_if(whole).alias("n"))


def within_bounds(params: DataFrame, ranges: DataFrame, by: str = "param_set") -> DataFrame:
    """`(by, in_bounds)`: does every parameter of a candidate lie in its `lower .. upper` range?

    A parameter without a range counts as outside, and so does a candidate that lacks a parameter with a range.
    """
    inside = F.coalesce(F.col("value").between(F.col("lower"), F.col("upper")), F.lit(False))
    given = F.count_distinct(F.when(inside, F.col("param")))
    checked = params.join(ranges, "param", "left").groupBy(by).agg(F.bool_and(inside).alias("_inside"), given.alias("_given"))
    every = ranges.agg(F.count_distinct("param")).scalar()
    return checked.select(by, (F.col("_inside") & (F.col("_given") == every)).alias("in_bounds"))


def best_run(scores: DataFrame, bounds: DataFrame | None = None, by: str = "param_set") -> DataFrame:
    """The candidate of least cost among those within bounds; ties go to the smaller name."""
    allowed = scores if bounds is None else scores.join(bounds.where("in_bounds").select(by), by, "left_semi")
    return allowed.where(F.col("cost").isNotNull()).orderBy("cost", by).limit(1)
