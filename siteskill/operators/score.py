"""Scores: regression statistics, metric sets, linear fits and what is drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.nulls import strict_mean
from .joins import join_null_safe

# Scores need more than two values: observations of a level, or known values or pairs of a group.
ENOUGH_OBS = "n_obs > 2"
ENOUGH = {"both": "n_obs > 2 AND n_mod > 2", "pairs": "n > 2"}

METRICS = ("rmse", "rsq", "mae", "n", "slope", "mean_obs", "prmse", "pmae", "bias", "pbias")


def _counts(mod: str, obs: str) -> list:
    return [F.count(obs).alias("n_obs"), F.count(mod).alias("n_mod")]


def regression_stats(
    df: DataFrame, by: Sequence[str] = (), mod: str = "mod", obs: str = "obs", guarded: bool = False
) -> DataFrame:
    """Adjusted R2 of obs ~ mod, RMSE, slope, bias and pair count, pooled or per group.

    `guarded` blanks the scores where there are two observations or fewer.
    """
    moments = df.groupBy(*by).agg(*S.moment_columns(mod, obs), F.count(obs).alias("n_obs"))
    return moments.select(*by, *S.regression_columns(ENOUGH_OBS if guarded else None))


def stats_by_group(
    df: DataFrame, by: Sequence[str], mod: str = "mod", obs: str = "obs", support: str = "both"
) -> DataFrame:
    """Statistics and line coefficients of every group with enough support.

    `support="pairs"` asks for more than two complete pairs, `"both"` for more than two known values
    on each side.
    """
    moments = df.groupBy(*by).agg(*S.moment_columns(mod, obs), *_counts(mod, obs))
    return stats_of_moments(moments, by, support)


def stats_of_moments(moments: DataFrame, by: Sequence[str], support: str = "both") -> DataFrame:
    """`stats_by_group` from a table of moments and counts of known values."""
    return moments.where(ENOUGH[support]).select(*by, *S.regression_columns(), F.expr(f"{S.INTERCEPT} AS intercept"))


def linear_fit(df: DataFrame, by: Sequence[str] = (), mod: str = "mod", obs: str = "obs") -> DataFrame:
    """Least squares line obs = intercept + slope * mod over complete pairs."""
    moments = df.groupBy(*by).agg(*S.moment_columns(mod, obs))
    return moments.selectExpr(*by, f"{S.SLOPE} AS slope", f"{S.INTERCEPT} AS intercept", "n")


def add_fitted(df: DataFrame, fits: DataFrame, by: Sequence[str], mod: str = "mod", obs: str = "obs") -> DataFrame:
    """Value of the group's line at `mod`; null where either side is null."""
    lines = fits.selectExpr(*by, "slope AS _slope", "intercept AS _intercept")
    joined = join_null_safe(df, lines, by, "inner")
    fitted = F.expr(f"CASE WHEN {S.quoted(obs)} IS NOT NULL THEN _intercept + _slope * {S.quoted(mod)} END")
    return joined.withColumn("fitted", fitted).drop("_slope", "_intercept")


def line_ends(fitted: DataFrame, by: Sequence[str], mod: str = "mod") -> DataFrame:
    """First and last point of each group's fitted line: the drawn segment."""
    m = S.quoted(mod)
    shown = fitted.where(f"{m} IS NOT NULL AND fitted IS NOT NULL")
    return shown.groupBy(*by).agg(*[F.expr(e) for e in (
        f"min({m}) AS xmin", f"max({m}) AS xmax", f"min_by(fitted, {m}) AS ymin", f"max_by(fitted, {m}) AS ymax"
    )])


def metric_set(
    df: DataFrame, by: Sequence[str] = (), mod: str = "mod", obs: str = "obs", relative: bool = False
) -> DataFrame:
    """The wide metric row over complete pairs; here `rsq` is the plain squared correlation.

    `relative` divides `rmse` and `bias` by the mean observation. `pbias` leaves out pairs with
    `obs = 0`; `n_zero_obs` counts them.
    """
    m, o = S.quoted(mod), S.quoted(obs)
    wide = df.where(f"{m} IS NOT NULL AND {o} IS NOT NULL").groupBy(*by).agg(
        *S.moment_columns(mod, obs),
        F.expr(f"avg(abs({m} - {o})) AS mae"),
        F.expr(f"avg(try_divide({m} - {o}, {o})) AS pbias"),
        F.expr(f"count_if({o} = 0) AS n_zero_obs"),
    )
    per_mean = "/ nullif(my, 0)"
    unit = per_mean if relative else ""
    return wide.selectExpr(
        *by,
        f"({S.RMSE}) {unit} AS rmse",
        f"{S.R_SQUARED} AS rsq",
        "mae",
        "n",
        f"{S.SLOPE} AS slope",
        "my AS mean_obs",
        f"({S.RMSE}) {per_mean} AS prmse",
        f"mae {per_mean} AS pmae",
        f"({S.MEAN_ERROR}) {unit} AS bias",
        "pbias",
        "n_zero_obs",
    )


def metrics_long(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per metric: `metric, estimator, estimate`."""
    wide = wide.selectExpr(*by, *[f"cast({m} AS double) AS {m}" for m in METRICS])
    return wide.unpivot(list(by), list(METRICS), "metric", "estimate").selectExpr(
        *by, "metric", "'standard' AS estimator", "estimate"
    )


def quick_metrics(
    df: DataFrame, by: Sequence[str], mod: str = "mod", obs: str = "obs", skip_null: bool = False
) -> DataFrame:
    """Plain R2, MAE and RMSE per group. Strict: a null anywhere in the group gives null."""
    moments = df.groupBy(*by).agg(
        *S.moment_columns(mod, obs), *_counts(mod, obs), F.expr("count(*) AS n_rows"),
        F.avg(F.abs(F.col(mod) - F.col(obs))).alias("mae"),
    )
    shown = "true" if skip_null else "n_mod = n_rows AND n_obs = n_rows"
    return moments.selectExpr(*by, *[
        f"CASE WHEN {shown} THEN {score} END AS {name}"
        for name, score in (("rsq", S.R_SQUARED), ("mae", "mae"), ("rmse", S.RMSE))
    ])


def zone_metrics(df: DataFrame, by: Sequence[str], mod: str = "mod_mean", obs: str = "obs_mean") -> DataFrame:
    """Per zone: strict R2, MAE and RMSE, and `nnse_ref = 1 / (1 + sum|obs - mod| / mean(obs))`."""
    size = F.abs(F.col(mod) - F.col(obs))
    sums = df.groupBy(*by).agg(
        *S.moment_columns(mod, obs), *_counts(mod, obs), F.expr("count(*) AS n_rows"), strict_mean(size).alias("mae"),
        F.coalesce(F.sum(size), F.lit(0.0)).alias("total"), F.avg(obs).alias("mean_obs"),
    )
    shown = "n_mod = n_rows AND n_obs = n_rows"
    return sums.selectExpr(
        *by,
        f"CASE WHEN {shown} THEN {S.R_SQUARED} END AS rsq",
        "mae",
        f"CASE WHEN {shown} THEN {S.RMSE} END AS rmse",
        "try_divide(1D, 1 + try_divide(total, mean_obs)) AS nnse_ref",
    )


def mean_by_label(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Mean of repeated scores per label, with the short text labels shown next to a series."""
    out = df.groupBy(label).agg(*[strict_mean(c).alias(c) for c in columns])
    return out.selectExpr("*", *[
        f"CASE WHEN {c} IS NOT NULL THEN concat('{c} = ', substring(format_string('%.10f', {c}), 1, 4)) END AS {c}_label"
        for c in columns
    ])
