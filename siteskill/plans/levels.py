"""Model output matched to the observations at every time scale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import skip_sum, strict_mean
from ..operators.bins import assign_bins
from ..operators.joins import match_to_obs
from .observations import Observations

COMPLETE_YEAR = 365


@dataclass(frozen=True)
class Matched:
    """Tables with `sitename`, a time key, `mod` and `obs`; every observation row is kept."""

    adf: DataFrame
    mdf: DataFrame | None = None
    xdf: DataFrame | None = None
    ddf: DataFrame | None = None


def model_series(mod: DataFrame, variable: str) -> DataFrame:
    return mod.select("sitename", "date", F.col(variable).alias("mod"))


def annual_totals(mod: DataFrame, min_days: int = COMPLETE_YEAR) -> DataFrame:
    """Sum and number of known days per site and year; null with fewer than `min_days`."""
    known = mod.where(F.col("mod").isNotNull())
    n = F.count(F.lit(1))
    return known.groupBy("sitename", F.year("date").alias("year")).agg(
        F.when(n >= min_days, F.sum("mod")).alias("mod"), n.alias("n")
    )


def monthly_means(mod: DataFrame) -> DataFrame:
    """Strict mean per site and month."""
    return mod.groupBy("sitename", F.year("date").alias("year"), F.month("date").alias("moy")).agg(
        strict_mean("mod").alias("mod"), F.count(F.lit(1)).alias("n")
    )


def binned_means(mod: DataFrame, breaks: DataFrame) -> DataFrame:
    """Mean, range and number of the known days per site and bin."""
    known = assign_bins(mod.where(F.col("mod").isNotNull()), breaks).where(F.col("inbin").isNotNull())
    return known.groupBy("sitename", "inbin").agg(
        F.avg("mod").alias("mod"), F.min("mod").alias("mod_min"), F.max("mod").alias("mod_max"),
        F.count("mod").alias("n_mod"),
    )


def match_annual(mod: DataFrame, obs: DataFrame, variable: str, min_days: int = COMPLETE_YEAR) -> DataFrame:
    side = obs.select("sitename", "date", F.year("date").alias("year"), F.col(variable).alias("obs"))
    return match_to_obs(annual_totals(mod, min_days), side, ["sitename", "year"])


def match_annual_skipping(mod: DataFrame, obs: DataFrame, variable: str) -> DataFrame:
    """Annual model sums of whatever days are known, without a rule on their number."""
    totals = mod.groupBy("sitename", F.year("date").alias("year")).agg(skip_sum("mod").alias("mod"))
    side = obs.select("sitename", "date", F.year("date").alias("year"), F.col(variable).alias("obs"))
    return match_to_obs(totals, side, ["sitename", "year"])


def match_monthly(mod: DataFrame, obs: DataFrame, variable: str) -> DataFrame:
    side = obs.select(
        "sitename", "date", F.year("date").alias("year"), F.month("date").alias("moy"), F.col(variable).alias("obs")
    )
    return match_to_obs(monthly_means(mod), side, ["sitename", "year", "moy"])


def match_binned(mod: DataFrame, obs: DataFrame, breaks: DataFrame, variable: str) -> DataFrame:
    side = obs.select("sitename", "inbin", F.col(variable).alias("obs"))
    return match_to_obs(binned_means(mod, breaks), side, ["sitename", "inbin"])


def match_daily(mod: DataFrame, obs: DataFrame, variable: str) -> DataFrame:
    meta = [c for c in ("lat", "koeppen_code") if c in obs.columns]
    side = obs.select("sitename", "date", F.col(variable).alias("obs"), *meta)
    return match_to_obs(mod.where(F.col("mod").isNotNull()), side, ["sitename", "date"])


def match_levels(
    mod: DataFrame, obs: Observations, variable: str, obs_variable: str | None = None, min_days: int = COMPLETE_YEAR
) -> Matched:
    """Aggregate the model to every level of the observations and match the two."""
    series = model_series(mod, variable)
    name = obs_variable or variable
    return Matched(
        adf=match_annual(series, obs.adf, name, min_days),
        mdf=match_monthly(series, obs.mdf, name),
        xdf=match_binned(series, obs.xdf, obs.breaks, name),
        ddf=match_daily(series, obs.ddf, name),
    )
