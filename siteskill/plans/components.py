"""Components of matched series: spatial means, mean seasonal cycles and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import is_day_366
from ..functions.text import climate_zone, hemisphere
from ..operators.gaps import interpolate_cycle
from ..operators.joins import join_null_safe
from ..operators.quantiles import quantiles
from ..operators.score import add_fitted, stats_by_group

RANGE = {"mean": F.avg, "min": F.min, "max": F.max}


def _cycle(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[f(c).alias(f"{c}_{name}") for c in ("obs", "mod") for name, f in RANGE.items()])


def site_means(adf: DataFrame) -> DataFrame:
    """Mean of the annual values of each site: the spatial level."""
    return adf.groupBy("sitename").agg(F.avg("obs").alias("obs"), F.avg("mod").alias("mod"))


def mean_doy(ddf: DataFrame) -> DataFrame:
    """Mean seasonal cycle by site and day of year, with filled `obs_*_plot` columns beside it.

    Day 366 is left out. The scored columns keep their gaps.
    """
    days = ddf.where(~is_day_366("date")).withColumn("doy", F.dayofyear("date"))
    cycle = _cycle(days, ["sitename", "doy"])
    return interpolate_cycle(cycle, ["sitename"], "doy", ["obs_mean", "obs_min", "obs_max"], suffix="_plot")


def mean_xoy(xdf: DataFrame) -> DataFrame:
    """Mean seasonal cycle by site and day of year of the bin start; the obs columns are filled."""
    cycle = _cycle(xdf.withColumn("xoy", F.dayofyear("inbin")), ["sitename", "xoy"])
    return interpolate_cycle(cycle, ["sitename"], "xoy", ["obs_mean", "obs_min", "obs_max"])


def mean_doy_by_zone(ddf: DataFrame) -> DataFrame:
    """Median and 33 % / 66 % quantiles by climate zone, hemisphere and day of year, pooling sites."""
    days = ddf.where(~is_day_366("date")).select(
        "sitename", "koeppen_code", hemisphere("lat").alias("hemisphere"), F.dayofyear("date").alias("doy"), "obs", "mod"
    )
    by = ["koeppen_code", "hemisphere", "doy"]
    stats = {"mean": 0.5, "min": 0.33, "max": 0.66}
    spread = quantiles(days, by, {f"{c}_{name}": (c, p) for c in ("obs", "mod") for name, p in stats.items()})
    sites = days.groupBy(*by).agg(F.count_distinct("sitename").alias("nsites"))
    zones = join_null_safe(spread, sites, by)
    filled = interpolate_cycle(zones, by[:2], "doy", ["obs_mean", "obs_min", "obs_max"])
    return filled.withColumn("climatezone", climate_zone("koeppen_code", "hemisphere"))


def large_zones(zones: DataFrame, more_than: int = 4) -> DataFrame:
    """Zones that start (first day of year) with more than this many sites."""
    start = zones.groupBy("climatezone").agg(F.min_by("nsites", "doy").alias("_n"))
    return zones.join(start.where(F.col("_n") > more_than).select("climatezone"), "climatezone", "left_semi")


def zone_page(zones: DataFrame, size: int = 10, page: int = 1) -> DataFrame:
    """Rows of one page of zones, in order of their names.

    The list of names is as short as the climate classification.
    """
    names = zones.select("climatezone").where(~F.col("climatezone").startswith("-")).distinct()
    chosen = names.orderBy("climatezone").offset(size * (page - 1)).limit(size)
    return zones.join(chosen, "climatezone", "left_semi")


def _minus(df: DataFrame, means: DataFrame, by: Sequence[str], mod: str, obs: str) -> DataFrame:
    """Subtract the group means: a small keyed table, joined back, rather than a window over all rows."""
    side = means.select(*by, F.col(mod).alias("_mod_mean"), F.col(obs).alias("_obs_mean"))
    joined = join_null_safe(df, side, by, "left")
    return joined.withColumns({
        "mod": F.col("mod") - F.col("_mod_mean"), "obs": F.col("obs") - F.col("_obs_mean")
    }).drop("_mod_mean", "_obs_mean")


def annual_anomalies(adf: DataFrame) -> DataFrame:
    return _minus(adf, site_means(adf), ["sitename"], "mod", "obs")


def _means(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("mod").alias("mod_mean"), F.avg("obs").alias("obs_mean"))


def daily_anomalies(ddf: DataFrame) -> DataFrame:
    """Daily value minus the site's mean for that day of year; day 366 has no mean and becomes null."""
    days = ddf.withColumn("doy", F.dayofyear("date"))
    return _minus(days, _means(days.where(F.col("doy") != 366), ["sitename", "doy"]), ["sitename", "doy"], "mod_mean", "obs_mean")


def xdaily_anomalies(xdf: DataFrame) -> DataFrame:
    """Bin value minus the site's mean for that bin of the year.

    A filled mean stands only where no observation exists, so the plain mean gives the same.
    """
    bins = xdf.withColumn("xoy", F.dayofyear("inbin"))
    return _minus(bins, _means(bins, ["sitename", "xoy"]), ["sitename", "xoy"], "mod_mean", "obs_mean")


def fitted_by_site(df: DataFrame, support: str = "both", by: Sequence[str] = ("sitename",)) -> DataFrame:
    """Rows of sites with enough support, with the value of the site's own line."""
    return add_fitted(df, stats_by_group(df, by, support=support), by)


