"""Observations at every time scale."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_start, week_start, year_start
from ..functions.nulls import skip_sum, strict_mean, strict_sum
from ..functions.units import water_balance_et
from ..operators.bins import assign_bins, bin_limits, break_sequence, regular_bins, week_breaks
from ..operators.joins import attach_metadata

METADATA = ("lon", "lat", "elv", "classid", "whc", "koeppen_code", "igbp_land_use", "plant_functional_type", "c4")
AGGREGATES = {"sum": strict_sum, "mean": strict_mean}


@dataclass(frozen=True)
class Observations:
    """Daily, multi-day, monthly and annual tables and the multi-day breaks (`brk`).

    Every level has `sitename`, `date` and the targets; `xdf` also has `inbin`, the bin's start.
    `outside` counts the days of each site that are in no multi-day bin.
    """

    adf: DataFrame
    mdf: DataFrame | None = None
    xdf: DataFrame | None = None
    ddf: DataFrame | None = None
    breaks: DataFrame | None = None
    outside: DataFrame | None = None


def _with_meta(df: DataFrame, meta: DataFrame | None) -> DataFrame:
    if meta is None:
        return df
    return attach_metadata(df, meta, [c for c in METADATA if c in meta.columns])


def _level(daily: DataFrame, start: Column, targets: Sequence[str], how: str, extra: Sequence[str] = ()) -> DataFrame:
    aggregate = AGGREGATES[how]
    return daily.groupBy("sitename", start.alias("date")).agg(*[aggregate(t).alias(t) for t in [*targets, *extra]])


def build_observations(
    daily: DataFrame, meta: DataFrame | None, targets: Sequence[str], annual: str = "sum"
) -> Observations:
    """Daily values, weekly and monthly means, and annual sums or means. All are strict: a missing
    day makes its week, month and year null. Weeks start on Sunday."""
    weekly = _level(daily, week_start("date"), targets, "mean").withColumn("inbin", F.col("date"))
    return Observations(
        adf=_with_meta(_level(daily, year_start("date"), targets, annual), meta),
        mdf=_with_meta(_level(daily, month_start("date"), targets, "mean"), meta),
        xdf=_with_meta(weekly, meta),
        ddf=_with_meta(daily.select("sitename", "date", *targets), meta),
        breaks=week_breaks(daily),
    )


def build_catchment_observations(daily: DataFrame, meta: DataFrame | None = None) -> Observations:
    """Annual evapotranspiration from the water balance of a catchment; missing days are skipped."""
    et = daily.withColumn("aet", water_balance_et("rain", "runoff"))
    annual = et.groupBy("sitename", year_start("date").alias("date")).agg(skip_sum("aet").alias("aet"))
    return Observations(adf=_with_meta(annual, meta))


def build_observations_xdaily(
    daily: DataFrame, meta: DataFrame | None, targets: Sequence[str], quality: Sequence[str] = (),
    breaks: DataFrame | None = None, width: int = 8, first: str | None = None, last: str | None = None,
    annual: str = "mean",
) -> Observations:
    """As `build_observations`, with bins of `width` days and quality columns averaged alongside.

    Regular bins are computed from the date alone; a `breaks` table is used if one is given. The last
    break closes the last bin and belongs to it. Without `first` and `last` the bins cover all days of the data;
    days outside given limits are in no bin's mean, and `outside` counts them.
    """
    columns = [*targets, *quality]
    if breaks is None:
        limits = bin_limits(daily, width, first, last)
        breaks = limits.select(F.explode(break_sequence(F.col("first"), F.col("last"), width)).alias("brk"))
        binned = regular_bins(daily, width, first, last, include_last=True)
    else:
        binned = assign_bins(daily, breaks, include_last=True)
    means = [strict_mean(c).alias(c) for c in columns]
    inside = binned.where(F.col("inbin").isNotNull())
    xdf = inside.groupBy("sitename", "inbin").agg(*means).withColumn("date", F.col("inbin"))
    return Observations(
        adf=_with_meta(_level(daily, year_start("date"), targets, annual, quality), meta),
        mdf=_with_meta(_level(daily, month_start("date"), targets, "mean", quality), meta),
        xdf=_with_meta(xdf, meta),
        ddf=_with_meta(daily.select("sitename", "date", *columns), meta),
        breaks=breaks,
        outside=binned.groupBy("sitename").agg(F.count_if(F.col("inbin").isNull()).alias("n_outside")),
    )
