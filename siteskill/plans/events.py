"""Alignment of series on the onset of events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bins import offset_bin
from ..operators.joins import join_null_safe
from ..operators.quantiles import quantiles, summaries
from ..operators.runs import index_series, number_runs, runs_of_indexed
from ..session import stage

KEYS = ("site",)


@dataclass(frozen=True)
class Aligned:
    """`rows`: series rows with `inst` (event number in the site) and `dday` (days since onset).
    `by_day`: summaries of the variables over all events, per `dday`."""

    rows: DataFrame
    by_day: DataFrame


def event_windows(runs: DataFrame, lengths: DataFrame, before: int, after: int) -> DataFrame:
    """One row per event and day offset. A window not wholly inside its series is dropped."""
    tail = F.least(F.lit(after), F.col("len"))
    whole = (F.col("start_rn") - before >= 1) & (F.col("start_rn") + tail <= F.col("series_len"))
    return (
        join_null_safe(runs, lengths, KEYS)
        .where(whole)
        .select("site", "inst", "start_rn", F.explode(F.sequence(F.lit(-before), tail)).alias("dday"))
        .select("site", "inst", "dday", (F.col("start_rn") + F.col("dday")).alias("rn"))
    )


def normalise(rows: DataFrame, variables: Sequence[str], before: int, after: int, nbins: int, normbin: int) -> DataFrame:
    """Subtract each variable's median in one bin of offsets, pooled over all events.

    Adds `inbin`, the bin number. `normbin` counts the bins that hold rows; one beyond them stops the query.
    """
    binned = rows.withColumn("inbin", offset_bin(F.col("dday"), before, after, nbins))
    medians = quantiles(binned.where(F.col("inbin").isNotNull()), ["inbin"], {v: (v, 0.5) for v in variables})
    in_order = F.array_sort(F.collect_list(F.struct("inbin", *variables)))  # at most nbins rows
    bins = medians.agg(in_order.alias("bins"))
    missing = F.raise_error(F.lit(f"fewer than {normbin} bins hold rows"))
    norm = F.when(F.size("bins") > 0, F.coalesce(F.try_element_at("bins", F.lit(normbin)), missing))
    row = bins.select(norm.alias("norm")).scalar()
    shifted = binned.withColumn("_norm", row)
    return shifted.withColumns({v: F.col(v) - F.col(f"_norm.{v}") for v in variables}).drop("_norm")


def align_events(
    df: DataFrame, flags: DataFrame, variables: Sequence[str], min_len: int, before: int, after: int,
    do_norm: bool = False, nbins: int = 6, normbin: int = 2, flag: str = "isevent", names: Sequence[str] = ("median", "q33", "q66"),
) -> Aligned:
    """Cut the series around the onset of every run of at least `min_len` flagged rows.

    A window reaches from `before` rows ahead of the onset to `min(after, run length)` rows past it.
    Events are found per site, by row position. The windows are spelled out as (site, row number)
    pairs, so the rows come from an equi-join on a unique key. `names` are the summaries by day (see `SUMMARIES`).
    """
    flagged = join_null_safe(df, flags.select("site", "date", flag), ["site", "date"], "left")
    indexed = index_series(flagged.select("site", "date", flag, *variables), flag, staged="indexed")
    runs = number_runs(runs_of_indexed(indexed, flag, min_len), name="inst")
    lengths = indexed.groupBy("site").agg(F.max("rn").alias("series_len"))
    windows = event_windows(runs, lengths, before, after)
    rows = stage(join_null_safe(indexed.drop("tn"), windows, ["site", "rn"]).drop("rn"), "windows")
    if do_norm:
        rows = normalise(rows, variables, before, after, nbins, normbin)
    return Aligned(rows, summaries(rows, ["dday"], variables, names))


def event_response(
    df: DataFrame, flags: DataFrame, min_len: int, before: int, after: int, do_norm: bool = False,
    nbins: int = 6, normbin: int = 2, flag: str = "isevent",
) -> DataFrame:
    """Median and terciles of the model error `mod - obs` by day since the onset."""
    biased = df.withColumn("bias", F.col("mod") - F.col("obs"))
    return align_events(biased, flags, ["bias"], min_len, before, after, do_norm, nbins, normbin, flag).by_day
