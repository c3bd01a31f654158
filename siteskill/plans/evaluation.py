"""Evaluation of a model: the metrics table by level, and the component tables behind it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import regression_columns
from ..functions.text import source_tokens
from ..operators.gaps import interpolate_cycle
from ..operators.joins import keep_sites
from ..operators.score import ENOUGH_OBS, line_ends, quick_metrics, regression_stats, stats_of_moments, zone_metrics
from ..session import stage
from ..sources.nested import stack_tables
from . import components as C
from .levels import COMPLETE_YEAR, Matched, match_annual_skipping, match_levels, model_series
from .observations import Observations
from .pooling import pool, summarise

#: The names of observation sources, with all levels or with annual ones only.
FULL, ANNUAL_ONLY = "fluxnet", "camels"


def is_annual_only(source: str) -> bool:
    """Whether a source has annual observations only. Other names than the known ones are refused."""
    found = {FULL, ANNUAL_ONLY} & set(source_tokens(source))
    if len(found) != 1:
        raise ValueError(f"unknown observation source {source!r}: name one of {FULL!r} and {ANNUAL_ONLY!r}")
    return found == {ANNUAL_ONLY}


@dataclass(frozen=True)
class Settings:
    """What to evaluate: `benchmark` maps a variable to its observation source (`"fluxnet"`, `"fluxnet_daily"`, ...).

    The source `"camels"` has annual observations only. `sites` is a table of `sitename` to evaluate
    (all, if none is given).
    """

    benchmark: Mapping[str, str]
    sites: DataFrame | None = None
    min_days: int = COMPLETE_YEAR
    obs_variable: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Evaluation:
    """`metrics` has one row per level. `tables` (empty for a light run) are lazy."""

    metrics: DataFrame
    tables: Mapping[str, DataFrame] = field(default_factory=dict)


def _annual_levels(site_cells: DataFrame) -> dict[str, DataFrame]:
    return {
        "annual_pooled": _guarded(pool(site_cells)),
        "spatial": _with_level_guard(regression_stats(site_cells, mod="mod_mean", obs="obs_mean"), site_cells),
        "anomalies_annual": _guarded(pool(site_cells, anomalies=True)),
    }


def _guarded(moments: DataFrame) -> DataFrame:
    """Scores are null with two observations or fewer."""
    return moments.select(*regression_columns(ENOUGH_OBS))


def _with_level_guard(stats: DataFrame, cells: DataFrame) -> DataFrame:
    """Blank the scores of a mean if the level it came from has two observations or fewer."""
    enough = cells.agg(F.expr("coalesce(sum(n_obs), 0) > 2 AS enough")).scalar()
    scores = [f"CASE WHEN enough THEN {c} END AS {c}" for c in ("rsq", "rmse", "slope", "bias")]
    return stats.withColumn("enough", enough).selectExpr(*scores, "nvals")


def _annual_tables(adf: DataFrame, site_cells: DataFrame) -> dict[str, DataFrame]:
    iav = C.annual_anomalies(adf)
    fitted = C.fitted_by_site(adf, support="pairs")
    return {
        "adf": adf,
        "adf_stats": stats_of_moments(site_cells, ["sitename"], support="pairs"),
        "adf_fitted": fitted,
        "adf_lines": line_ends(fitted, ["sitename"]),
        "meandf": C.site_means(adf),
        "iavdf": iav,
        "iavdf_stats": stats_of_moments(pool(site_cells, ["sitename"], anomalies=True), ["sitename"]),
        "iavdf_fitted": C.fitted_by_site(iav),
    }


def evaluate_annual(adf: DataFrame, light: bool = True) -> Evaluation:
    """Annual, spatial and annual-anomaly levels only."""
    adf = adf if light else stage(adf, "adf")
    site_cells = stage(summarise(adf, ["sitename"]), "site_cells")
    tables = {} if light else _annual_tables(adf, site_cells)
    return Evaluation(stack_tables(_annual_levels(site_cells)), tables)


def evaluate_matched(matched: Matched, light: bool = True) -> Evaluation:
    """All ten levels. Daily, multi-day and annual rows are each aggregated once; see `pooling`."""
    if not light:
        matched = Matched(
            adf=stage(matched.adf, "adf"), mdf=matched.mdf, xdf=stage(matched.xdf, "xdf"), ddf=stage(matched.ddf, "ddf")
        )
    day_cells = stage(summarise(matched.ddf, ["sitename", F.dayofyear("date").alias("doy")]), "day_cells")
    bin_cells = stage(summarise(matched.xdf, ["sitename", F.dayofyear("inbin").alias("xoy")]), "bin_cells")
    site_cells = stage(summarise(matched.adf, ["sitename"]), "site_cells")

    regular_days = day_cells.where(F.col("doy") != 366)
    bin_cycle = interpolate_cycle(bin_cells.select("sitename", "xoy", "mod_mean", "obs_mean"), ["sitename"], "xoy", ["obs_mean"])
    annual = _annual_levels(site_cells)
    metrics = stack_tables({
        "daily_pooled": pool(day_cells).select(*regression_columns()),
        "xdaily_pooled": pool(bin_cells).select(*regression_columns()),
        "annual_pooled": annual["annual_pooled"],
        "monthly_pooled": regression_stats(matched.mdf, guarded=True),
        "spatial": annual["spatial"],
        "anomalies_annual": annual["anomalies_annual"],
        "meandoy": _with_level_guard(regression_stats(regular_days, mod="mod_mean", obs="obs_mean"), day_cells),
        "anomalies_daily": _guarded(pool(regular_days, anomalies=True)),
        "meanxoy": _with_level_guard(regression_stats(bin_cycle, mod="mod_mean", obs="obs_mean"), bin_cells),
        "anomalies_xdaily": _guarded(pool(bin_cells, anomalies=True)),
    })
    if light:
        return Evaluation(metrics)

    tables = _annual_tables(matched.adf, site_cells)
    idv, ixv = C.daily_anomalies(matched.ddf), C.xdaily_anomalies(matched.xdf)
    tables |= {
        "ddf": matched.ddf, "xdf": matched.xdf, "mdf": matched.mdf,
        "metrics_by_site": quick_metrics(matched.ddf, ["sitename"]),
        "meandoydf": C.mean_doy(matched.ddf),
        "meanxoydf": C.mean_xoy(matched.xdf),
        "idvdf": idv,
        "idvdf_stats": stats_of_moments(pool(regular_days, ["sitename"], anomalies=True), ["sitename"]),
        "idvdf_fitted": C.fitted_by_site(idv),
        "ixvdf": ixv,
        "ixvdf_stats": stats_of_moments(pool(bin_cells, ["sitename"], anomalies=True), ["sitename"]),
        "ixvdf_fitted": C.fitted_by_site(ixv),
    }
    if {"lat", "koeppen_code"} <= set(matched.ddf.columns):
        zones = C.mean_doy_by_zone(matched.ddf)
        tables |= {"meandoydf_byclim": zones, "meandoydf_byclim_stats": zone_metrics(zones, ["climatezone"])}
    return Evaluation(metrics, tables)


def evaluate(mod: DataFrame, settings: Settings, obs: Observations, light: bool = True) -> dict[str, Evaluation]:
    """Evaluate each variable of the settings. `mod` is flat: `sitename, date, <variables>`."""
    if settings.sites is not None:
        mod = keep_sites(mod, settings.sites)
        obs = Observations(**{
            name: (keep_sites(table, settings.sites) if table is not None and name != "breaks" else table)
            for name, table in vars(obs).items()
        })
    out = {}
    for variable, source in settings.benchmark.items():
        name = settings.obs_variable.get(variable, variable)
        if is_annual_only(source):
            adf = match_annual_skipping(model_series(mod, variable), obs.adf, name)
            out[variable] = evaluate_annual(adf, light)
        else:
            out[variable] = evaluate_matched(match_levels(mod, obs, variable, name, settings.min_days), light)
    return out


def metrics_table(evaluations: Mapping[str, Evaluation], columns: Sequence[str] = ("rsq", "rmse", "slope", "bias", "nvals")) -> DataFrame:
    """All variables and levels in one table."""
    return stack_tables({v: e.metrics for v, e in evaluations.items()}, label="variable").select("variable", "level", *columns)
