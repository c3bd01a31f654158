"""The evaluation of several variables from one roll-up of daily rows.

Model and observations are read once: their rows meet per site and day in one aggregate, which is written. Every level then follows
from mergeable cells with a struct per variable. Days add up to months, months to years, days to multi-day bins; a cell carries
sums, counts of known values and counts of rows, so that strict means (`known = rows`), sums of known days and the rule for complete
years (`known >= min_days`) hold at each level without going back to the days. Days, bins and years give co-moments by day of
year, by bin of the year and by site, and `pooling` merges those to the scores of all levels, for all variables at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.calendar import week_start
from ..operators.bins import assign_bins, week_breaks
from ..operators.gaps import interpolate_cycle
from ..operators.joins import join_null_safe, keep_sites
from ..operators.score import ENOUGH_OBS, regression_stats, stats_of_moments
from ..session import stage
from ..sources.nested import stack_tables
from .evaluation import Settings, is_annual_only
from .pooling import KNOWN, pool

ANNUAL_LEVELS = ("annual_pooled", "spatial", "anomalies_annual")
_SIDES = ("m", "o")


@dataclass(frozen=True)
class RollUp:
    """Co-moments by variable and site: of days by day of year, of bins by bin of the year, of years; and of all months by variable."""

    variables: DataFrame
    days: DataFrame
    bins: DataFrame
    months: DataFrame
    years: DataFrame

    def metrics(self) -> DataFrame:
        """variable, level and the scores of every level, as the evaluation of each variable on its own gives them."""
        regular = self.days.where(F.col("doy") != 366)
        by, sites = ["variable"], ["variable", "sitename"]
        cycle = interpolate_cycle(self.bins.select(*sites, "xoy", "mod_mean", "obs_mean"), sites, "xoy", ["obs_mean"])
        levels = {
            "daily_pooled": pool(self.days, by).select(*by, *S.regression_columns()),
            "xdaily_pooled": pool(self.bins, by).select(*by, *S.regression_columns()),
            "annual_pooled": _guarded(pool(self.years, by)),
            "monthly_pooled": _guarded(self.months),
            "spatial": _of_means(self.years, self.years),
            "anomalies_annual": _guarded(pool(self.years, by, anomalies=True)),
            "meandoy": _of_means(regular, self.days),
            "anomalies_daily": _guarded(pool(regular, by, anomalies=True)),
            "meanxoy": _of_means(cycle, self.bins),
            "anomalies_xdaily": _guarded(pool(self.bins, by, anomalies=True)),
        }
        stacked = stack_tables(levels).withColumnRenamed("variable", "_variable")
        wanted = self.variables.withColumn("_level", F.explode(F.when(F.col("annual_only"), F.array(*map(F.lit, ANNUAL_LEVELS))).otherwise(F.array(*map(F.lit, levels)))))
        full = wanted.join(stacked, (F.col("variable") == F.col("_variable")) & (F.col("_level") == F.col("level")), "left")
        scores = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c == "nvals" else F.col(c) for c in S.REGRESSION]
        return full.select("variable", F.col("_level").alias("level"), *scores)

    def site_scores(self) -> DataFrame:
        """variable, level, sitename, scores and intercept of sites with enough support: years, and all three kinds of anomalies."""
        sites = ["variable", "sitename"]
        regular = self.days.where(F.col("doy") != 366)
        anomalies = {"anomalies_annual": self.years, "anomalies_daily": regular, "anomalies_xdaily": self.bins}
        levels = {"annual": stats_of_moments(pool(self.years, sites), sites, "pairs")}
        levels |= {name: stats_of_moments(pool(cells, sites, anomalies=True), sites) for name, cells in anomalies.items()}
        known = self.variables.select(F.col("variable").alias("_v"), "annual_only")
        scored = stack_tables(levels).join(known, F.col("variable") == F.col("_v"))
        return scored.where(~F.col("annual_only") | F.col("level").isin("annual", "anomalies_annual")).drop("_v", "annual_only")


def _guarded(moments: DataFrame) -> DataFrame:
    return moments.select("variable", *S.regression_columns(ENOUGH_OBS))


def _of_means(means: DataFrame, cells: DataFrame) -> DataFrame:
    """Scores of cell means, null where the level they came from has two observations or fewer."""
    enough = cells.groupBy("variable").agg(F.expr("coalesce(sum(n_obs), 0) > 2 AS enough"))
    scored = join_null_safe(regression_stats(means, ["variable"], mod="mod_mean", obs="obs_mean"), enough, ["variable"])
    return scored.selectExpr("variable", *[f"CASE WHEN enough THEN {c} END AS {c}" for c in ("rsq", "rmse", "slope", "bias")], "nvals")


def _days(mod: DataFrame, obs: DataFrame, mod_names: Sequence[str], obs_names: Sequence[str]) -> DataFrame:
    """One row per site and day: `m` and `o` count the model's and the observations' rows, m0.. and o0.. are their values."""
    def side(df: DataFrame, mine: str, names: Sequence[str]) -> DataFrame:
        values = {s: [F.col(S.quoted(c)).cast("double") if s == mine else F.lit(None).cast("double") for c in names] for s in _SIDES}
        return df.select("sitename", "date", *[F.lit(int(s == mine)).alias(s) for s in _SIDES], *[c.alias(f"{s}{k}") for s in _SIDES for k, c in enumerate(values[s])])

    both = side(mod, "m", mod_names).unionByName(side(obs, "o", obs_names))
    return both.groupBy("sitename", "date").agg(*[F.sum(s).alias(s) for s in _SIDES], *[F.max(c).alias(c) for c in both.columns[4:]])


def _sums(columns: Sequence[str], first: bool) -> list[Column]:
    """Sum and number of known values per column, from days or from cells that have them."""
    sums = [F.sum(c if first else f"{c}_sum").alias(f"{c}_sum") for c in columns]
    return [*sums, *[(F.count(c) if first else F.sum(f"{c}_known")).alias(f"{c}_known") for c in columns], *[F.sum(s).alias(s) for s in _SIDES]]


def _strict(c: str, how: str = "mean") -> str:
    """Mean or sum of a cell, null if one of its rows has no value."""
    return f"CASE WHEN {c}_known = {c[0]} AND {c}_known > 0 THEN {c}_sum {f'/ {c}_known' if how == 'mean' else ''} END"


def _moments(rows: DataFrame, by: Sequence[Column | str], names: Sequence[str], chosen: Sequence[int]) -> DataFrame:
    """Long cells: `by`, variable, co-moments, means and counts of known values. All variables share one aggregate."""
    def cell(k: int) -> Column:
        known = [F.expr(e.replace("(mod)", f"(m{k})").replace("(obs)", f"(o{k})")) for e in KNOWN]
        return F.struct(*S.moment_columns(f"m{k}", f"o{k}"), *known).alias(f"cell{k}")

    wide = rows.groupBy(*by).agg(*[cell(k) for k in chosen])
    keys = [c for c in wide.columns if not c.startswith("cell")]
    fields = wide.schema[f"cell{chosen[0]}"].dataType.names
    long = F.array(*[F.struct(F.lit(names[k]).alias("variable"), *[F.col(f"cell{k}.{f}").alias(f) for f in fields]) for k in chosen])
    return wide.select(*keys, F.inline(long))


def roll_up(mod: DataFrame, obs: DataFrame, settings: Settings, breaks: DataFrame | None = None, annual: str = "sum") -> RollUp:
    """Roll daily rows of model (`sitename, date, <variables>`) and observations up to the cells of all levels.

    Multi-day bins are calendar weeks with an observation unless `breaks` (`brk`) are given; `annual` is how observations of a year
    add up, `"sum"` or `"mean"`. Model years are sums.
    """
    names = list(settings.benchmark)
    only = [is_annual_only(settings.benchmark[v]) for v in names]
    sources: Mapping[str, str] = settings.obs_variable
    if settings.sites is not None:
        mod, obs = keep_sites(mod, settings.sites), keep_sites(obs, settings.sites)
    days = stage(_days(mod, obs, names, [sources.get(v, v) for v in names]), "rollup_days")
    every = range(len(names))
    values = [f"{s}{k}" for s in _SIDES for k in every]
    full = [k for k in every if not only[k]] or list(every)

    months = days.groupBy("sitename", F.year("date").alias("year"), F.month("date").alias("month")).agg(*_sums(values, True))
    months = stage(months, "rollup_months")
    years = months.groupBy("sitename", "year").agg(*_sums(values, False)).where("o > 0")
    sums = {k: f"CASE WHEN m > 0 THEN coalesce(m{k}_sum, 0D) END" if only[k] else f"CASE WHEN m{k}_known >= {settings.min_days} THEN m{k}_sum END" for k in every}
    years = years.selectExpr("sitename", *[f"{sums[k]} AS m{k}" for k in every], *[f"{_strict(f'o{k}', annual)} AS o{k}" for k in every])

    week = F.col("date") if breaks is not None else week_start("date")
    placed = assign_bins(days, week_breaks(days.where("o > 0")) if breaks is None else breaks)
    own = F.col("inbin") if breaks is not None else week
    part = lambda bin_, sides: F.struct(bin_.alias("bin"), *[
        (F.col(c) if c[0] in sides else F.lit(None).cast(placed.schema[c].dataType)).alias(c) for c in [*_SIDES, *values]])
    parts = F.when(F.col("inbin").eqNullSafe(own), F.array(part(own, "mo"))).otherwise(F.array(part(own, "o"), part(F.col("inbin"), "m")))
    bins = placed.select("sitename", F.inline(parts)).where("bin IS NOT NULL").groupBy("sitename", "bin").agg(*_sums(values, True)).where("o > 0")
    bins = bins.selectExpr("sitename", "bin", *[f"try_divide(m{k}_sum, m{k}_known) AS m{k}" for k in every], *[f"{_strict(f'o{k}')} AS o{k}" for k in every])

    monthly = months.where("o > 0").selectExpr(*[f"{_strict(c)} AS {c}" for c in values])
    observed = days.where("o > 0")
    return RollUp(
        days.sparkSession.createDataFrame(list(zip(names, only)), "variable string, annual_only boolean"),
        stage(_moments(observed, ["sitename", F.dayofyear("date").alias("doy")], names, full), "rollup_day_cells"),
        stage(_moments(bins, ["sitename", F.dayofyear("bin").alias("xoy")], names, full), "rollup_bin_cells"),
        stage(_moments(monthly, [], names, full), "rollup_month_cells"),
        stage(_moments(years, ["sitename"], names, list(every)), "rollup_year_cells"),
    )
