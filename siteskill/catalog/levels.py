"""Observation levels, matching, components, anomalies and the evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bins
from ..operators.gaps import interpolate
from ..plans import components as C
from ..plans.evaluation import Settings, evaluate, metrics_table
from ..plans.levels import match_annual, match_levels, match_monthly, model_series
from ..plans.observations import build_catchment_observations, build_observations, build_observations_xdaily
from ..operators.score import stats_of_moments
from ..plans.pooling import pool, summarise
from ..plans.rollup import roll_up
from ..session import stage
from ..sources.nested import pivot_sources, stack_tables
from .case import Case
from .scoring import STAT_COLUMNS, _zones, zone_cycle_sql
from .sqlparts import lerp, stats, strict
from .views import forcing, site_daily, site_info, table

MIN_DAYS = 200


def daily(spark, sf):
    return stage(site_daily(spark, sf), "site_daily")


def known_obs(df):
    return df.where(F.col("obs").isNotNull()).select("sitename", "date", "obs")


def observations(spark, df, sf):
    return build_observations(known_obs(df), site_info(spark, sf), ["obs"])


def _obs_levels(spark, sf):
    obs = build_observations(daily(spark, sf).select("sitename", "date", "obs", "qc"), site_info(spark, sf), ["obs", "qc"])
    levels = {"daily": obs.ddf, "weekly": obs.xdf.drop("inbin"), "monthly": obs.mdf, "annual": obs.adf}
    return stack_tables(levels)


WEEK = "CAST(date - CAST(dayofweek(date) AS INTEGER) AS DATE)"
OBS_LEVELS_SQL = f"""
SELECT l.*, i.lat, i.koeppen_code FROM (
  SELECT 'daily' AS level, sitename, date, obs, qc FROM site_daily
  UNION ALL SELECT 'weekly', sitename, {WEEK}, {strict('avg', 'obs')}, {strict('avg', 'qc')} FROM site_daily GROUP BY 2, 3
  UNION ALL SELECT 'monthly', sitename, CAST(date_trunc('month', date) AS DATE), {strict('avg', 'obs')}, {strict('avg', 'qc')}
    FROM site_daily GROUP BY 2, 3
  UNION ALL SELECT 'annual', sitename, CAST(date_trunc('year', date) AS DATE), {strict('sum', 'obs')}, {strict('sum', 'qc')}
    FROM site_daily GROUP BY 2, 3) l JOIN site_info i USING (sitename)
"""


def _xdaily_levels(spark, sf):
    obs = build_observations_xdaily(daily(spark, sf), site_info(spark, sf), ["mod"], ["qc"], first="1990-01-01")
    return stack_tables({"xdaily": obs.xdf, "monthly": obs.mdf, "annual": obs.adf})


def _xdaily_limits(spark, sf):
    """Bins over the span of the data, and over a range that ends inside it, with the days left out."""
    df = daily(spark, sf)
    given = build_observations_xdaily(df, None, ["mod"], first="1993-01-05", last="1996-03-01")
    found = build_observations_xdaily(df, None, ["mod"])
    counts = {"given_outside": given.outside, "found_outside": found.outside}
    return stack_tables({
        "given": given.xdf.select("sitename", "date", "mod"), "found": found.xdf.select("sitename", "date", "mod"),
        **{k: t.select("sitename", F.lit(None).cast("date").alias("date"), F.col("n_outside").cast("double").alias("mod")) for k, t in counts.items()},
    })


XDAILY_LIMITS_SQL = f"""
WITH s AS (SELECT min(date) AS a FROM site_daily),
g AS (SELECT sitename, mod, date, CAST(floor(date_diff('day', DATE '1993-01-05', date) / 8.0) AS INTEGER) AS k,
             CAST(floor(date_diff('day', DATE '1993-01-05', DATE '1996-03-01') / 8.0) AS INTEGER) AS steps FROM site_daily),
p AS (SELECT sitename, mod, CASE WHEN date = CAST(DATE '1993-01-05' + steps * 8 AS DATE) THEN steps - 1 ELSE k END AS k, steps FROM g),
f AS (SELECT sitename, mod, CAST(a + CAST(floor(date_diff('day', a, date) / 8.0) AS INTEGER) * 8 AS DATE) AS bin FROM site_daily, s)
SELECT 'given' AS level, sitename, CAST(DATE '1993-01-05' + k * 8 AS DATE) AS date, {strict('avg', 'mod')} AS mod FROM p
  WHERE k >= 0 AND k < steps GROUP BY sitename, k
UNION ALL SELECT 'found', sitename, bin, {strict('avg', 'mod')} FROM f GROUP BY sitename, bin
UNION ALL SELECT 'given_outside', sitename, NULL, count(*) FILTER (WHERE k < 0 OR k >= steps) FROM p GROUP BY sitename
UNION ALL SELECT 'found_outside', sitename, NULL, 0 FROM f GROUP BY sitename
"""


BIN8 = "CAST(DATE '1990-01-01' + CAST(floor(date_diff('day', DATE '1990-01-01', date) / 8.0) AS INTEGER) * 8 AS DATE)"
XDAILY_SQL = f"""
SELECT 'xdaily' AS level, sitename, {BIN8} AS date, {BIN8} AS inbin, {strict('avg', 'mod')} AS mod, {strict('avg', 'qc')} AS qc
  FROM site_daily GROUP BY sitename, {BIN8}
UNION ALL SELECT 'monthly', sitename, CAST(date_trunc('month', date) AS DATE) AS m, NULL, {strict('avg', 'mod')}, {strict('avg', 'qc')}
  FROM site_daily GROUP BY sitename, m
UNION ALL SELECT 'annual', sitename, CAST(date_trunc('year', date) AS DATE) AS y, NULL, {strict('avg', 'mod')}, {strict('avg', 'qc')}
  FROM site_daily GROUP BY sitename, y
"""


def _matched(spark, sf):
    df = daily(spark, sf)
    m = match_levels(df.select("sitename", "date", "mod"), observations(spark, df, sf), "mod", "obs", MIN_DAYS)
    return stack_tables({
        "annual": m.adf.select("sitename", "date", "mod", "obs", "n"),
        "monthly": m.mdf.select("sitename", "date", "mod", "obs", "n"),
        "xdaily": m.xdf.select("sitename", F.col("inbin").alias("date"), "mod", "obs", F.col("n_mod").alias("n")),
        "daily": m.ddf.select("sitename", "date", "mod", "obs"),
    })


def level_ctes(mod: str = "mod", obs: str = "obs", where: str = "true", series: str = "site_daily") -> str:
    """Tables adf, mdf, xdf and ddf of one variable; observations are the rows where column obs is known."""
    return f"""
d AS (SELECT sitename, date, {mod} AS mod, {obs} AS obs, obs IS NOT NULL AS observed FROM {series} WHERE {where}),
o AS (SELECT sitename, date, obs FROM d WHERE observed),
m AS (SELECT sitename, date, mod FROM d WHERE mod IS NOT NULL),
brk AS (SELECT DISTINCT {WEEK} AS brk FROM o EXCEPT SELECT min({WEEK}) FROM o),
adf AS (SELECT a.*, b.mod, b.n FROM
  (SELECT sitename, CAST(date_trunc('year', date) AS DATE) AS date, {strict('sum', 'obs')} AS obs FROM o GROUP BY 1, 2) a LEFT JOIN
  (SELECT sitename, CAST(date_trunc('year', date) AS DATE) AS date, CASE WHEN count(*) >= {MIN_DAYS} THEN sum(mod) END AS mod,
          count(*) AS n FROM m GROUP BY 1, 2) b ON a.sitename = b.sitename AND a.date = b.date),
mdf AS (SELECT a.*, b.mod, b.n FROM
  (SELECT sitename, CAST(date_trunc('month', date) AS DATE) AS date, {strict('avg', 'obs')} AS obs FROM o GROUP BY 1, 2) a LEFT JOIN
  (SELECT sitename, CAST(date_trunc('month', date) AS DATE) AS date, {strict('avg', 'mod')} AS mod, count(*) AS n
   FROM d GROUP BY 1, 2) b ON a.sitename = b.sitename AND a.date = b.date),
xm AS (SELECT sitename, brk, avg(mod) AS mod, count(*) AS n FROM m ASOF JOIN brk ON m.date >= brk.brk
       WHERE date < (SELECT max(brk) FROM brk) GROUP BY 1, 2),
xdf AS (SELECT a.*, b.mod, b.n FROM (SELECT sitename, {WEEK} AS date, {strict('avg', 'obs')} AS obs FROM o GROUP BY 1, 2) a
        LEFT JOIN xm b ON a.sitename = b.sitename AND a.date = b.brk),
ddf AS (SELECT o.*, m.mod FROM o LEFT JOIN m ON o.sitename = m.sitename AND o.date = m.date)
"""


LEVEL_CTES = level_ctes()
MATCHED_SQL = f"""
WITH {LEVEL_CTES}
SELECT 'annual' AS level, sitename, date, mod, obs, n FROM adf UNION ALL SELECT 'monthly', sitename, date, mod, obs, n FROM mdf
UNION ALL SELECT 'xdaily', sitename, date, mod, obs, n FROM xdf UNION ALL SELECT 'daily', sitename, date, mod, obs, NULL FROM ddf
"""


def _minus(table: str, key: str, where: str = "true") -> str:
    """Rows minus their group means; rows outside `where` get nulls."""
    return f"""(SELECT t.sitename, t.date, t.obs - g.o AS obs, t.mod - g.m AS mod FROM {table} t LEFT JOIN
        (SELECT sitename AS s, {key} AS k, avg(obs) AS o, avg(mod) AS m FROM {table} WHERE {where} GROUP BY 1, 2) g
        ON t.sitename = g.s AND {key} = g.k)"""


def _evaluation_sql(variable: str = "mod", ctes: str = LEVEL_CTES) -> str:
    doy = "(SELECT sitename, dayofyear(date) AS d, avg(obs) AS obs, avg(mod) AS mod FROM ddf WHERE dayofyear(date) <> 366 GROUP BY 1, 2)"
    xoy_raw = "(SELECT sitename, dayofyear(date) AS d, avg(obs) AS obs, avg(mod) AS mod FROM xdf GROUP BY 1, 2)"
    xoy = f"({lerp(xoy_raw, 'sitename', 'd', ['obs'])})"
    spatial = "(SELECT sitename, avg(obs) AS obs, avg(mod) AS mod FROM adf GROUP BY 1)"
    guarded = {
        "daily_pooled": "ddf", "xdaily_pooled": "xdf", "annual_pooled": "adf", "monthly_pooled": "mdf", "spatial": spatial,
        "anomalies_annual": _minus("adf", "1"), "meandoy": doy,
        "anomalies_daily": _minus("ddf", "dayofyear(date)", "dayofyear(date) <> 366"),
        "meanxoy": xoy, "anomalies_xdaily": _minus("xdf", "dayofyear(date)"),
    }
    parts = " UNION ALL ".join(
        f"SELECT '{variable}' AS variable, '{level}' AS level, rsq, rmse, slope, bias, nvals FROM ({stats(t)})" for level, t in guarded.items()
    )
    return f"WITH {ctes} {parts}"


#: A second variable: its observations have gaps of their own, in July of even years.
SECOND = {
    "mod": "mod * 0.5 + 10",
    "obs": "CASE WHEN NOT (year(date) % 2 = 0 AND month(date) = 7 AND dayofmonth(date) = 7) THEN qc * 100 END",
}
COLD = "koeppen_code IN ('Cfb', 'Dfb')"


def _two(spark, sf, cold=False):
    """The roll-up of two variables: observations are the rows where the first one is known."""
    df = daily(spark, sf)
    mod = df.selectExpr("sitename", "date", "mod AS gpp", f"{SECOND['mod']} AS le")
    obs = df.where("obs IS NOT NULL").selectExpr("sitename", "date", "obs AS gpp", f"{SECOND['obs']} AS heat")
    sites = site_info(spark, sf).where(COLD).select("sitename") if cold else None
    settings = Settings({"gpp": "fluxnet", "le": "fluxnet_daily"}, sites, MIN_DAYS, {"le": "heat"})
    return roll_up(mod, obs, settings)


def _two_sql(cold=False) -> str:
    where = f"sitename IN (SELECT sitename FROM site_info WHERE {COLD})" if cold else "true"
    one = _evaluation_sql("gpp", level_ctes(where=where))
    return f"SELECT * FROM ({one}) UNION ALL SELECT * FROM ({_evaluation_sql('le', level_ctes(SECOND['mod'], SECOND['obs'], where))})"


def _annual_source(spark, sf):
    """One variable with all levels, one whose observations are annual."""
    df = daily(spark, sf)
    settings = Settings({"mod": "fluxnet", "aet": "camels"}, min_days=MIN_DAYS, obs_variable={"mod": "obs", "aet": "obs"})
    mod = df.select("sitename", "date", "mod", F.when(F.year("date") % 2 == 0, F.col("mod")).alias("aet"))
    return roll_up(mod, known_obs(df), settings).metrics()


def _annual_source_sql() -> str:
    spatial = "(SELECT sitename, avg(obs) AS obs, avg(mod) AS mod FROM aet GROUP BY 1)"
    levels = {"annual_pooled": "aet", "spatial": spatial, "anomalies_annual": _minus("aet", "1")}
    parts = " UNION ALL ".join(
        f"SELECT 'aet' AS variable, '{level}' AS level, rsq, rmse, slope, bias, nvals FROM ({stats(t)})" for level, t in levels.items())
    return f"""SELECT * FROM ({_evaluation_sql()}) UNION ALL SELECT * FROM (
        WITH {LEVEL_CTES}, aet AS (SELECT a.sitename, a.date, a.obs, b.mod FROM adf a JOIN
          (SELECT sitename, CAST(date_trunc('year', date) AS DATE) AS date, coalesce(sum(CASE WHEN year(date) % 2 = 0 THEN mod END), 0) AS mod
           FROM d GROUP BY 1, 2) b ON a.sitename = b.sitename AND a.date = b.date) {parts})"""


def _site_scores_sql() -> str:
    def one(variable: str, ctes: str) -> str:
        both = "n_obs > 2 AND n_mod > 2"
        levels = {
            "annual": stats("adf", "sitename", where="n > 2"), "anomalies_annual": stats(_minus("adf", "1"), "sitename", where=both),
            "anomalies_daily": stats(_minus("ddf", "dayofyear(date)", "dayofyear(date) <> 366"), "sitename", where=both),
            "anomalies_xdaily": stats(_minus("xdf", "dayofyear(date)"), "sitename", where=both),
        }
        return f"WITH {ctes} " + " UNION ALL ".join(f"SELECT '{variable}' AS variable, '{k}' AS level, * FROM ({q})" for k, q in levels.items())

    return f"SELECT * FROM ({one('gpp', LEVEL_CTES)}) UNION ALL SELECT * FROM ({one('le', level_ctes(SECOND['mod'], SECOND['obs']))})"


FULL_TABLES = ("adf_stats", "iavdf_stats", "idvdf_stats", "ixvdf_stats")


SOME_COMPLETE = "mod IS NOT NULL OR sitename < 'S12'"


def _full(spark, sf, where="true"):
    """The tables of a full evaluation, by way of the matched levels."""
    df = daily(spark, sf).where(where)
    settings = Settings({"mod": "fluxnet"}, min_days=MIN_DAYS, obs_variable={"mod": "obs"})
    return evaluate(df.select("sitename", "date", "mod"), settings, observations(spark, df, sf), light=False)["mod"].tables


def _full_stats_sql() -> str:
    both = "n_obs > 2 AND n_mod > 2"
    levels = {
        "adf_stats": stats("adf", "sitename", where="n > 2"), "iavdf_stats": stats(_minus("adf", "1"), "sitename", where=both),
        "idvdf_stats": stats(_minus("ddf", "dayofyear(date)", "dayofyear(date) <> 366"), "sitename", where=both),
        "ixvdf_stats": stats(_minus("xdf", "dayofyear(date)"), "sitename", where=both),
    }
    return f"WITH {LEVEL_CTES} " + " UNION ALL ".join(f"SELECT '{k}' AS level, * FROM ({q})" for k, q in levels.items())


def evaluation(spark, sf):
    """The flagship: all ten levels for one variable."""
    df = daily(spark, sf)
    settings = Settings({"mod": "fluxnet"}, min_days=MIN_DAYS, obs_variable={"mod": "obs"})
    return metrics_table(evaluate(df.select("sitename", "date", "mod"), settings, observations(spark, df, sf)))


def _evaluation_annual(spark, sf):
    f = forcing(spark, sf)
    obs = build_catchment_observations(f)
    mod = f.select("sitename", "date", (F.col("gpp") * 0.06).alias("aet"))
    return metrics_table(evaluate(mod, Settings({"aet": "camels"}), obs))


CATCHMENT_SQL = """
SELECT sitename, CAST(date_trunc('year', date) AS DATE) AS date, coalesce(sum(rain * 86400 - runoff), 0) AS aet FROM forcing GROUP BY 1, 2
"""


def _evaluation_annual_sql() -> str:
    spatial = "(SELECT sitename, avg(obs) AS obs, avg(mod) AS mod FROM adf GROUP BY 1)"
    levels = {"annual_pooled": "adf", "spatial": spatial, "anomalies_annual": _minus("adf", "1")}
    parts = " UNION ALL ".join(
        f"SELECT 'aet' AS variable, '{level}' AS level, rsq, rmse, slope, bias, nvals FROM ({stats(t)})" for level, t in levels.items()
    )
    return f"""WITH adf AS (SELECT a.sitename, a.date, a.aet AS obs, b.mod FROM ({CATCHMENT_SQL}) a JOIN
        (SELECT sitename, CAST(date_trunc('year', date) AS DATE) AS date, coalesce(sum(gpp * 0.06), 0) AS mod FROM forcing GROUP BY 1, 2) b
        ON a.sitename = b.sitename AND a.date = b.date) {parts}"""


def _annual(spark, sf):
    df = daily(spark, sf)
    return match_annual(model_series(df, "mod"), observations(spark, df, sf).adf, "obs", MIN_DAYS)


def _site_stats_sql() -> str:
    pieces = [
        f"SELECT 'annual' AS level, * FROM ({stats('adf', 'sitename', where='n > 2')})",
        f"SELECT 'anomalies_annual', * FROM ({stats(_minus('adf', '1'), 'sitename', where='n_obs > 2 AND n_mod > 2')})",
    ]
    return f"WITH {LEVEL_CTES} {' UNION ALL '.join(pieces)}"


def _annual_site_stats(spark, sf):
    cells = stage(summarise(_annual(spark, sf), ["sitename"]), "cells")
    return stack_tables({
        "annual": stats_of_moments(pool(cells, ["sitename"]), ["sitename"], support="pairs"),
        "anomalies_annual": stats_of_moments(pool(cells, ["sitename"], anomalies=True), ["sitename"]),
    })


def _anomaly_stats(spark, sf):
    """Per-site anomaly scores from the cell summaries; the SQL builds the anomaly rows."""
    df = daily(spark, sf)
    days = df.withColumn("doy", F.dayofyear("date")).where(F.col("doy") != 366)
    xdf = _eight_days(df)
    day_cells = stage(summarise(days, ["sitename", "doy"]), "day_cells")
    bin_cells = stage(summarise(xdf, ["sitename", F.dayofyear("inbin").alias("xoy")]), "bin_cells")
    return stack_tables({
        "daily": stats_of_moments(pool(day_cells, ["sitename"], anomalies=True), ["sitename"]),
        "xdaily": stats_of_moments(pool(bin_cells, ["sitename"], anomalies=True), ["sitename"]),
    })


def _anomaly_stats_sql() -> str:
    where = "n_obs > 2 AND n_mod > 2"
    return f"""WITH x AS (SELECT sitename, {BIN8} AS date, avg(obs) AS obs, avg(mod) AS mod FROM site_daily GROUP BY sitename, {BIN8})
        SELECT 'daily' AS level, * FROM ({stats(_minus('site_daily', 'dayofyear(date)', 'dayofyear(date) <> 366'), 'sitename', where=where)})
        UNION ALL SELECT 'xdaily', * FROM ({stats(_minus('x', 'dayofyear(date)'), 'sitename', where=where)})"""


def _eight_days(df):
    binned = bins.regular_bins(df, 8, first="1990-01-01")
    return binned.groupBy("sitename", "inbin").agg(F.avg("mod").alias("mod"), F.avg("obs").alias("obs"))


def _xdf(spark, sf):
    return _eight_days(site_daily(spark, sf))


CYCLE = "avg(obs) AS obs_mean, min(obs) AS obs_min, max(obs) AS obs_max, avg(mod) AS mod_mean, min(mod) AS mod_min, max(mod) AS mod_max"
CYCLE_COLUMNS = "obs_mean:f obs_min:f obs_max:f mod_mean:f mod_min:f mod_max:f"


def _bins_both_ways(spark, sf):
    df = daily(spark, sf).select("sitename", "date")
    span = df.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    row = span.select(F.struct("first", "last").alias("span")).scalar()
    table = bins.assign_bins(df, bins.breaks_table(df, 8))
    placed = table.withColumn("_span", row)
    regular = bins.regular_bin(F.col("date"), F.col("_span.first"), 8, F.col("_span.last"))
    return placed.select("sitename", "date", "inbin", regular.alias("regular"))


def _breaks_within_days(spark, sf):
    """Events by breaks every few hours and one in between, and by uneven breaks of a number whose last one counts."""
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    regular = span.selectExpr("explode(sequence(a, z, INTERVAL '07:35' HOUR TO MINUTE)) AS brk")
    breaks = regular.unionByName(span.selectExpr("a + INTERVAL 90 MINUTES AS brk"))
    numbers = spark.createDataFrame([(x,) for x in (20.0, 5.0, -1e9, 5.5, 21.0, None)], "brk double")
    placed = bins.assign_breaks(e, "ts", breaks, into="bin")
    return bins.assign_breaks(placed, "value", numbers, include_last=True, into="number").withColumn("bin", F.date_format("bin", "yyyy-MM-dd HH:mm:ss"))


CASES = {
    "l2_observation_levels": Case("level:s sitename:s date:d obs:f qc:f lat:f koeppen_code:s", _obs_levels, OBS_LEVELS_SQL),
    "l3_catchment_observations": Case(
        "sitename:s date:d aet:f", lambda s, d: build_catchment_observations(forcing(s, d)).adf, CATCHMENT_SQL),
    "l4_observations_by_8_days": Case("level:s sitename:s date:d inbin:d mod:f qc:f", _xdaily_levels, XDAILY_SQL),
    "l4_bins_by_data_and_by_limits": Case("level:s sitename:s date:d mod:f", _xdaily_limits, XDAILY_LIMITS_SQL),
    "l5_match_levels": Case("level:s sitename:s date:d mod:f obs:f n:i", _matched, MATCHED_SQL),
    "d3_right_join_to_observations": Case(
        "sitename:s date:d mod:f obs:f n:i",
        lambda s, d: (lambda df: match_monthly(df.select("sitename", "date", "mod"), observations(s, df, d).mdf, "obs"))(daily(s, d)),
        f"WITH {LEVEL_CTES} SELECT * FROM mdf",
    ),
    "l6_annual_stats_by_site": Case(f"level:s sitename:s {STAT_COLUMNS} intercept:f", _annual_site_stats, _site_stats_sql()),
    "l7_mean_day_of_year": Case(
        f"sitename:s doy:i {CYCLE_COLUMNS} obs_mean_plot:f obs_min_plot:f obs_max_plot:f", lambda s, d: C.mean_doy(site_daily(s, d)),
        lerp(f"(SELECT sitename, dayofyear(date) AS doy, {CYCLE} FROM site_daily WHERE dayofyear(date) <> 366 GROUP BY 1, 2)",
             "sitename", "doy", ["obs_mean", "obs_min", "obs_max"], "_plot"),
    ),
    "l8_mean_day_of_year_by_zone": Case(
        f"koeppen_code:s hemisphere:s doy:i {CYCLE_COLUMNS} nsites:i climatezone:s",
        lambda s, d: _zones(s, d), zone_cycle_sql(),
    ),
    "c15_large_zones": Case(
        "climatezone:s doy:i nsites:i",
        lambda s, d: C.large_zones(_zones(s, d), 2),
        f"""WITH z AS ({zone_cycle_sql()}) SELECT climatezone, doy, nsites FROM z WHERE climatezone IN
            (SELECT climatezone FROM z GROUP BY 1 HAVING arg_min(nsites, doy) > 2)""",
    ),
    "g2_first_zones": Case(
        "climatezone:s doy:i nsites:i",
        lambda s, d: C.zone_page(_zones(s, d), 4, 2),
        f"""WITH z AS ({zone_cycle_sql()}) SELECT climatezone, doy, nsites FROM z WHERE climatezone IN
            (SELECT DISTINCT climatezone FROM z ORDER BY 1 LIMIT 4 OFFSET 4)""",
    ),
    "l9_mean_bin_of_year": Case(
        f"sitename:s xoy:i {CYCLE_COLUMNS}", lambda s, d: C.mean_xoy(_xdf(s, d)),
        lerp(f"""(SELECT sitename, dayofyear(date) AS xoy, {CYCLE} FROM (SELECT sitename, {BIN8} AS date, avg(obs) AS obs, avg(mod) AS mod
             FROM site_daily GROUP BY sitename, {BIN8}) GROUP BY 1, 2)""", "sitename", "xoy", ["obs_mean", "obs_min", "obs_max"]),
    ),
    "l10_anomaly_stats_by_site": Case(f"level:s sitename:s {STAT_COLUMNS} intercept:f", _anomaly_stats, _anomaly_stats_sql()),
    "f6_daily_anomalies": Case(
        "sitename:s date:d mod:f obs:f", lambda s, d: C.daily_anomalies(site_daily(s, d)),
        f"SELECT * FROM {_minus('site_daily', 'dayofyear(date)', 'dayofyear(date) <> 366')}",
    ),
    "f6_anomalies_by_8_days": Case(
        "sitename:s date:d mod:f obs:f", lambda s, d: C.xdaily_anomalies(_xdf(s, d)).withColumnRenamed("inbin", "date"),
        f"""WITH x AS (SELECT sitename, {BIN8} AS date, avg(obs) AS obs, avg(mod) AS mod FROM site_daily GROUP BY sitename, {BIN8})
            SELECT * FROM {_minus('x', 'dayofyear(date)')}""",
    ),
    "f6_annual_anomalies": Case(
        "sitename:s date:d mod:f obs:f", lambda s, d: C.annual_anomalies(_annual(s, d)), f"WITH {LEVEL_CTES} SELECT * FROM {_minus('adf', '1')}"),
    "f7_linear_interpolation": Case(
        "sitename:s date:d obs:f obs_filled:f mod_filled:f",
        lambda s, d: interpolate(daily(s, d), ["sitename"], "date", ["obs", "mod"], suffix="_filled"),
        lerp("site_daily", "sitename", "date", ["obs", "mod"], "_filled"),
    ),
    "f8_time_bins": Case(
        "sitename:s date:d inbin:d regular:d", _bins_both_ways,
        """WITH s AS (SELECT min(date) AS a, max(date) AS z FROM site_daily),
           b AS (SELECT sitename, date, CAST(a + CAST(floor(date_diff('day', a, date) / 8.0) AS INTEGER) * 8 AS DATE) AS bin,
                        CAST(a + CAST(floor(date_diff('day', a, z) / 8.0) AS INTEGER) * 8 AS DATE) AS last FROM site_daily, s)
           SELECT sitename, date, CASE WHEN bin < last THEN bin END AS inbin, CASE WHEN bin < last THEN bin END AS regular FROM b""",
    ),
    "f8_breaks_within_days": Case(
        "event_id:i bin:s number:f", _breaks_within_days,
        """WITH t AS (SELECT min(ts) AS a, max(ts) AS z FROM events),
           b AS (SELECT unnest(generate_series(a, z, INTERVAL '7 hours 35 minutes')) AS brk FROM t UNION SELECT a + INTERVAL 90 MINUTE FROM t),
           v AS (SELECT unnest([-1e9, 5.0, 5.5, 20.0, 21.0]) AS edge),
           n AS (SELECT event_id, max(edge) AS number FROM events LEFT JOIN v ON value >= edge AND value <= 21 GROUP BY 1)
           SELECT e.event_id, CASE WHEN ts < (SELECT max(brk) FROM b) THEN strftime(brk, '%Y-%m-%d %H:%M:%S') END AS bin,
                  CASE WHEN number = 21 THEN 20 ELSE number END AS number
           FROM events e ASOF LEFT JOIN b ON e.ts >= b.brk JOIN n ON n.event_id = e.event_id""",
    ),
    "f9_break_sequence": Case(
        "brk:d", lambda s, d: bins.breaks_table(site_daily(s, d), 8),
        "SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 8 DAY)) AS DATE) AS brk FROM site_daily",
    ),
    "f10_week_breaks": Case(
        "brk:d", lambda s, d: bins.week_breaks(daily(s, d)),
        f"SELECT DISTINCT {WEEK} AS brk FROM site_daily EXCEPT SELECT min({WEEK}) FROM site_daily",
    ),
    "b7_pivot_sources": Case(
        "sitename:s doy:i source:s value:f",
        lambda s, d: pivot_sources(C.mean_doy(site_daily(s, d)), ["sitename", "doy"], ["obs_mean", "mod_mean"], "value"),
        """WITH c AS (SELECT sitename, dayofyear(date) AS doy, avg(obs) AS obs_mean, avg(mod) AS mod_mean FROM site_daily
                      WHERE dayofyear(date) <> 366 GROUP BY 1, 2)
           SELECT sitename, doy, 'obs_mean' AS source, obs_mean AS value FROM c UNION ALL SELECT sitename, doy, 'mod_mean', mod_mean FROM c""",
    ),
    "l11_evaluate": Case(f"variable:s level:s {STAT_COLUMNS}", evaluation, _evaluation_sql()),
    "l11_evaluate_two_variables": Case(f"variable:s level:s {STAT_COLUMNS}", lambda s, d: _two(s, d).metrics(), _two_sql()),
    "l11_evaluate_sites": Case(f"variable:s level:s {STAT_COLUMNS}", lambda s, d: _two(s, d, True).metrics(), _two_sql(True)),
    "l11_evaluate_annual_source": Case(f"variable:s level:s {STAT_COLUMNS}", _annual_source, _annual_source_sql()),
    "l11_site_scores": Case(f"variable:s level:s sitename:s {STAT_COLUMNS} intercept:f", lambda s, d: _two(s, d).site_scores(), _site_scores_sql()),
    "a5_full_stats_by_site": Case(
        f"level:s sitename:s {STAT_COLUMNS} intercept:f", lambda s, d: (lambda t: stack_tables({k: t[k] for k in FULL_TABLES}))(_full(s, d)), _full_stats_sql()),
    "a5_full_metrics_by_site": Case(
        "sitename:s rsq:f mae:f rmse:f", lambda s, d: _full(s, d, SOME_COMPLETE)["metrics_by_site"],
        f"""WITH {level_ctes(where=SOME_COMPLETE)} SELECT sitename, CASE WHEN complete THEN power(regr_sxy(obs, mod), 2) / nullif(regr_sxx(obs, mod) * regr_syy(obs, mod), 0) END AS rsq,
            CASE WHEN complete THEN avg(abs(mod - obs)) END AS mae, CASE WHEN complete THEN sqrt(avg((mod - obs) * (mod - obs))) END AS rmse
            FROM (SELECT *, count(*) OVER (PARTITION BY sitename) = count(mod + obs) OVER (PARTITION BY sitename) AS complete FROM ddf) GROUP BY sitename, complete""",
    ),
    "a5_full_annual_lines": Case(
        "sitename:s xmin:f xmax:f ymin:f ymax:f", lambda s, d: _full(s, d)["adf_lines"],
        f"""WITH {LEVEL_CTES}, fit AS (SELECT sitename, slope, intercept FROM ({stats('adf', 'sitename', where='n > 2')}))
            SELECT sitename, min(mod) AS xmin, max(mod) AS xmax, arg_min(intercept + slope * mod, mod) AS ymin, arg_max(intercept + slope * mod, mod) AS ymax
            FROM adf JOIN fit USING (sitename) WHERE mod IS NOT NULL AND obs IS NOT NULL GROUP BY 1""",
    ),
    "l11_evaluate_catchments": Case(f"variable:s level:s {STAT_COLUMNS}", _evaluation_annual, _evaluation_annual_sql()),
}
