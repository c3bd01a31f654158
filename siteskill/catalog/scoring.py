"""Scores, fits and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import skip_sum, strict_mean, strict_sum
from ..operators import score
from ..operators.correlation import correlation, correlation_matrix, kendall
from ..operators.density import axis_limit
from ..operators.joins import attach_metadata
from ..operators.quantiles import median_and_terciles, quantiles
from ..plans.components import fitted_by_site, mean_doy_by_zone, site_means
from ..plans.levels import annual_totals
from ..session import stage
from ..sources.nested import stack_tables
from .case import Case
from .sqlparts import moments, stats, strict
from .views import site_daily, site_info, table

STAT_COLUMNS = "rsq:f rmse:f slope:f bias:f nvals:i"
METRIC_SQL = """
SELECT rmse, sxy * sxy / NULLIF(sxx * syy, 0) AS rsq, mae, n, sxy / NULLIF(sxx, 0) AS slope, my AS mean_obs,
       rmse / NULLIF(my, 0) AS prmse, mae / NULLIF(my, 0) AS pmae, bias, pbias, n_zero_obs, rmse / NULLIF(my, 0) AS rel_rmse,
       bias / NULLIF(my, 0) AS rel_bias
FROM (SELECT {m}, avg(abs(mod - obs)) AS mae, avg((mod - obs) / NULLIF(obs, 0)) AS pbias,
             count(CASE WHEN obs = 0 THEN 1 END) AS n_zero_obs
      FROM {t} WHERE mod IS NOT NULL AND obs IS NOT NULL)
"""


def _annual(spark, sf):
    daily = site_daily(spark, sf)
    mod = annual_totals(daily.select("sitename", "date", "mod"), 200).select("sitename", "year", "mod")
    obs = daily.groupBy("sitename", F.year("date").alias("year")).agg(F.avg("obs").alias("obs"))
    return mod.join(obs, ["sitename", "year"], "right")


ANNUAL_SQL = """
SELECT o.sitename, o.year, m.mod, o.obs
FROM (SELECT sitename, year(date) AS year, avg(obs) AS obs FROM site_daily GROUP BY 1, 2) o
LEFT JOIN (SELECT sitename, year(date) AS year, CASE WHEN count(*) >= 200 THEN sum(mod) END AS mod
           FROM site_daily WHERE mod IS NOT NULL GROUP BY 1, 2) m ON m.sitename = o.sitename AND m.year = o.year
"""


def _metrics_long(spark, sf):
    return score.metrics_long(score.metric_set(site_daily(spark, sf)))


def _relative(spark, sf):
    return score.metric_set(site_daily(spark, sf), ["sitename"], relative=True)


#: Quantiles of a column with few ties and of one with many; with a small accuracy every group counts as large.
LARGE_GROUPS = {"low": ("value", 0.02), "half": ("value", 0.5), "high": ("value", 0.999), "flat": ("k", 0.66)}


def _event_values(spark, sf):
    e = table(spark, sf, "events")
    number = F.get_json_object("props", "$.k").cast("double")
    return e.select("user_id", "event_type", F.col("value"), number.alias("k"), (F.col("value") * (number + 1)).alias("mix"))


EVENTS_SQL = """(SELECT user_id, event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
                        value * (CAST(json_extract(props, '$.k') AS DOUBLE) + 1) AS mix FROM events)"""


def _pair_rows(spark, sf):
    return correlation_matrix(_event_values(spark, sf), ["value", "k", "mix"], "pearson", digits=None)


def _rank_rows(spark, sf):
    return correlation_matrix(_event_values(spark, sf), ["value", "k", "mix"], "spearman", digits=None)


PAIRS = (("value", "k"), ("value", "mix"), ("k", "mix"))
PEARSON_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, sxy / NULLIF(sqrt(sxx) * sqrt(syy), 0) AS cor, n FROM (SELECT {moments(a, b)} FROM {EVENTS_SQL})"
    for a, b in PAIRS
)


def _gappy(spark, sf):
    """The event values with nulls of their own in each of three columns."""
    gap = lambda c, n: F.when(F.col("user_id") % n != 0, F.col(c)).alias(c)
    return _event_values(spark, sf).select("event_type", gap("value", 3), gap("k", 5), gap("mix", 7))


GAPPY_SQL = f"""(SELECT event_type, CASE WHEN user_id % 3 <> 0 THEN value END AS value, CASE WHEN user_id % 5 <> 0 THEN k END AS k,
                        CASE WHEN user_id % 7 <> 0 THEN mix END AS mix FROM {EVENTS_SQL})"""


def rounded_mean(column: str, digits: int):
    """The mean, half a digit up. Sums of floats follow the order of rows, so a mean that ends in a 5 first loses what they add."""
    return F.round(F.round(F.avg(column), 9), digits)


def _positive_sites(spark, sf):
    """Site means, few enough for SQL to compare all pairs, moved so that some are not positive."""
    means = site_daily(spark, sf).groupBy("sitename", F.year("date").alias("year")).agg(
        (rounded_mean("obs", 1) - 37).alias("obs"), (rounded_mean("mod", 1) - 36).alias("mod"), rounded_mean("qc", 2).alias("qc"))
    return correlation_matrix(means, ["obs", "mod", "qc"], "kendall", digits=None, positive_only=True)


def _positive_kendall_sql() -> str:
    def one(a: str, b: str) -> str:
        return f"""SELECT '{a}' AS a, '{b}' AS b, sum(sign(y.{a} - x.{a}) * sign(y.{b} - x.{b}))
            / sqrt(sum(abs(sign(y.{a} - x.{a}))) * sum(abs(sign(y.{b} - x.{b})))) AS cor, (SELECT count(*) FROM p) AS n FROM p x JOIN p y ON x.id < y.id"""

    return f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY sitename, year) AS id FROM (
        SELECT sitename, year(date) AS year, round(avg(obs), 1) - 37 AS obs, round(avg(mod), 1) - 36 AS mod, round(avg(qc), 2) AS qc FROM site_daily GROUP BY 1, 2)
        WHERE obs > 0 AND mod > 0 AND qc > 0) {' UNION ALL '.join(one(a, b) for a, b in (('obs', 'mod'), ('obs', 'qc'), ('mod', 'qc')))}"""


def spearman_sql(source: str, a: str, b: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    same = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""
    SELECT {keys}sxy / NULLIF(sqrt(sxx) * sqrt(syy), 0) AS cor, n FROM (
      SELECT {keys}{moments('ra', 'rb')} FROM (
        SELECT {keys}
          rank() OVER ({part} ORDER BY {a}) + (count(*) OVER (PARTITION BY {same}{a}) - 1) / 2.0::DOUBLE AS ra,
          rank() OVER ({part} ORDER BY {b}) + (count(*) OVER (PARTITION BY {same}{b}) - 1) / 2.0::DOUBLE AS rb
        FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) {group})
    """


SPEARMAN_MATRIX_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, cor, n FROM ({spearman_sql(EVENTS_SQL, a, b)})" for a, b in PAIRS
)


def _strictness(spark, sf):
    return site_daily(spark, sf).groupBy("sitename", F.trunc("date", "MM").alias("month")).agg(
        strict_mean("obs").alias("strict_mean"), F.avg("obs").alias("skip_mean"), strict_sum("obs").alias("strict_sum"),
        skip_sum("obs").alias("skip_sum"), F.min("mod").alias("low"), F.max("mod").alias("high"),
        F.count("*").alias("n"), F.count("obs").alias("n_obs"), F.count_distinct("n_lines").alias("n_kinds"),
        F.stddev_samp("mod").alias("sd"),
    )


def _zones(spark, sf):
    daily = stage(site_daily(spark, sf), "site_daily")
    return mean_doy_by_zone(attach_metadata(daily, site_info(spark, sf), ["lat", "koeppen_code"]))


def _zone_labels(spark, sf):
    metrics = score.zone_metrics(_zones(spark, sf), ["climatezone"])
    repeated = site_info(spark, sf).select(
        F.concat_ws(" ", "koeppen_code", F.when(F.col("lat") > 0, "north").otherwise("south")).alias("climatezone")
    ).join(metrics, "climatezone")
    return score.mean_by_label(repeated, "climatezone", ["mae", "nnse_ref"])


def _by_event_type(method):
    """Rank correlations use stored values: a computed mean may differ in its last bit and break a tie."""
    def build(spark, sf):
        return correlation(_event_values(spark, sf), "value", "k", method, ["event_type"], digits=None)
    return build


def _pearson(spark, sf):
    return correlation(site_daily(spark, sf), "mod", "obs", "pearson", ["sitename"], digits=2)


ZONE_INPUT_SQL = """
SELECT koeppen_code, CASE WHEN lat > 0 THEN 'north' WHEN lat <= 0 THEN 'south' END AS hemisphere,
       dayofyear(date) AS doy, sitename, obs, mod
FROM site_daily JOIN site_info USING (sitename) WHERE dayofyear(date) <> 366
"""


def zone_cycle_sql() -> str:
    from .sqlparts import lerp

    raw = f"""(SELECT koeppen_code, hemisphere, doy, count(DISTINCT sitename) AS nsites,
        quantile_cont(obs, 0.5) AS obs_mean, quantile_cont(obs, 0.33) AS obs_min, quantile_cont(obs, 0.66) AS obs_max,
        quantile_cont(mod, 0.5) AS mod_mean, quantile_cont(mod, 0.33) AS mod_min, quantile_cont(mod, 0.66) AS mod_max
        FROM ({ZONE_INPUT_SQL}) GROUP BY 1, 2, 3)"""
    filled = lerp(raw, "koeppen_code, hemisphere", "doy", ["obs_mean", "obs_min", "obs_max"])
    return f"SELECT *, koeppen_code || ' ' || hemisphere AS climatezone FROM ({filled})"


def zone_metrics_sql() -> str:
    return f"""
    SELECT climatezone,
           CASE WHEN n_mod = n_all AND n_obs = n_all THEN sxy * sxy / NULLIF(sxx * syy, 0) END AS rsq,
           CASE WHEN n_mod = n_all AND n_obs = n_all THEN mae END AS mae,
           CASE WHEN n_mod = n_all AND n_obs = n_all THEN rmse END AS rmse,
           1 / (1 + abs_sum / mean_obs) AS nnse_ref
    FROM (SELECT climatezone, {moments('mod_mean', 'obs_mean')}, count(*) AS n_all, avg(abs(mod_mean - obs_mean)) AS mae,
                 coalesce(sum(abs(mod_mean - obs_mean)), 0) AS abs_sum, avg(obs_mean) AS mean_obs
          FROM ({zone_cycle_sql()}) GROUP BY climatezone)
    """


KENDALL_SQL = f"""
WITH p AS (SELECT event_type, value AS x, k AS y FROM {EVENTS_SQL} WHERE value IS NOT NULL AND k IS NOT NULL),
     s AS (SELECT a.event_type, sum(sign(b.x - a.x) * sign(b.y - a.y)) AS s, sum(abs(sign(b.x - a.x))) AS nx,
                  sum(abs(sign(b.y - a.y))) AS ny
           FROM p a JOIN p b ON a.event_type = b.event_type GROUP BY 1),
     c AS (SELECT event_type, count(*) AS n FROM p GROUP BY 1)
SELECT event_type, s / NULLIF(sqrt(nx) * sqrt(ny), 0) AS cor, n FROM s JOIN c USING (event_type)
"""

CASES = {
    "e1_regression_stats": Case(
        f"sitename:s {STAT_COLUMNS}", lambda s, d: score.regression_stats(site_daily(s, d), ["sitename"]),
        stats("site_daily", "sitename"),
    ),
    "e1_regression_stats_pooled": Case(
        STAT_COLUMNS, lambda s, d: score.regression_stats(site_daily(s, d), guarded=True), stats("site_daily"),
    ),
    "e2_e4_strict_and_skipping_aggregates": Case(
        "sitename:s month:d strict_mean:f skip_mean:f strict_sum:f skip_sum:f low:f high:f n:i n_obs:i n_kinds:i sd:f",
        _strictness,
        f"""SELECT sitename, date_trunc('month', date) AS month, {strict('avg', 'obs')} AS strict_mean, avg(obs) AS skip_mean,
            {strict('sum', 'obs')} AS strict_sum, coalesce(sum(obs), 0) AS skip_sum, min(mod) AS low, max(mod) AS high,
            count(*) AS n, count(obs) AS n_obs, count(DISTINCT n_lines) AS n_kinds, stddev_samp(mod) AS sd
            FROM site_daily GROUP BY 1, 2""",
    ),
    "e5_complete_year_totals": Case(
        "sitename:s year:i mod:f n:i",
        lambda s, d: annual_totals(site_daily(s, d).select("sitename", "date", "mod"), 200),
        """SELECT sitename, year(date) AS year, CASE WHEN count(*) >= 200 THEN sum(mod) END AS mod, count(*) AS n
           FROM site_daily WHERE mod IS NOT NULL GROUP BY 1, 2""",
    ),
    "e7_median_and_terciles": Case(
        "event_type:s value_median:f value_q33:f value_q66:f k_median:f k_q33:f k_q66:f",
        lambda s, d: quantiles(_event_values(s, d), ["event_type"], median_and_terciles(["value", "k"])),
        f"""SELECT event_type, quantile_cont(value, 0.5) AS value_median, quantile_cont(value, 0.33) AS value_q33,
            quantile_cont(value, 0.66) AS value_q66, quantile_cont(k, 0.5) AS k_median, quantile_cont(k, 0.33) AS k_q33,
            quantile_cont(k, 0.66) AS k_q66 FROM {EVENTS_SQL} GROUP BY 1""",
    ),
    "e7_quantiles_of_large_groups": Case(
        "event_type:s low:f half:f high:f flat:f",
        lambda s, d: stack_tables({
            "by_type": quantiles(_event_values(s, d), ["event_type"], LARGE_GROUPS, accuracy=100),
            "pooled": quantiles(_event_values(s, d), [], LARGE_GROUPS, accuracy=100).withColumn("event_type", F.lit("all")),
        }),
        " UNION ALL ".join(
            f"""SELECT {name} AS event_type, quantile_cont(value, 0.02) AS low, quantile_cont(value, 0.5) AS half,
            quantile_cont(value, 0.999) AS high, quantile_cont(k, 0.66) AS flat FROM {EVENTS_SQL} {by}"""
            for name, by in (("event_type", "GROUP BY 1"), ("'all'", ""))
        ),
    ),
    "e8_axis_limit": Case(
        "limit_value:f", lambda s, d: axis_limit(site_daily(s, d)).withColumnRenamed("limit", "limit_value"),
        """SELECT round_even(greatest(quantile_cont(mod, 0.9999), quantile_cont(obs, 0.9999)), 0) AS limit_value
           FROM site_daily WHERE mod IS NOT NULL AND obs IS NOT NULL""",
    ),
    "e9_metric_set": Case(
        "metric:s estimator:s estimate:f", _metrics_long,
        "SELECT metric, 'standard' AS estimator, estimate FROM (SELECT "
        + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in score.METRICS)
        + f" FROM ({METRIC_SQL.format(m=moments(), t='site_daily')})) UNPIVOT (estimate FOR metric IN ({', '.join(score.METRICS)}))",
    ),
    "e10_relative_metrics": Case(
        "sitename:s rmse:f bias:f prmse:f rsq:f n:i n_zero_obs:i", _relative,
        f"""SELECT sitename, rmse / my AS rmse, bias / my AS bias, rmse / my AS prmse, sxy * sxy / NULLIF(sxx * syy, 0) AS rsq, n,
            n_zero_obs FROM (SELECT sitename, {moments()}, count(CASE WHEN obs = 0 THEN 1 END) AS n_zero_obs FROM site_daily
            WHERE mod IS NOT NULL AND obs IS NOT NULL GROUP BY 1)""",
    ),
    "e11_quick_metrics_by_site": Case(
        "sitename:s strict_rsq:f rsq:f mae:f rmse:f",
        lambda s, d: score.quick_metrics(site_daily(s, d), ["sitename"]).select("sitename", F.col("rsq").alias("strict_rsq")).join(
            score.quick_metrics(site_daily(s, d), ["sitename"], skip_null=True), "sitename"),
        f"""SELECT sitename, CASE WHEN n_mod = n_all AND n_obs = n_all THEN sxy * sxy / NULLIF(sxx * syy, 0) END AS strict_rsq,
            sxy * sxy / NULLIF(sxx * syy, 0) AS rsq, mae, rmse
            FROM (SELECT sitename, {moments()}, count(*) AS n_all, avg(abs(mod - obs)) AS mae FROM site_daily GROUP BY 1)""",
    ),
    "e12_zone_metrics": Case(
        "climatezone:s rsq:f mae:f rmse:f nnse_ref:f9", lambda s, d: score.zone_metrics(_zones(s, d), ["climatezone"]),
        zone_metrics_sql(),
    ),
    "e17_correlation_pearson": Case(
        "sitename:s cor:f n:i", _pearson,
        f"SELECT sitename, round(sxy / NULLIF(sqrt(sxx) * sqrt(syy), 0), 2) AS cor, n FROM (SELECT sitename, {moments()} FROM site_daily GROUP BY 1)",
    ),
    "e17_correlation_spearman": Case(
        "event_type:s cor:f9 n:i", _by_event_type("spearman"), spearman_sql(EVENTS_SQL, "value", "k", "event_type")),
    "e17_correlation_kendall": Case("event_type:s cor:f9 n:i", _by_event_type("kendall"), KENDALL_SQL),
    "e18_correlation_matrix": Case("a:s b:s cor:f9 n:i", _pair_rows, PEARSON_SQL),
    "l13_rank_correlation_matrix": Case("a:s b:s cor:f9 n:i", _rank_rows, SPEARMAN_MATRIX_SQL),
    "l13_rank_correlation_matrix_with_nulls": Case(
        "a:s b:s cor:f9 n:i", lambda s, d: correlation_matrix(_gappy(s, d), ["value", "k", "mix"], "spearman", digits=None),
        " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, cor, n FROM ({spearman_sql(GAPPY_SQL, a, b)})" for a, b in PAIRS),
    ),
    "e17_correlation_kendall_in_small_blocks": Case(
        "event_type:s cor:f9 n:i", lambda s, d: kendall(_event_values(s, d), ["event_type"], "value", "k", block_rows=40), KENDALL_SQL),
    "e18_kendall_matrix_of_positive_rows": Case("a:s b:s cor:f9 n:i", _positive_sites, _positive_kendall_sql()),
    "e19_zone_labels": Case(
        "climatezone:s mae:f nnse_ref:f9 mae_label:s nnse_ref_label:s", _zone_labels,
        f"""SELECT climatezone, avg(mae) AS mae, avg(nnse_ref) AS nnse_ref, 'mae = ' || substr(printf('%.10f', avg(mae)), 1, 4) AS mae_label,
            'nnse_ref = ' || substr(printf('%.10f', avg(nnse_ref)), 1, 4) AS nnse_ref_label
            FROM (SELECT z.climatezone, CAST(z.mae AS DOUBLE) AS mae, nnse_ref FROM ({zone_metrics_sql()}) z
                  JOIN site_info i ON z.climatezone = i.koeppen_code || ' ' || CASE WHEN i.lat > 0 THEN 'north' ELSE 'south' END)
            GROUP BY 1""",
    ),
    "e20_line_ends": Case(
        "sitename:s xmin:f xmax:f ymin:f ymax:f",
        lambda s, d: score.line_ends(fitted_by_site(_annual(s, d), support="pairs"), ["sitename"]),
        f"""WITH a AS ({ANNUAL_SQL}), f AS ({stats('a', 'sitename', where='n > 2')})
            SELECT sitename, min(mod) AS xmin, max(mod) AS xmax, arg_min(intercept + slope * mod, mod) AS ymin,
                   arg_max(intercept + slope * mod, mod) AS ymax
            FROM a JOIN f USING (sitename) WHERE mod IS NOT NULL AND obs IS NOT NULL AND slope IS NOT NULL GROUP BY 1""",
    ),
    "e21_site_means": Case(
        "sitename:s obs:f mod:f", lambda s, d: site_means(_annual(s, d)),
        f"SELECT sitename, avg(obs) AS obs, avg(mod) AS mod FROM ({ANNUAL_SQL}) GROUP BY 1",
    ),
    "e22_linear_fit": Case(
        "sitename:s slope:f intercept:f n:i", lambda s, d: score.linear_fit(site_daily(s, d), ["sitename"]),
        f"SELECT sitename, slope, intercept, nvals AS n FROM ({stats('site_daily', 'sitename')})",
    ),
    "i10_fitted_values": Case(
        "sitename:s date:d mod:f obs:f fitted:f",
        lambda s, d: fitted_by_site(site_daily(s, d).select("sitename", "date", "mod", "obs")),
        f"""WITH f AS ({stats('site_daily', 'sitename', where='n_obs > 2 AND n_mod > 2')})
            SELECT sitename, date, mod, obs, CASE WHEN obs IS NOT NULL THEN intercept + slope * mod END AS fitted
            FROM site_daily JOIN f USING (sitename)""",
    ),
    "b8_stack_levels": Case(
        f"level:s sitename:s {STAT_COLUMNS}",
        lambda s, d: stack_tables({
            "pooled": score.regression_stats(site_daily(s, d)),
            "by_site": score.regression_stats(site_daily(s, d), ["sitename"]),
        }),
        f"""SELECT 'pooled' AS level, NULL AS sitename, rsq, rmse, slope, bias, nvals FROM ({stats('site_daily')})
            UNION ALL SELECT 'by_site', sitename, rsq, rmse, slope, bias, nvals FROM ({stats('site_daily', 'sitename')})""",
    ),
}
