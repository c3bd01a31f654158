"""Preparation of inputs, nested tables, folds, candidates and table comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text, units
from ..operators import folds, prep
from ..operators.compare import compare_tables
from ..operators.joins import attach_metadata, drop_sites, keep_sites
from ..plans.candidates import best_run, score_runs, within_bounds
from ..plans.drivers import prepare_drivers
from ..session import shared_dir
from ..sources import nested as N
from ..sources import tables
from .case import Case
from .levels import daily
from .views import forcing, shipments, site_daily, site_info, table


GOOD = 0.8931717  # no mean of two-digit discounts lies on it, so float noise decides no row


def _nested(spark, sf):
    return N.nest_series(site_daily(spark, sf), ["obs", "mod", "qc"])


def _nested_positions(spark, sf):
    return _nested(spark, sf).select("sitename", "chunk_year", F.posexplode("data").alias("pos", "row")).select(
        "sitename", "chunk_year", "pos", "row.date", "row.obs"
    )


def _nested_quality(spark, sf):
    good = N.map_series(_nested(spark, sf), lambda rows: F.filter(rows, lambda r: r["qc"] > GOOD))
    return N.unnest_series(N.non_empty(good))


def _drivers(spark, sf):
    info = site_info(spark, sf)
    return prepare_drivers(forcing(spark, sf), info, info, exclusions=[("S12", 1998)])


def _structs(spark, sf):
    info = site_info(spark, sf).select("sitename", F.struct("lat", "lon", "koeppen_code").alias("site_info"))
    changed = N.set_fields(info, "site_info", {"use_gs": F.lit(True), "lat": F.col("site_info.lat") + 1})
    return keep_sites(N.spread_struct(changed, "site_info"), site_daily(spark, sf).distinct())


def _forcing_units(spark, sf):
    return prep.required_forcing(prep.forcing_per_second(prep.drop_leap_days(forcing(spark, sf))))


def _power_sum(coefs, x: str) -> str:
    return " + ".join(f"({c!r}::DOUBLE) * pow({x}, {i})" for i, c in enumerate(coefs))


def et_sql(le="le", t="temp", p="patm") -> str:
    stiff = f"({_power_sum(units.BULK_MODULUS, t)} + ({_power_sum(units.PRESSURE_COEF_A, t)}) * ({p} * 1e-5) + ({_power_sum(units.PRESSURE_COEF_B, t)}) * pow({p} * 1e-5, 2))"
    rho = f"(1000 * ({_power_sum(units.RHO_AT_ONE_ATM, t)}) * {stiff} / ({stiff} - {p} * 1e-5))"
    h = f"(1.91846e6 * pow(({t} + 273.15) / ({t} + 273.15 - 33.91), 2))"
    return f"(1000 * 86400 * {le} / ({h} * {rho}))"


def _calendar(spark, sf):
    days = site_daily(spark, sf).groupBy("date").agg(F.count("*").alias("n"))
    return days.select(
        "date", "n", cal.week_start("date").alias("week"), cal.month_start("date").alias("month"), cal.year_start("date").alias("year"),
        cal.is_leap_day("date").alias("leap_day"), cal.is_day_366("date").alias("day_366"), F.dayofyear("date").alias("doy"),
        cal.first_day(F.year("date")).alias("first_day"), cal.last_day_of_year(F.year("date")).alias("last_day"),
    )


def _labels(spark, sf):
    tagged = prep.recode(attach_metadata(site_daily(spark, sf), site_info(spark, sf), ["koeppen_code", "lat"]))
    side = text.hemisphere("lat")
    zone = text.climate_zone("koeppen_code", side)
    coded = text.koeppen_code(F.concat(F.col("koeppen_code"), F.lit(" - "), side))
    variable = F.when(F.col("lat") > 0, "le").when(F.col("lat") < 0, "gpp").otherwise("other")
    return tagged.select("sitename", "koeppen_code", zone.alias("zone"), coded.alias("code"), side.alias("side"),
                         units.unit_label(variable).alias("unit")).groupBy("sitename", "koeppen_code", "zone", "code", "side", "unit").agg(
        F.count("*").alias("n"))


def _suppliers(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_name").alias("sitename"), "s_acctbal", F.col("s_suppkey").alias("key"))


def _folds(spark, sf):
    return folds.fold_split(_suppliers(spark, sf), 5, ["s_acctbal"])


FOLDS_SQL = """
SELECT sitename, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY md5(sitename || '1982')) - 1) % 5 + 1 AS fold
FROM (SELECT s_name AS sitename, CAST(CAST(s_acctbal > a AS INTEGER) + CAST(s_acctbal > b AS INTEGER) AS VARCHAR) AS stratum
      FROM supplier, (SELECT quantile_cont(s_acctbal, 1 / 3::DOUBLE) AS a, quantile_cont(s_acctbal, 2 / 3::DOUBLE) AS b FROM supplier))
"""


def _supplier_lines(spark, sf):
    lines, sup = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    return lines.join(sup, lines.l_suppkey == sup.s_suppkey).select(F.col("s_name").alias("sitename"), "l_extendedprice")


def _training(spark, sf):
    rows = folds.training_sets(_supplier_lines(spark, sf), _folds(spark, sf), 5)
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean"))


def _one_fold(spark, sf):
    rows, split = _supplier_lines(spark, sf), _folds(spark, sf)
    parts = {"train": folds.train_rows(rows, split, 2), "test": folds.test_rows(rows, split, 2)}
    return N.stack_tables({k: v.agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean")) for k, v in parts.items()}, "part")


def _candidates(spark, sf):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return shipments(spark, sf).groupBy(F.concat("l_returnflag", "l_linestatus").alias("param_set"), "sitename", "date").agg(
        (F.avg(net) / 1000).alias("mod"))


def _candidate_scores(spark, sf):
    return score_runs(_candidates(spark, sf), daily(spark, sf), ["sitename", "date"])


def _bounds(spark, sf):
    params = shipments(spark, sf).groupBy(F.concat("l_returnflag", "l_linestatus").alias("param_set")).agg(
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_quantity").alias("quantity"))
    ranges = spark.createDataFrame(
        [("discount", 0.02, 0.08, 0.05), ("tax", 0.0, 0.0402, 0.04), ("quantity", 10.0, 40.0, 25.0)],
        "param string, lower double, upper double, init double")
    return within_bounds(params.unpivot(["param_set"], ["discount", "tax", "quantity"], "param", "value"), ranges)


CANDIDATE_SQL = """
SELECT param_set, sqrt(avg(pow(c.mod - s.obs, 2))) AS cost, count(*) AS n FROM (
  SELECT l_returnflag || l_linestatus AS param_set, 'S' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS sitename,
         CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice * (1 - l_discount)) / 1000 AS mod
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3) c
JOIN site_daily s USING (sitename, date) WHERE s.obs IS NOT NULL GROUP BY 1
"""
BOUNDS_SQL = """
SELECT l_returnflag || l_linestatus AS param_set, avg(l_discount) BETWEEN 0.02 AND 0.08 AND avg(l_tax) BETWEEN 0.0 AND 0.0402
       AND avg(l_quantity) BETWEEN 10 AND 40 AS in_bounds FROM lineitem GROUP BY 1
"""


def _compared(spark, sf):
    df = daily(spark, sf)
    other = df.select("sitename", "date", (F.col("obs") * 1.000001).alias("obs"), (F.col("mod") * 1.001).alias("mod"),
                      F.when(F.col("qc") > 0.5, F.col("qc")).alias("qc"), "n_lines")
    return compare_tables(df, other, ["sitename", "date"], ["obs", "mod", "qc", "n_lines"])


COMPARE_SQL = """
WITH c AS (SELECT 'obs' AS col, obs AS t, obs * 1.000001::DOUBLE AS c FROM site_daily UNION ALL SELECT 'mod', mod, mod * 1.001::DOUBLE FROM site_daily
           UNION ALL SELECT 'qc', qc, CASE WHEN qc > 0.5 THEN qc END FROM site_daily UNION ALL SELECT 'n_lines', n_lines, n_lines FROM site_daily),
s AS (SELECT col, count(*) AS n_matched, 0 AS n_unmatched, count(CASE WHEN (t IS NULL) <> (c IS NULL) THEN 1 END) AS n_null_mismatch,
             count(CASE WHEN t <> c THEN 1 END) AS n_differ, coalesce(avg(CASE WHEN t <> c THEN abs(t - c) END) / avg(CASE WHEN t <> c THEN abs(t) END), 0) AS difference
      FROM c GROUP BY 1)
SELECT *, n_null_mismatch = 0 AND difference <= 1e-5 AS is_equal FROM s
"""


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/siteskill-{uuid.uuid4().hex}"


def _csv_round_trip(spark, sf):
    """Site table out to CSV and in again: `NA`, empty fields and NaN come back as null."""
    path = _folder(spark)
    site = F.substring("sitename", 2, 2).cast("int")
    tables.write_csv(site_info(spark, sf).select(
        "sitename", "lon", F.when(site % 3 != 0, F.col("lat")).alias("lat"), F.when(site % 4 == 0, F.lit(float("nan"))).otherwise(site * 10.0).alias("elv"),
        F.lit(None).cast("double").alias("whc"), F.when(site % 5 != 0, F.col("koeppen_code")).alias("koeppen_code"), "igbp_land_use"), path)
    return tables.read_csv(spark, path, tables.SITE_INFO_SCHEMA)


def _saved_tables(spark, sf):
    """A full and a light form, written and read; NaN comes back as null."""
    path, df = _folder(spark), daily(spark, sf).withColumn("mod", F.coalesce("mod", F.lit(float("nan"))))
    tables.write_table(df, f"{path}/full")
    tables.write_table(df, f"{path}/light", ["sitename", "date", "mod"])
    return N.stack_tables({k: tables.read_table(spark, f"{path}/{k}") for k in ("full", "light")})


def _rewritten_fold(spark, sf):
    """Five folds written, one of them twice, then two of them read."""
    path = _folder(spark)
    df = daily(spark, sf).select("sitename", "date", "mod", (F.substring("sitename", 2, 2).cast("int") % 5).alias("fold"))
    tables.write_by_fold(df, path)
    tables.write_by_fold(df.where("fold = 2").withColumn("mod", F.col("mod") + 1000), path)
    return tables.read_fold(spark, path, 2).unionByName(tables.read_fold(spark, path, 3))


def _compared_with_repeated_keys(spark, sf):
    """Events by type alone: some values changed, some rows gone, some twice."""
    e = table(spark, sf, "events").where("value IS NOT NULL")
    changed = e.select("event_type", F.when(F.col("event_id") % 1000 == 7, F.col("value") + 1).otherwise(F.col("value")).alias("value"), "event_id")
    current = changed.where("event_id % 1500 <> 3").unionByName(changed.where("event_id % 2500 = 11"))
    return compare_tables(e.select("event_type", "value"), current, ["event_type"], ["value"])


REPEATED_KEYS_SQL = """
WITH e AS (SELECT event_type AS k, event_id, value, CASE WHEN event_id % 1000 = 7 THEN value + 1 ELSE value END AS v FROM events WHERE value IS NOT NULL),
c0 AS (SELECT k, v FROM e WHERE event_id % 1500 <> 3 UNION ALL SELECT k, v FROM e WHERE event_id % 2500 = 11),
t AS (SELECT k, value AS v, row_number() OVER (PARTITION BY k, value) AS r FROM e), c AS (SELECT k, v, row_number() OVER (PARTITION BY k, v) AS r FROM c0),
lt AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS p FROM t ANTI JOIN c USING (k, v, r)),
lc AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS p FROM c ANTI JOIN t USING (k, v, r)),
f AS (SELECT t.v AS a, c.v AS b FROM t JOIN c USING (k, v, r) UNION ALL SELECT lt.v, lc.v FROM lt FULL JOIN lc ON lt.k = lc.k AND lt.p = lc.p),
s AS (SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_matched, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS n_unmatched,
             count(*) FILTER (WHERE a <> b) AS n_differ, avg(abs(a - b)) FILTER (WHERE a <> b) / avg(abs(a)) FILTER (WHERE a <> b) AS difference FROM f)
SELECT 'value' AS col, n_matched, n_unmatched, 0 AS n_null_mismatch, n_differ, difference, false AS is_equal FROM s
"""


def _compared_with_itself(spark, sf):
    df = daily(spark, sf)
    return compare_tables(df, df.repartition(7, "date"), ["sitename", "date"], ["obs", "mod"])


CASES = {
    "l17_compare_repeated_keys": Case(
        "col:s n_matched:i n_unmatched:i n_null_mismatch:i n_differ:i difference:f9 is_equal:b",
        lambda s, d: _compared_with_repeated_keys(s, d).withColumnRenamed("column", "col"), REPEATED_KEYS_SQL),
    "l17_compare_equal_tables": Case(
        "col:s n_matched:i n_unmatched:i n_null_mismatch:i n_differ:i difference:f9 is_equal:b",
        lambda s, d: _compared_with_itself(s, d).withColumnRenamed("column", "col"),
        """SELECT unnest(['obs', 'mod']) AS col, count(*) AS n_matched, 0 AS n_unmatched, 0 AS n_null_mismatch, 0 AS n_differ, 0 AS difference, true AS is_equal
           FROM site_daily"""),
    "a1_csv_round_trip": Case(
        "sitename:s lon:f lat:f elv:f whc:f koeppen_code:s igbp_land_use:s", _csv_round_trip,
        """SELECT sitename, lon, CASE WHEN n % 3 <> 0 THEN lat END AS lat, CASE WHEN n % 4 <> 0 THEN n * 10 END AS elv, NULL AS whc,
                  CASE WHEN n % 5 <> 0 THEN koeppen_code END AS koeppen_code, igbp_land_use
           FROM (SELECT *, CAST(substr(sitename, 2, 2) AS INTEGER) AS n FROM site_info)""",
    ),
    "a2_saved_tables": Case(
        "level:s sitename:s date:d obs:f mod:f n_lines:i", _saved_tables,
        """SELECT 'full' AS level, sitename, date, obs, mod, n_lines FROM site_daily
           UNION ALL SELECT 'light', sitename, date, NULL, mod, NULL FROM site_daily""",
    ),
    "a4_rewritten_fold": Case(
        "sitename:s date:d mod:f fold:i", _rewritten_fold,
        """SELECT sitename, date, CASE fold WHEN 2 THEN mod + 1000 ELSE mod END AS mod, fold
           FROM (SELECT *, CAST(substr(sitename, 2, 2) AS INTEGER) % 5 AS fold FROM site_daily) WHERE fold IN (2, 3)""",
    ),
    "b1_unnest_series": Case(
        "sitename:s date:d obs:f mod:f qc:f", lambda s, d: N.unnest_series(_nested(s, d)), "SELECT sitename, date, obs, mod, qc FROM site_daily"),
    "b2_nest_series": Case(
        "sitename:s chunk_year:i pos:i date:d obs:f", _nested_positions,
        """SELECT sitename, year(date) AS chunk_year, row_number() OVER (PARTITION BY sitename, year(date) ORDER BY date) - 1 AS pos, date, obs
           FROM site_daily"""),
    "b3_struct_fields": Case(
        "sitename:s lat:f lon:f koeppen_code:s use_gs:b", _structs,
        """SELECT sitename, lat + 1 AS lat, lon, koeppen_code, true AS use_gs FROM site_info
           WHERE sitename IN (SELECT sitename FROM site_daily)"""),
    "b6_map_over_nested_series": Case(
        "sitename:s date:d obs:f mod:f qc:f", _nested_quality, f"SELECT sitename, date, obs, mod, qc FROM site_daily WHERE qc > {GOOD}"),
    "b9_unit_conversion": Case(
        "sitename:s date:d prec:f9 ppfd:f9 rainf:f9 snowf:f tmin:f tmax:f netrad:f", _forcing_units,
        """SELECT sitename, date, prec / 86400 AS prec, ppfd / 86400 AS ppfd, prec / 86400 AS rainf, 0 AS snowf, temp AS tmin, temp AS tmax, 0 AS netrad
           FROM forcing WHERE NOT (month(date) = 2 AND day(date) = 29)"""),
    "b10_constant_forcing": Case(
        "sitename:s date:d temp:f patm:f gpp:f", lambda s, d: prep.constant_forcing(forcing(s, d), {"temp": 20, "patm": 101325}),
        "SELECT sitename, date, 20 AS temp, 101325 AS patm, gpp FROM forcing"),
    "b11_attach_metadata": Case(
        "sitename:s date:d obs:f lat:f lon:f koeppen_code:s c4:b",
        lambda s, d: attach_metadata(site_daily(s, d), site_info(s, d), ["lat", "lon", "koeppen_code", "c4"]),
        "SELECT sitename, date, obs, lat, lon, koeppen_code, c4 FROM site_daily LEFT JOIN site_info USING (sitename)"),
    "b12_i_labels": Case(
        "sitename:s koeppen_code:s zone:s code:s side:s unit:s n:i", _labels,
        """WITH t AS (SELECT sitename, CASE koeppen_code WHEN 'BSk' THEN 'Bsk' ELSE koeppen_code END AS koeppen_code,
                             CASE WHEN lat > 0 THEN 'north' ELSE 'south' END AS side, lat FROM site_daily JOIN site_info USING (sitename))
           SELECT sitename, koeppen_code, koeppen_code || ' ' || side AS zone, koeppen_code AS code, side,
                  CASE WHEN lat > 0 THEN 'LE (W m-2 d-1)' WHEN lat < 0 THEN 'GPP (gC m-2 d-1)' END AS unit, count(*) AS n
           FROM t GROUP BY ALL"""),
    "c1_quality_filter": Case(
        "sitename:s date:d gpp:f", lambda s, d: prep.quality_filter(forcing(s, d), keep=("sitename", "date", "gpp")),
        "SELECT sitename, date, gpp FROM forcing WHERE gpp_qc > 0.8"),
    "c3_not_flagged_or_unknown": Case(
        "sitename:s n:i",
        lambda s, d: keep_sites(site_daily(s, d), prep.c3_sites(site_info(s, d))).groupBy("sitename").agg(F.count("*").alias("n")),
        "SELECT sitename, count(*) AS n FROM site_daily JOIN site_info USING (sitename) WHERE c4 IS NULL OR NOT c4 GROUP BY 1"),
    "c5_year_window": Case(
        "sitename:s date:d obs:f",
        lambda s, d: prep.year_window(site_daily(s, d), site_info(s, d), [("year_start_gpp", "year_end_gpp"), ("year_start_le", "year_end_le")]),
        """SELECT sitename, date, obs FROM site_daily JOIN site_info USING (sitename) WHERE year(date) BETWEEN year_start_gpp AND year_end_gpp
           AND year(date) BETWEEN year_start_le AND year_end_le"""),
    "c7_site_selection": Case(
        "sitename:s n:i",
        lambda s, d: keep_sites(site_daily(s, d), prep.select_sites(site_info(s, d), drop_flags=("drop_gpp", "drop_le"))).groupBy("sitename").agg(
            F.count("*").alias("n")),
        """SELECT sitename, count(*) AS n FROM site_daily JOIN site_info USING (sitename)
           WHERE igbp_land_use NOT IN ('CRO', 'WET') AND drop_gpp = 'FALSE' AND NOT drop_le GROUP BY 1"""),
    "c8_date_window": Case(
        "sitename:s date:d obs:f", lambda s, d: prep.date_window(site_daily(s, d), site_info(s, d), "year_start", "year_end"),
        """SELECT sitename, date, obs FROM site_daily JOIN site_info USING (sitename)
           WHERE date BETWEEN make_date(year_start, 1, 1) AND make_date(year_end, 12, 31)"""),
    "c9_leap_day_removal": Case(
        "sitename:s date:d obs:f", lambda s, d: prep.drop_leap_days(site_daily(s, d)),
        "SELECT sitename, date, obs FROM site_daily WHERE NOT (month(date) = 2 AND day(date) = 29)"),
    "c10_finite_pairs_on_log_axes": Case(
        "sitename:s date:d mod:f obs:f", lambda s, d: prep.finite_pairs(site_daily(s, d), "mod", "obs", xlim=(-10.0, 80.0), log="xy"),
        "SELECT sitename, date, mod, obs FROM site_daily WHERE mod BETWEEN -10 AND 80 AND mod > 0 AND obs > 0"),
    "c14_water_balance_sites": Case(
        "sitename:s rain_total:f et_total:f", lambda s, d: prep.water_balance_sites(forcing(s, d)),
        f"""SELECT * FROM (SELECT sitename, coalesce(sum(rain * 86400), 0) AS rain_total, coalesce(sum({et_sql()}), 0) AS et_total
            FROM forcing GROUP BY 1) WHERE NOT et_total > rain_total"""),
    "c16_rows_with_any_value": Case(
        "sitename:s date:d obs:f mod:f", lambda s, d: prep.drop_all_null(site_daily(s, d), ["obs", "mod"]),
        "SELECT sitename, date, obs, mod FROM site_daily WHERE obs IS NOT NULL OR mod IS NOT NULL"),
    "c17_tag_filter": Case(
        "p_brand:s p_type:s n:i",
        lambda s, d: prep.tagged(table(s, d, "part"), "p_brand", "4", "#2").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")),
        "SELECT p_brand, p_type, count(*) AS n FROM part WHERE regexp_matches(p_brand, '4') AND regexp_matches(p_brand, '#2') GROUP BY 1, 2"),
    "d4_d5_semi_and_anti_join": Case(
        "part:s sitename:s n:i",
        lambda s, d: N.stack_tables({
            "kept": keep_sites(site_daily(s, d), prep.select_sites(site_info(s, d))).groupBy("sitename").agg(F.count("*").alias("n")),
            "dropped": drop_sites(site_daily(s, d), prep.select_sites(site_info(s, d))).groupBy("sitename").agg(F.count("*").alias("n")),
        }, "part"),
        """SELECT CASE WHEN igbp_land_use IN ('CRO', 'WET') THEN 'dropped' ELSE 'kept' END AS part, sitename, count(*) AS n
           FROM site_daily JOIN site_info USING (sitename) GROUP BY ALL"""),
    "i1_i3_calendar": Case(
        "date:d n:i week:d month:d year:d leap_day:b day_366:b doy:i first_day:d last_day:d", _calendar,
        """SELECT date, count(*) AS n, CAST(date - CAST(dayofweek(date) AS INTEGER) AS DATE) AS week, date_trunc('month', date) AS month,
                  date_trunc('year', date) AS year, month(date) = 2 AND day(date) = 29 AS leap_day, dayofyear(date) = 366 AS day_366,
                  dayofyear(date) AS doy, make_date(year(date), 1, 1) AS first_day, make_date(year(date), 12, 31) AS last_day
           FROM site_daily GROUP BY date"""),
    "i11_evapotranspiration": Case(
        "sitename:s date:d et:f9",
        lambda s, d: forcing(s, d).select("sitename", "date", units.evapotranspiration("le", "temp", "patm").alias("et")),
        f"SELECT sitename, date, {et_sql()} AS et FROM forcing"),
    "i12_water_balance_et": Case(
        "sitename:s date:d aet:f",
        lambda s, d: forcing(s, d).select("sitename", "date", units.water_balance_et("rain", "runoff").alias("aet")),
        "SELECT sitename, date, rain * 86400 - runoff AS aet FROM forcing"),
    "l1_prepare_drivers": Case(
        "sitename:s date:d gpp:f gpp_qc:f le:f temp:f patm:f rain:f9", _drivers,
        """SELECT sitename, date, gpp, gpp_qc, le, temp, patm, rain FROM forcing JOIN site_info USING (sitename)
           WHERE igbp_land_use NOT IN ('CRO', 'WET') AND drop_gpp = 'FALSE' AND NOT drop_le
             AND year(date) BETWEEN year_start_gpp AND year_end_gpp AND year(date) BETWEEN year_start_le AND year_end_le
             AND NOT (sitename = 'S12' AND year(date) >= 1998)"""),
    "l15_score_runs": Case("param_set:s cost:f n:i", _candidate_scores, CANDIDATE_SQL),
    "l15_bounds": Case("param_set:s in_bounds:b", _bounds, BOUNDS_SQL),
    "l15_best_run": Case(
        "param_set:s cost:f n:i", lambda s, d: best_run(_candidate_scores(s, d), _bounds(s, d)),
        f"SELECT c.* FROM ({CANDIDATE_SQL}) c JOIN ({BOUNDS_SQL}) b USING (param_set) WHERE in_bounds ORDER BY cost, param_set LIMIT 1"),
    "l16_fold_split": Case("sitename:s stratum:s fold:i", _folds, FOLDS_SQL),
    "l16_training_sets": Case(
        "fold:i n:i mean:f", _training,
        f"""SELECT k AS fold, count(*) AS n, avg(l_extendedprice) AS mean FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
            JOIN ({FOLDS_SQL}) f ON f.sitename = s_name JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) ON k <> fold GROUP BY 1"""),
    "l16_train_and_test": Case(
        "part:s n:i mean:f", _one_fold,
        f"""SELECT CASE WHEN fold = 2 THEN 'test' ELSE 'train' END AS part, count(*) AS n, avg(l_extendedprice) AS mean
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN ({FOLDS_SQL}) f ON f.sitename = s_name GROUP BY 1"""),
    "l17_compare_tables": Case(
        "col:s n_matched:i n_unmatched:i n_null_mismatch:i n_differ:i difference:f9 is_equal:b",
        lambda s, d: _compared(s, d).withColumnRenamed("column", "col"), COMPARE_SQL),
}
