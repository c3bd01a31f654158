"""Levels, components and the evaluation, each against row-level or pandas results."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteskill.operators.score import regression_stats, stats_by_group
from siteskill.plans import components as C
from siteskill.plans import rollup
from siteskill.plans.drivers import prepare_drivers
from siteskill.plans.evaluation import Settings, evaluate, evaluate_matched, metrics_table
from siteskill.plans.levels import Matched, annual_totals, match_levels
from siteskill.plans.observations import build_catchment_observations, build_observations, build_observations_xdaily
from siteskill.plans.rollup import roll_up

from .helpers import close, day

LEVELS = {
    "daily_pooled", "xdaily_pooled", "annual_pooled", "monthly_pooled", "spatial", "anomalies_annual", "meandoy",
    "anomalies_daily", "meanxoy", "anomalies_xdaily",
}


@pytest.fixture(scope="module")
def daily(spark):
    rng = random.Random(9)
    rows = []
    for s in range(5):
        for i in range(4 * 365 + 1):
            season = float(50 + 30 * np.sin(2 * np.pi * i / 365) + 10 * s)
            obs = season + rng.gauss(0, 5) if rng.random() > 0.02 else None
            mod = 0.9 * season + rng.gauss(0, 4) + 2 if s < 4 or i > 500 else None
            rows.append((f"s{s}", day(i), obs, mod))
    df = spark.createDataFrame(rows, "sitename string, date date, obs double, mod double")
    df.cache().count()
    return df


@pytest.fixture(scope="module")
def meta(spark):
    rows = [(f"s{s}", [10.0, -10.0, 0.0, 5.0, None][s], ["Cfb", "Cfb", "Aw", "Cfb", None][s]) for s in range(5)]
    return spark.createDataFrame(rows, "sitename string, lat double, koeppen_code string")


@pytest.fixture(scope="module")
def matched(spark, daily, meta):
    obs = build_observations(daily.where("obs IS NOT NULL").select("sitename", "date", "obs"), meta, ["obs"])
    return match_levels(daily.select("sitename", "date", "mod"), obs, "mod", "obs", 300)


@pytest.fixture(scope="module")
def full(matched):
    return evaluate_matched(matched, light=False)


def same_stats(a, b):
    return all(close(a[c], b[c], 1e-9) for c in ("rsq", "rmse", "slope", "bias", "nvals"))


def test_strict_levels(spark):
    rows = [("a", day(i), None if i == 40 else 1.0) for i in range(366)]
    obs = build_observations(spark.createDataFrame(rows, "sitename string, date date, v double"), None, ["v"])
    assert obs.adf.first()["v"] is None
    assert [r["v"] for r in obs.mdf.orderBy("date").limit(3).collect()] == [1.0, None, 1.0]
    assert obs.xdf.where("v IS NULL").count() == 1 and obs.ddf.count() == 366


def test_xdaily_levels_with_a_break_table_and_without(spark, daily):
    regular = build_observations_xdaily(daily, None, ["mod"], first="2000-01-01", last="2002-12-31")
    table = build_observations_xdaily(daily, None, ["mod"], breaks=regular.breaks)
    a, b = (o.xdf.toPandas().sort_values(["sitename", "inbin"]).reset_index(drop=True) for o in (regular, table))
    pd.testing.assert_frame_equal(a[["sitename", "inbin", "mod"]], b[["sitename", "inbin", "mod"]], check_exact=False)


def test_complete_year_rule(spark):
    rows = [("a", day(i), 1.0) for i in range(365)] + [("b", day(i), 1.0 if i else None) for i in range(365)]
    got = {r["sitename"]: (r["mod"], r["n"]) for r in annual_totals(spark.createDataFrame(rows, "sitename string, date date, mod double")).collect()}
    assert got == {"a": (365.0, 365), "b": (None, 364)}


def test_every_observation_is_kept(matched, daily):
    assert matched.ddf.count() == daily.where("obs IS NOT NULL").count()
    assert matched.ddf.where("mod IS NULL").count() > 0
    assert matched.adf.where("sitename = 's4'").orderBy("year").first()["mod"] is None


def test_catchment_observations_skip_nulls(spark):
    df = spark.createDataFrame([("a", day(0), 2.0 / 86400, 0.5), ("a", day(1), None, 1.0)], "sitename string, date date, rain double, runoff double")
    assert close(build_catchment_observations(df).adf.first()["aet"], 1.5)


def test_metrics_have_all_levels(full):
    got = {r["level"]: r for r in full.metrics.collect()}
    assert set(got) == LEVELS and all(r["rsq"] is not None for r in got.values())


@pytest.mark.parametrize("level,table", [
    ("daily_pooled", "ddf"), ("xdaily_pooled", "xdf"), ("annual_pooled", "adf"), ("monthly_pooled", "mdf"), ("spatial", "meandf"),
    ("anomalies_annual", "iavdf"), ("anomalies_daily", "idvdf"), ("anomalies_xdaily", "ixvdf"),
])
def test_pooled_scores_equal_scores_of_the_rows(full, level, table):
    merged = full.metrics.where(F.col("level") == level).first()
    assert same_stats(merged, regression_stats(full.tables[table]).first())


@pytest.mark.parametrize("level,table", [("meandoy", "meandoydf"), ("meanxoy", "meanxoydf")])
def test_cycle_scores_equal_scores_of_the_cycles(full, level, table):
    merged = full.metrics.where(F.col("level") == level).first()
    assert same_stats(merged, regression_stats(full.tables[table], mod="mod_mean", obs="obs_mean").first())


@pytest.mark.parametrize("stats,table,support", [
    ("adf_stats", "adf", "pairs"), ("iavdf_stats", "iavdf", "both"), ("idvdf_stats", "idvdf", "both"), ("ixvdf_stats", "ixvdf", "both"),
])
def test_site_scores_equal_scores_of_the_rows(full, stats, table, support):
    got = {r["sitename"]: r for r in full.tables[stats].collect()}
    want = {r["sitename"]: r for r in stats_by_group(full.tables[table], ["sitename"], support=support).collect()}
    assert got.keys() == want.keys() and all(same_stats(got[s], want[s]) for s in got)


def test_fitted_tables(full):
    rows = full.tables["adf_fitted"].where("mod IS NOT NULL AND obs IS NOT NULL").collect()
    assert rows and all(r["fitted"] is not None for r in rows)
    assert full.tables["adf_lines"].count() == full.tables["adf_stats"].count()


def test_day_366_becomes_null(full):
    tail = full.tables["idvdf"].where("doy = 366")
    assert tail.count() > 0 and tail.where("mod IS NOT NULL OR obs IS NOT NULL").count() == 0
    assert full.tables["meandoydf"].where("doy = 366").count() == 0


def test_zones_pool_sites(full, matched):
    zones = full.tables["meandoydf_byclim"]
    assert {r[0] for r in zones.select("climatezone").distinct().collect()} == {"Cfb north", "Cfb south", "Aw south", "NA NA"}
    got = zones.where("climatezone = 'Cfb north' AND doy = 100").first()
    pdf = matched.ddf.where("sitename IN ('s0', 's3') AND dayofyear(date) = 100").toPandas()
    assert got["nsites"] == 2 and close(got["mod_min"], pdf["mod"].quantile(0.33)) and close(got["obs_mean"], pdf.obs.median())
    assert full.tables["meandoydf_byclim_stats"].count() == 4
    assert {r[0] for r in C.large_zones(zones, 1).select("climatezone").distinct().collect()} == {"Cfb north"}


def test_levels_without_observations_are_blank(spark):
    empty = spark.createDataFrame([("a", day(i), 1.0, None) for i in range(5)], "sitename string, date date, mod double, obs double")
    matched = Matched(
        adf=empty, mdf=empty, ddf=empty, xdf=empty.withColumnRenamed("date", "inbin"))
    got = {r["level"]: r for r in evaluate_matched(matched).metrics.collect()}
    assert set(got) == LEVELS and all(r["rmse"] is None and r["nvals"] == 0 for r in got.values())


def test_evaluate_by_source_and_site(spark, daily, meta):
    known = daily.where("obs IS NOT NULL").select("sitename", "date", F.col("obs").alias("gpp"), F.col("obs").alias("aet"))
    obs = build_observations(known, meta, ["gpp", "aet"])
    mod = daily.select("sitename", "date", F.col("mod").alias("gpp"), F.col("mod").alias("aet"))
    settings = Settings({"gpp": "fluxnet_v1", "aet": "camels"}, sites=meta.where("sitename IN ('s0', 's1')"), min_days=300)
    got = metrics_table(evaluate(mod, settings, obs)).collect()
    assert {r["level"] for r in got if r["variable"] == "gpp"} == LEVELS
    assert {r["level"] for r in got if r["variable"] == "aet"} == {"annual_pooled", "spatial", "anomalies_annual"}
    assert all(r["nvals"] == 2 for r in got if r["level"] == "spatial")


def test_prepare_drivers(spark):
    forcing = spark.createDataFrame([(s, day(366 * y), 1.0) for s in "abcd" for y in range(5)], "sitename string, date date, gpp double")
    info = spark.createDataFrame([("a", "ENF"), ("b", "CRO"), ("c", None), ("d", "GRA")], "sitename string, igbp_land_use string")
    years = spark.createDataFrame(
        [("a", False, False, 2001, 2004, 2000, 2003), ("b", False, False, 2000, 2004, 2000, 2004), ("c", False, False, 2000, 2001, 2000, 2004),
         ("d", False, None, 2000, 2004, 2000, 2004)],
        "sitename string, drop_gpp boolean, drop_le boolean, year_start_gpp int, year_end_gpp int, year_start_le int, year_end_le int")
    got = prepare_drivers(forcing, info, years, exclusions=[("a", 2003)])
    assert sorted((r["sitename"], r["date"].year) for r in got.collect()) == [("a", 2001), ("a", 2002), ("c", 2000), ("c", 2001)]


def test_a_roll_up_equals_the_evaluation_of_each_variable(spark, daily, meta):
    """Two variables with gaps of their own, one with annual observations only, and a table of sites."""
    both = daily.selectExpr(
        "sitename", "date", "mod AS gpp", "mod * 2 - 1 AS le", "obs", "CASE WHEN dayofyear(date) <> 100 THEN obs + 3 END AS heat", "obs / 2 AS aet")
    mod, obs = both.select("sitename", "date", "gpp", "le", F.col("gpp").alias("aet")), both.where("obs IS NOT NULL").select("sitename", "date", "obs", "heat", "aet")
    names = {"gpp": "obs", "le": "heat", "aet": "aet"}
    for sites in (None, meta.where("sitename < 's3'").select("sitename")):
        settings = Settings({"gpp": "fluxnet", "le": "fluxnet_x", "aet": "camels"}, sites, 300, names)
        rolled = roll_up(mod, obs, settings)
        got = {(r["variable"], r["level"]): r for r in rolled.metrics().collect()}
        want = metrics_table(evaluate(mod, settings, build_observations(obs, meta, ["obs", "heat", "aet"]))).collect()
        assert len(got) == len(want) == 23
        assert all(same_stats(got[r["variable"], r["level"]], r) for r in want)
        assert {r["level"] for r in rolled.site_scores().where("variable = 'aet'").collect()} == {"annual", "anomalies_annual"}


def test_a_roll_up_reads_its_tables_once(spark, daily, monkeypatch):
    """The written days are the only plan that holds the given tables."""
    seen, staged = {}, rollup.stage

    def watching(df, label):
        seen[label] = df._jdf.queryExecution().analyzed().toString()
        return staged(df, label)

    monkeypatch.setattr(rollup, "stage", watching)
    mod = daily.selectExpr("sitename", "date", "mod AS gpp", "'model' AS which_model")
    obs = daily.selectExpr("sitename", "date", "obs AS gpp", "'observed' AS which_obs")
    metrics = roll_up(mod, obs, Settings({"gpp": "fluxnet"}, min_days=300)).metrics()
    plans = seen | {"metrics": metrics._jdf.queryExecution().analyzed().toString()}
    for name in ("which_model", "which_obs"):
        assert [label for label, plan in plans.items() if name in plan] == ["rollup_days"] and plans["rollup_days"].count(f"AS {name}#") == 1


def test_unknown_sources_are_refused(spark, daily):
    obs = build_observations(daily.select("sitename", "date", "obs"), None, ["obs"])
    for source in ("fluxnt", "", "fluxnet_camels"):
        with pytest.raises(ValueError, match="fluxnet"):
            evaluate(daily.select("sitename", "date", F.col("mod").alias("obs")), Settings({"obs": source}), obs)
