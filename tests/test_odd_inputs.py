"""Null keys, null dates, values that are not finite, constant axes, and limits inside or without data."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from siteskill.operators import density
from siteskill.operators.folds import fold_split, training_sets
from siteskill.operators.gaps import interpolate
from siteskill.operators.joins import drop_sites, keep_sites
from siteskill.operators.runs import find_runs, running_length
from siteskill.operators.score import regression_stats
from siteskill.plans.candidates import score_runs, within_bounds
from siteskill.plans.events import align_events
from siteskill.plans.observations import build_observations_xdaily

from .helpers import day

SERIES = "site string, date date, v double, flag boolean"


def series(spark, n=40):
    """Two equal series, one of them without a name."""
    one = [(day(i * 20), None if i % 3 == 1 else float(i), i % 5 < 3) for i in range(n)]
    return spark.createDataFrame([(s, *r) for s in ("a", None) for r in one], SERIES)


def by_site(frame, *columns):
    out = {"a": [], None: []}
    for r in frame.orderBy("site", columns[0]).collect():
        out[r["site"]].append(tuple(r[c] for c in columns))
    return out


def test_series_without_a_name_scan_like_others(spark):
    df = series(spark)
    for frame, columns in (
        (interpolate(df, ["site"], "date", ["v"]), ("date", "v")),
        (running_length(df, "flag"), ("date", "run_len")),
        (find_runs(df, "flag", 2), ("start", "len", "run_id")),
    ):
        got = by_site(frame, *columns)
        assert got["a"] and got["a"] == got[None]


def test_rows_without_a_date_stay_and_come_first(spark):
    df = spark.createDataFrame([("a", None, 1.0, True), ("a", day(0), None, True), ("a", day(400), 3.0, False)], SERIES)
    assert by_site(interpolate(df, ["site"], "date", ["v"]), "date", "v")["a"] == [(None, 1.0), (day(0), 2.0), (day(400), 3.0)]
    assert by_site(running_length(df, "flag"), "date", "run_len")["a"] == [(None, 1), (day(0), 2), (day(400), 0)]


def test_events_of_a_series_without_a_name(spark):
    df = series(spark).withColumn("w", F.coalesce("v", F.lit(0.0)))
    rows = align_events(df.select("site", "date", "w"), df.select("site", "date", F.col("flag").alias("isevent")), ["w"], 2, 1, 2).rows
    got = by_site(rows, "date", "dday", "w")
    assert got["a"] and sorted(got["a"]) == sorted(got[None])


def test_a_bin_that_holds_no_row_stops_the_query(spark):
    df = series(spark).withColumn("w", F.coalesce("v", F.lit(0.0)))
    flags = df.select("site", "date", F.col("flag").alias("isevent"))
    with pytest.raises(Exception, match="bins hold rows"):
        align_events(df.select("site", "date", "w"), flags, ["w"], 2, 1, 2, do_norm=True, nbins=2, normbin=9).rows.collect()


def test_a_site_without_a_name_is_in_a_fold(spark):
    sites = spark.createDataFrame([(f"s{i}",) for i in range(10)] + [(None,)], "sitename string")
    folds = fold_split(sites, 5)
    assert folds.count() == 11
    assert training_sets(sites, folds, 5).count() == 44
    none = sites.where("sitename IS NULL")
    assert keep_sites(sites, none).count() == 1 and drop_sites(sites, none).count() == 10


def test_days_of_later_years_keep_their_bins(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(1200)]
    daily = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days)], "sitename string, date date, v double")
    obs = build_observations_xdaily(daily, None, ["v"])
    got = sorted((r["inbin"], r["v"]) for r in obs.xdf.collect())
    assert got == [(days[i], sum(range(i, min(i + 8, 1200))) / len(range(i, min(i + 8, 1200)))) for i in range(0, 1200, 8)]
    assert [tuple(r) for r in obs.outside.collect()] == [("a", 0)]
    cut = build_observations_xdaily(daily, None, ["v"], first=str(days[16]), last=str(days[40]))
    assert sorted(r["v"] for r in cut.xdf.collect()) == [19.5, 27.5, 36.0]
    assert cut.outside.first()["n_outside"] == 1200 - 25


def test_histogram_takes_finite_values(spark):
    values = [1.0, 2.0, 3.0, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    got = density.histogram(df, ["a"], 4).collect()
    assert sum(r["n"] for r in got) == 3 and {r["n_outside"] for r in got} == {3}


def test_density_of_a_constant_axis(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(20)] + [(1.0, 3.0)], "x double, y double")
    got = density.density_classes(df, "x", "y", n=10, classes=5).collect()
    assert len(got) == 21 and {r["ix"] for r in got} == {1}
    flat = density.density_classes(spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double"), "x", "y", n=4, classes=5)
    assert [(r["ix"], r["iy"]) for r in flat.collect()] == [(1, 1)] * 3


def test_large_grids_are_summed_in_stripes(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 23).cast("double").alias("y"))
    whole = {(r["ix"], r["iy"]): r["z"] for r in density.kernel_density(df, "x", "y", n=12).collect()}
    monkeypatch.setattr(density, "STRIPE_CELLS", 50)
    striped = {(r["ix"], r["iy"]): r["z"] for r in density.kernel_density(df, "x", "y", n=12).collect()}
    assert len(whole) == 144 and striped.keys() == whole.keys()
    assert all(striped[k] == pytest.approx(z, rel=1e-9) for k, z in whole.items())


def test_hexagons_without_extent_are_no_rows(spark):
    small = spark.createDataFrame([(0.1 * i, 0.1 * i) for i in range(1, 5)], "mod double, obs double")
    assert density.hex_bins(small).collect() == []
    assert density.hex_bins(small.limit(0)).collect() == []
    some = density.hex_bins(spark.createDataFrame([(1.0, 1.0), (50.0, 1.0), (-1.0, 2.0)], "mod double, obs double"), limits=(0.0, 10.0))
    assert [(r["n"], r["n_outside"]) for r in some.collect()] == [(1, 2)]


def test_scores_take_finite_pairs(spark):
    rows = [(float(i), 2.0 * i + i % 2) for i in range(9)]
    finite = spark.createDataFrame(rows, "mod double, obs double")
    odd = spark.createDataFrame([*rows, (math.inf, 1.0), (1.0, math.nan)], "mod double, obs double")
    assert regression_stats(odd).collect() == regression_stats(finite).collect()


def test_candidates_without_pairs_and_without_parameters(spark):
    obs = spark.createDataFrame([(1, 1.0), (2, 2.0)], "t int, mod double")
    sim = spark.createDataFrame([("p", 1, 1.5), ("p", 2, 2.0), ("q", 9, 1.0), ("r", 1, None)], "param_set string, t int, mod double")
    got = {r["param_set"]: (r["cost"], r["n"]) for r in score_runs(sim, obs, ["t"], "mae", observed="mod").collect()}
    assert got == {"p": (0.25, 2), "q": (None, 0), "r": (None, 0)}
    params = spark.createDataFrame([("p", "k", 1.0), ("p", "l", 1.0), ("q", "k", 1.0)], "param_set string, param string, value double")
    ranges = spark.createDataFrame([("k", 0.0, 2.0), ("l", 0.0, 2.0)], "param string, lower double, upper double")
    assert {r[0]: r[1] for r in within_bounds(params, ranges).collect()} == {"p": True, "q": False}
