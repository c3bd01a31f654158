"""Sources, nesting, preparation, folds, candidates and comparison."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from siteskill.functions import text, units
from siteskill.operators import compare, folds, prep
from siteskill.operators.compare import compare_tables
from siteskill.operators.joins import join_null_safe
from siteskill.plans.candidates import best_run, score_runs, within_bounds
from siteskill.session import SHARED_DIR, shared_dir, stage
from siteskill.sources import nested as N
from siteskill.sources import tables as T

from .helpers import close, day


def test_csv_reads_na_as_null(spark, tmp_path):
    (tmp_path / "s.csv").write_text("sitename,lon,lat,elv,whc,koeppen_code,igbp_land_use\na,1.5,NA,NaN,,Cfb,NA\n")
    row = T.read_csv(spark, str(tmp_path / "s.csv"), T.SITE_INFO_SCHEMA).first()
    assert row["lon"] == 1.5 and row["lat"] is None and row["elv"] is None and row["whc"] is None and row["igbp_land_use"] is None


def test_tables_round_trip_and_light_form(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, float("nan"))], "sitename string, v double, w double")
    T.write_table(df, str(tmp_path / "full"))
    T.write_table(df, str(tmp_path / "light"), ["sitename", "v"])
    assert T.read_table(spark, str(tmp_path / "full")).first()["w"] is None
    assert T.read_table(spark, str(tmp_path / "light")).columns == ["sitename", "v"]


def test_a_fold_has_its_own_folder(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "sitename string, fold int")
    T.write_by_fold(df, str(tmp_path / "folds"))
    one = spark.read.parquet(str(tmp_path / "folds")).where("fold = 2")
    assert [r["sitename"] for r in one.collect()] == ["b"] and len(one.inputFiles()) >= 1


def test_a_rewritten_fold_leaves_the_others_alone(spark, tmp_path, capsys):
    path = str(tmp_path / "folds")
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0), ("c", 2, float("nan"))], "sitename string, fold int, v double")
    T.write_by_fold(df, path)
    T.write_by_fold(df.where("sitename = 'b'").withColumn("v", F.lit(9.0)), path)
    assert [(r["sitename"], r["v"]) for r in T.read_fold(spark, path, 2).collect()] == [("b", 9.0)]
    assert [(r["sitename"], r["v"]) for r in T.read_fold(spark, path, 1).collect()] == [("a", 1.0)]
    T.read_fold(spark, path, 1).explain()
    assert "PartitionFilters: [isnotnull(fold" in capsys.readouterr().out


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None, float("nan"), None, "x,\"y\"", None)], T.SITE_INFO_SCHEMA)
    T.write_csv(df, str(tmp_path / "csv"))
    row = T.read_csv(spark, str(tmp_path / "csv"), T.SITE_INFO_SCHEMA).first()
    assert (row["lon"], row["lat"], row["elv"], row["koeppen_code"], row["igbp_land_use"]) == (1.5, None, None, 'x,"y"', None)


def test_nesting_round_trip(spark, rows):
    data = [("a", day(i), float(i)) for i in (400, 3, 1)] + [("b", day(0), None)]
    df = spark.createDataFrame(data, "sitename string, date date, v double")
    nested = N.nest_series(df, ["v"])
    assert nested.count() == 3  # one row per site and year
    assert all([r["date"] for r in x["data"]] == sorted(r["date"] for r in x["data"]) for x in nested.collect())
    assert rows(N.unnest_series(nested), "sitename", "date", "v") == rows(df)


def test_empty_series_vanish(spark):
    df = spark.createDataFrame([("a", []), ("b", None), ("c", [(1.0,)])], "sitename string, data array<struct<v: double>>")
    assert [r["sitename"] for r in N.unnest_series(df).collect()] == ["c"]
    assert [r["sitename"] for r in N.non_empty(df).collect()] == ["c"]


def test_struct_columns(spark):
    df = spark.createDataFrame([("a", (1.0, 2.0))], "sitename string, info struct<lon: double, lat: double>")
    row = N.spread_struct(N.set_fields(df, "info", {"lat": F.lit(9.0), "use_gs": F.lit(True)}), "info").first()
    assert (row["lon"], row["lat"], row["use_gs"]) == (1.0, 9.0, True)


def test_stack_fills_missing_columns(spark):
    a = spark.createDataFrame([(1.0,)], "x double")
    b = spark.createDataFrame([(2.0, "s")], "x double, site string")
    got = {r["level"]: r for r in N.stack_tables({"a": a, "b": b}).collect()}
    assert got["a"]["site"] is None and got["b"]["site"] == "s"


def test_filters(spark):
    q = spark.createDataFrame([(day(0), 1.0, 0.8), (day(1), 2.0, 0.81), (day(2), 3.0, None)], "date date, gpp double, gpp_qc double")
    assert [r["gpp"] for r in prep.quality_filter(q).collect()] == [2.0]
    sites = spark.createDataFrame([("a", "TRUE"), ("b", "FALSE"), ("c", "false"), ("d", None)], "sitename string, drop_gpp string")
    assert [r["sitename"] for r in prep.undropped(sites, ["drop_gpp"]).collect()] == ["b", "c"]
    p = spark.createDataFrame([(1.0, 1.0), (-1.0, 2.0), (3.0, float("inf")), (None, 1.0)], "x double, y double")
    assert prep.finite_pairs(p, "x", "y").count() == 2 and prep.finite_pairs(p, "x", "y", log="x").count() == 1
    tags = spark.createDataFrame([("v3.1",), ("v4.5",), ("v5",)], "tag string")
    assert [r["tag"] for r in prep.tagged(tags, "tag", "4", "v").collect()] == ["v4.5"]
    assert prep.recode(spark.createDataFrame([("BSk",), ("Cfb",)], "koeppen_code string")).where("koeppen_code = 'Bsk'").count() == 1


def test_water_balance(spark):
    df = spark.createDataFrame([("wet", 100.0, 1e-3), ("dry", 100.0, 1e-6), ("even", None, 0.0)], "sitename string, le double, rain double")
    df = df.withColumns({"temp": F.lit(20.0), "patm": F.lit(101325.0)})
    assert {r["sitename"] for r in prep.water_balance_sites(df).collect()} == {"wet", "even"}


def test_water_physics(spark):
    row = spark.range(1).select(
        units.latent_heat(F.lit(20.0)).alias("h"), units.water_density(F.lit(20.0), F.lit(101325.0)).alias("rho"),
        units.evapotranspiration(F.lit(100.0), F.lit(20.0), F.lit(101325.0)).alias("et"),
    ).first()
    assert abs(row["h"] - 2.454e6) < 2e3 and abs(row["rho"] - 998.2) < 0.1 and abs(row["et"] - 3.53) < 0.01


def test_labels(spark):
    row = spark.range(1).select(
        text.koeppen_code(F.lit("Cfb - temperate")), text.hemisphere(F.lit(0.0)), text.hemisphere(F.lit(None).cast("double")),
        text.climate_zone(F.lit(None).cast("string"), F.lit("north")), units.unit_label(F.lit("nee")),
    ).first()
    assert tuple(row) == ("Cfb", "south", None, "NA north", None)


def test_null_keys_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    assert sorted((r["v"], r["w"]) for r in join_null_safe(a, b, ["k"]).collect()) == [(1, 10), (2, 20)]


def test_folds_are_disjoint_complete_balanced_and_stable(spark):
    sites = spark.createDataFrame([(f"site{i}", float(i % 17)) for i in range(109)], "sitename string, temp double")
    split = folds.fold_split(sites, 5, ["temp"])
    rows = split.collect()
    assert len(rows) == 109 and len({r["sitename"] for r in rows}) == 109 and {r["fold"] for r in rows} == {1, 2, 3, 4, 5}
    for stratum in {r["stratum"] for r in rows}:
        sizes = [sum(r["fold"] == k and r["stratum"] == stratum for r in rows) for k in range(1, 6)]
        assert max(sizes) - min(sizes) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, folds.fold_split(sites.repartition(7), 5, ["temp"]).collect()))
    data = sites.crossJoin(spark.range(2))
    assert folds.train_rows(data, split, 3).count() + folds.test_rows(data, split, 3).count() == 218
    sets = folds.training_sets(data, split, 5)
    assert sets.count() == 218 * 4 and sets.where("fold = 3").count() == folds.train_rows(data, split, 3).count()
    assert [r["n"] for r in folds.fold_split(sites).groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold").collect()] == [22, 22, 22, 22, 21]


def test_candidates(spark):
    obs = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, obs double")
    sim = spark.createDataFrame([(p, k, k + e) for p, e in (("a", 1.0), ("b", 0.5), ("c", 0.1)) for k in (1, 2, 3)], "param_set string, k int, mod double")
    scores = score_runs(sim, obs, ["k"])
    assert {r["param_set"]: round(r["cost"], 6) for r in scores.collect()} == {"a": 1.0, "b": 0.5, "c": 0.1}
    ranges = spark.createDataFrame([("kphio", 0.02, 0.15, 0.05)], "param string, lower double, upper double, init double")
    params = spark.createDataFrame([("a", "kphio", 0.02), ("b", "kphio", 0.15), ("c", "kphio", 0.2)], "param_set string, param string, value double")
    bounds = within_bounds(params, ranges)
    assert best_run(scores, bounds).first()["param_set"] == "b" and best_run(scores).first()["param_set"] == "c"
    largest = score_runs(sim, obs, ["k"], metric=lambda m, o: F.max(F.abs(m - o)))
    assert close(best_run(largest).first()["cost"], 0.1)


@pytest.mark.parametrize("change,equal", [(1 + 1e-7, True), (1.01, False)])
def test_compare_tables(spark, change, equal):
    a = spark.createDataFrame([(1, 2.0, None), (2, 4.0, 1.0)], "k int, x double, y double")
    b = a.withColumn("x", F.col("x") * change)
    got = {r["column"]: r for r in compare_tables(a, b, ["k"], ["x", "y"]).collect()}
    assert got["x"]["is_equal"] is equal and got["y"]["is_equal"] is True
    assert compare_tables(a, b.where("k = 1"), ["k"], ["y"]).first()["n_unmatched"] == 1
    assert compare_tables(a, a.withColumn("y", F.lit(1.0)), ["k"], ["y"]).first()["is_equal"] is False


def test_stage_uses_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    df = stage(spark.range(5), "five")
    assert shared_dir(spark) == named
    assert df.count() == 5 and all(named in f for f in df.inputFiles())


def test_a_cluster_must_name_a_shared_folder():
    context = SimpleNamespace(master="yarn", applicationId="x")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(RuntimeError):
        shared_dir(session)
    context.master = "local[2]"
    with pytest.raises(RuntimeError):
        shared_dir(session)
    session.conf.get = lambda key, default: {SHARED_DIR: "/shared/"}.get(key, default)
    assert shared_dir(session) == "/shared"


def test_comparison_of_equal_tables_joins_no_rows(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id DIV 2 AS k", "id * 1.5 AS x", "CASE WHEN id % 9 <> 0 THEN id END AS y")
    sizes, staged = {}, compare.stage

    def counting(frame, label):
        out = staged(frame, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(compare, "stage", counting)
    got = {r["column"]: r for r in compare_tables(df, df.orderBy(F.desc("x")), ["k"], ["x", "y"], buckets=16).collect()}
    assert all(r["is_equal"] and r["n_matched"] == 5000 and r["n_unmatched"] == 0 for r in got.values()) and sizes["compared_rows"] == 0
    changed = df.withColumn("x", F.when(F.col("x") == 30.0, 31.0).otherwise(F.col("x")))
    got = {r["column"]: r for r in compare_tables(df, changed, ["k"], ["x", "y"], buckets=16).collect()}
    assert (got["x"]["n_differ"], got["x"]["n_matched"], got["y"]["n_differ"]) == (1, 5000, 0) and 0 < sizes["compared_rows"] < 500
    fewer = {r["column"]: r for r in compare_tables(df, df.where("x <> 30"), ["k"], ["x"], buckets=16).collect()}
    assert (fewer["x"]["n_matched"], fewer["x"]["n_unmatched"]) == (4999, 1)
    nothing = compare_tables(df.limit(0), df.limit(0), ["k"], ["x"]).first()
    assert nothing["is_equal"] and nothing["n_matched"] == 0
