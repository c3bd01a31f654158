import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siteskill.functions.nulls import finite, nan_to_null, not_in, not_true, skip_sum, strict_mean, strict_sum
from siteskill.operators import score

from .helpers import close

PAIRS = "g string, mod double, obs double"


def frame(spark, groups):
    return spark.createDataFrame([(g, m, o) for g, pairs in groups.items() for m, o in pairs], PAIRS)


def reference_stats(mod, obs):
    d = pd.DataFrame({"m": mod, "o": obs}).dropna()
    slope, intercept = np.polyfit(d.m, d.o, 1)
    residual = ((d.o - slope * d.m - intercept) ** 2).sum()
    r2 = 1 - residual / ((d.o - d.o.mean()) ** 2).sum()
    n = len(d)
    return 1 - (1 - r2) * (n - 1) / (n - 2), math.sqrt(((d.m - d.o) ** 2).mean()), slope, (d.m - d.o).mean(), n, intercept


def test_regression_stats_match_least_squares(spark):
    rng = np.random.default_rng(1)
    mod = rng.normal(1e4, 3, 500)  # a large mean: nothing may cancel
    obs = 0.7 * mod + rng.normal(0, 2, 500)
    pairs = [(float(m) if i % 7 else None, float(o) if i % 5 else None) for i, (m, o) in enumerate(zip(mod, obs))]
    got = score.stats_by_group(frame(spark, {"a": pairs}), ["g"]).first()
    want = reference_stats([p[0] for p in pairs], [p[1] for p in pairs])
    for name, value in zip(("rsq", "rmse", "slope", "bias", "nvals", "intercept"), want):
        assert close(got[name], value, 1e-6), name


def test_degenerate_groups(spark):
    df = frame(spark, {
        "null": [(None, None), (None, 1.0)], "one": [(1.0, 2.0)], "two": [(1.0, 2.0), (2.0, 5.0)],
        "flat_mod": [(1.0, 2.0), (1.0, 5.0), (1.0, 3.0)], "flat_obs": [(1.0, 2.0), (2.0, 2.0), (4.0, 2.0)],
    })
    got = {r["g"]: r for r in score.regression_stats(df, ["g"]).collect()}
    assert got["null"]["nvals"] == 0 and got["null"]["rmse"] is None and got["null"]["bias"] is None
    assert got["one"]["rsq"] is None and got["one"]["rmse"] == 1.0
    assert got["two"]["rsq"] is None and got["two"]["slope"] == 3.0
    assert got["flat_mod"]["rsq"] == 0.0 and got["flat_mod"]["slope"] is None
    assert got["flat_obs"]["rsq"] is None and got["flat_obs"]["slope"] == 0.0


def test_guard_blanks_scores_with_two_observations(spark):
    got = score.regression_stats(frame(spark, {"a": [(1.0, 2.0), (2.0, 4.0), (3.0, None)]}), guarded=True).first()
    assert got["rmse"] is None and got["nvals"] == 2


def test_support_rules(spark):
    df = frame(spark, {
        "pairs": [(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)],
        "known": [(1.0, 1.0), (2.0, 2.0), (3.0, None), (None, 4.0)],
    })
    assert {r["g"] for r in score.stats_by_group(df, ["g"], support="pairs").collect()} == {"pairs"}
    assert {r["g"] for r in score.stats_by_group(df, ["g"]).collect()} == {"pairs", "known"}


def test_metric_set_and_relative_form(spark):
    pairs = [(1.0, 2.0), (3.0, 0.0), (5.0, 4.0), (None, 9.0)]
    wide = score.metric_set(frame(spark, {"a": pairs})).first()
    relative = score.metric_set(frame(spark, {"a": pairs}), relative=True).first()
    assert wide["n"] == 3 and wide["n_zero_obs"] == 1
    assert close(wide["mae"], 5 / 3) and close(wide["mean_obs"], 2.0)
    assert close(wide["pbias"], (-0.5 + 0.25) / 2)
    assert close(relative["rmse"], wide["rmse"] / 2.0) and close(relative["bias"], wide["bias"] / 2.0)
    long = {r["metric"]: r["estimate"] for r in score.metrics_long(score.metric_set(frame(spark, {"a": pairs}))).collect()}
    assert set(long) == set(score.METRICS) and close(long["rsq"], wide["rsq"])


def test_quick_metrics_are_strict_unless_told(spark):
    df = frame(spark, {"whole": [(1.0, 2.0), (2.0, 3.0), (4.0, 9.0)], "gap": [(1.0, 2.0), (2.0, None), (4.0, 9.0)]})
    strict = {r["g"]: r for r in score.quick_metrics(df, ["g"]).collect()}
    loose = {r["g"]: r for r in score.quick_metrics(df, ["g"], skip_null=True).collect()}
    assert strict["gap"]["mae"] is None and strict["whole"]["mae"] is not None
    assert close(loose["gap"]["mae"], 3.0)


def test_zone_score(spark):
    df = frame(spark, {"z": [(1.0, 2.0), (2.0, 4.0), (4.0, 6.0)]})
    got = score.zone_metrics(df, ["g"], "mod", "obs").first()
    assert close(got["nnse_ref"], 1 / (1 + 5.0 / 4.0)) and close(got["mae"], 5 / 3)


def test_fitted_values_and_line_ends(spark):
    df = frame(spark, {"a": [(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (9.0, None), (None, 1.0)]})
    fitted = score.add_fitted(df, score.linear_fit(df, ["g"]), ["g"])
    values = {r["mod"]: r["fitted"] for r in fitted.collect()}
    assert close(values[2.0], 5.0) and values[9.0] is None and values[None] is None
    ends = score.line_ends(fitted, ["g"]).first()
    assert (ends["xmin"], ends["xmax"]) == (1.0, 3.0) and close(ends["ymin"], 3.0) and close(ends["ymax"], 7.0)


def test_null_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)], "g string, v double")
    got = {r["g"]: r for r in df.groupBy("g").agg(
        strict_mean("v").alias("m"), strict_sum("v").alias("s"), skip_sum("v").alias("k")).collect()}
    assert (got["a"]["m"], got["a"]["s"], got["a"]["k"]) == (None, None, 1.0)
    assert (got["b"]["m"], got["b"]["s"], got["b"]["k"]) == (3.0, 6.0, 6.0)
    assert (got["c"]["m"], got["c"]["k"]) == (None, 0.0)


def test_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert nan_to_null(df).where(F.col("v").isNull()).count() == 2
    assert [r["v"] for r in df.where(finite("v")).collect()] == [1.0]


def test_negated_membership_keeps_nulls(spark):
    df = spark.createDataFrame([("x", True), ("y", False), (None, None)], "k string, c4 boolean")
    assert df.where(not_in("k", ["x"])).count() == 2
    assert df.where(not_true("c4")).count() == 2
