from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from siteskill.catalog.scoring import rounded_mean
from siteskill.operators.correlation import correlation, correlation_matrix, kendall

from .helpers import close


def tau_by_all_pairs(x, y):
    sx, sy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    return (sx * sy).sum() / np.sqrt(np.abs(sx).sum() * np.abs(sy).sum())


@pytest.fixture(scope="module")
def ties():
    rng = np.random.default_rng(8)
    n = 1500
    g = np.where(rng.random(n) < 0.7, "hot", "cold")
    x = np.round(rng.normal(0, 2, n) * 4) / 4
    x[rng.random(n) < 0.3] = 0.0  # one value holds a third of the rows
    y = np.round(x + rng.normal(0, 2, n), 1)
    y[rng.random(n) < 0.2] = -1.0
    pdf = pd.DataFrame({"g": g, "x": x, "y": y, "z": rng.normal(0, 1, n) - y})
    pdf.loc[rng.random(n) < 0.05, "y"] = np.nan
    return pdf


def spark_frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(
        f"{c} {'string' if c == 'g' else 'double'}" for c in pdf.columns))


@pytest.mark.parametrize("block_rows", [1, 60, 50_000])
def test_kendall_over_many_blocks(spark, ties, block_rows):
    got = {r["g"]: r["cor"] for r in kendall(spark_frame(spark, ties), ["g"], "x", "y", block_rows).collect()}
    for g, d in ties.dropna().groupby("g"):
        assert close(got[g], tau_by_all_pairs(d.x.to_numpy(), d.y.to_numpy()), 1e-12)


def test_ranks_and_moments(spark, ties):
    df = spark_frame(spark, ties)
    for method in ("pearson", "spearman"):
        got = {r["g"]: r["cor"] for r in correlation(df, "x", "y", method, ["g"], digits=None).collect()}
        for g, d in ties.dropna().groupby("g"):
            a, b = (d.x.rank(), d.y.rank()) if method == "spearman" else (d.x, d.y)
            assert close(got[g], np.corrcoef(a, b)[0, 1], 1e-10)


def test_pooled_and_rounded(spark, ties):
    d = ties.dropna()
    df = spark_frame(spark, ties)
    assert correlation(df, "x", "y", "kendall").first()["cor"] == round(tau_by_all_pairs(d.x.to_numpy(), d.y.to_numpy()), 2)
    assert correlation(df, "x", "y").first()["cor"] == round(np.corrcoef(d.x.rank(), d.y.rank())[0, 1], 2)


def test_constant_side_gives_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    for method in ("pearson", "spearman", "kendall"):
        assert correlation(df, "x", "y", method).first()["cor"] is None


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_matrix_uses_complete_rows_of_each_pair(spark, ties, method):
    got = {(r["a"], r["b"]): (r["cor"], r["n"]) for r in correlation_matrix(spark_frame(spark, ties), ["x", "y", "z"], method, digits=None).collect()}
    for a, b in combinations(["x", "y", "z"], 2):
        d = ties[[a, b]].dropna()
        want = (tau_by_all_pairs(d[a].to_numpy(), d[b].to_numpy()) if method == "kendall"
                else np.corrcoef(*((d[a].rank(), d[b].rank()) if method == "spearman" else (d[a], d[b])))[0, 1])
        assert close(got[a, b][0], want, 1e-10) and got[a, b][1] == len(d)


def test_matrix_on_log_axes(spark, ties):
    d = ties[(ties.x > 0) & (ties.z > 0)]
    got = correlation_matrix(spark_frame(spark, ties), ["x", "z"], "pearson", digits=None, positive_only=True).first()
    assert close(got["cor"], np.corrcoef(d.x, d.z)[0, 1], 1e-10) and got["n"] == len(d)


def test_rounded_mean_does_not_follow_the_order_of_rows(spark):
    """The mean of 0.9 and 0.91, forty times each, is 0.905: half a digit up, whatever the float sum says."""
    values = [0.9] * 40 + [0.91] * 40
    for order in (values, values[::-1], values[::2] + values[1::2]):
        df = spark.createDataFrame([(v,) for v in order], "v double").coalesce(1)
        assert df.agg(rounded_mean("v", 2).alias("m")).first()["m"] == 0.91
