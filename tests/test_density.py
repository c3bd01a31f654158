import math

import numpy as np
import pandas as pd
import pytest

from siteskill.operators.density import axis_limit, density_classes, hex_bins, kernel_density
from siteskill.plans.comparison import heat_pairs, model_against_obs


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(6)
    x = rng.normal(10, 3, 400)
    return pd.DataFrame({"x": x, "y": x + rng.normal(0, 2, 400)})


def kde(points, n, only="none"):
    h = {}
    for a in ("x", "y"):
        q1, q3 = np.quantile(points[a], [0.25, 0.75])
        h[a] = 4 * 1.06 * min(points[a].std(ddof=1), (q3 - q1) / 1.34) * len(points) ** -0.2 / 4
    phi = {a: np.exp(-0.5 * ((np.linspace(points[a].min(), points[a].max(), n)[:, None] - points[a].to_numpy()) / h[a]) ** 2)
           / math.sqrt(2 * math.pi) for a in ("x", "y")}
    if only != "none":
        phi["y" if only == "x" else "x"][:] = 1.0
    return phi["x"] @ phi["y"].T / (len(points) * h["x"] * h["y"])


@pytest.mark.parametrize("only", ["none", "x", "y"])
def test_kernel_density(spark, points, only):
    got = kernel_density(spark.createDataFrame(points).repartition(5), "x", "y", n=15, only=only).toPandas()
    z = got.pivot(index="ix", columns="iy", values="z").to_numpy()
    assert np.allclose(z, kde(points, 15, only), rtol=1e-9)


def test_bad_points_and_limits_are_left_out(spark, points):
    bad = pd.DataFrame({"x": [np.nan, np.inf, 1.0, 500.0], "y": [1.0, 1.0, -np.inf, 1.0]})
    df = spark.createDataFrame(pd.concat([points, bad]))
    got = kernel_density(df, "x", "y", n=9, xlim=(-100, 100)).toPandas().pivot(index="ix", columns="iy", values="z").to_numpy()
    assert np.allclose(got, kde(points, 9), rtol=1e-9)


def test_no_points(spark):
    with pytest.raises(ValueError):
        kernel_density(spark.createDataFrame([(None, 1.0)], "x double, y double"), "x", "y")


def test_density_classes(spark, points):
    z = kde(points, 12)
    got = density_classes(spark.createDataFrame(points), "x", "y", n=12).toPandas()
    assert len(got) == len(points) and got.density_class.between(1, 30).all()

    def cell(t, low, high, bins):
        return np.clip(np.round((t - low) / (high - low) * bins + 0.5), 1, bins).astype(int)

    ix = cell(got.x, points.x.min(), points.x.max(), 12)
    iy = cell(got.y, points.y.min(), points.y.max(), 12)
    assert (got.ix == ix).all() and (got.iy == iy).all()
    assert (got.density_class == cell(z[ix - 1, iy - 1], z.min(), z.max(), 30)).all()


def test_constant_axis_takes_the_other_bandwidth(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(20)], "x double, y double")
    got = kernel_density(df, "x", "y", n=4).toPandas()
    assert np.isfinite(got.z).all()


def test_hexagons(spark, points):
    got = hex_bins(spark.createDataFrame(points), "x", "y", bins=10, limits=(0.0, 20.0)).toPandas()
    shown = points[points.x.between(0, 20) & points.y.between(0, 20)]
    assert got.n.sum() == len(shown)
    w, row = 2.0, 2.0 * math.sqrt(3)
    x0, y0 = (math.floor(shown[a].min() / w) * w - 1e-6 for a in ("x", "y"))
    centres = [(x0 + (i + o) * w, y0 + (j + o) * row) for i in range(-1, 13) for j in range(-1, 9) for o in (0, 0.5)]
    count = {}
    for px, py in shown.itertuples(index=False):  # the nearest of all centres
        c = min(centres, key=lambda c: (c[0] - px) ** 2 + (c[1] - py) ** 2)
        count[round(c[0], 6), round(c[1], 6)] = count.get((round(c[0], 6), round(c[1], 6)), 0) + 1
    assert {(round(r.x, 6), round(r.y, 6)): r.n for r in got.itertuples()} == count


def test_axis_limit_rounds_half_to_even(spark):
    df = spark.createDataFrame([(2.5, 1.0), (2.5, 1.0)], "mod double, obs double")
    assert axis_limit(df).first()["limit"] == 2.0


def test_model_against_obs(spark, points):
    df = spark.createDataFrame(points)
    for kind in ("points", "hex", "heat", "density"):
        out = model_against_obs(df, "x", "y", kind, relative=True)
        assert out.layer.count() > 0
    wide = {r["metric"]: r["estimate"] for r in out.metrics.collect()}
    short, line = out.results.first(), out.line.first()
    assert short["rmse"] == pytest.approx(wide["rmse"] / points.y.mean()) and short["n"] == len(points)
    assert line["slope"] == pytest.approx(np.polyfit(points.x, points.y, 1)[0])
    assert out.layer.agg({"nlevel": "max"}).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        model_against_obs(df, "x", "y", "bars")


def test_density_layer_counts_pairs_outside(spark):
    rows = [(float(k), float(k * k % 7)) for k in range(20)] + [(-1.0, 2.0), (3.0, -2.0), (float("inf"), 1.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert model_against_obs(df, "x", "y", "density").outside.first()["n_outside"] == 3
    assert model_against_obs(df, "x", "y", "density", xlim=(0.0, 9.0)).outside.first()["n_outside"] == 13
    assert model_against_obs(df, "x", "y", "heat", ylim=(-5.0, 10.0)).outside.first()["n_outside"] == 1


def test_heat_pairs(spark, points):
    pdf = points.assign(w=points.x - points.y)
    matrix, layer = heat_pairs(spark.createDataFrame(pdf), ["x", "y", "w"], n=8)
    assert matrix.count() == 3 and layer.count() == 3 * len(points)
    _, logs = heat_pairs(spark.createDataFrame(pdf), ["x", "w"], n=8, log="xy")
    assert logs.count() == ((pdf.x > 0) & (pdf.w > 0)).sum()
