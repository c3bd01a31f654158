"""Histograms, hexagons and kernel densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density
from ..plans.comparison import heat_pairs, model_against_obs
from ..plans.components import daily_anomalies
from .case import Case
from .levels import _minus, daily
from .views import table

GRID = 40


def _anomalies(spark, sf):
    return daily_anomalies(daily(spark, sf))


ANOMALIES_SQL = _minus("site_daily", "dayofyear(date)", "dayofyear(date) <> 366")


def histogram_sql(source: str, columns: list[str], breaks: int) -> str:
    """Round bin widths, chosen by the same rule, then counts per right-closed bin."""
    series = " UNION ALL ".join(f"SELECT '{c}' AS series, {c} AS v FROM src WHERE {c} IS NOT NULL" for c in columns)
    return f"""
    WITH src AS MATERIALIZED (SELECT * FROM {source}),
    r AS (SELECT min({columns[0]}) AS lo, max({columns[0]}) AS hi FROM src),
    c AS (SELECT lo, hi, (hi - lo) / {breaks} AS cell, pow(10, floor(log10((hi - lo) / {breaks}))) AS base FROM r),
    w2 AS (SELECT *, CASE WHEN 2 * base - cell < 1.5 * (cell - base) THEN 2 * base ELSE base END AS u FROM c),
    w5 AS (SELECT * REPLACE (CASE WHEN 5 * base - cell < 2.75 * (cell - u) THEN 5 * base ELSE u END AS u) FROM w2),
    w AS (SELECT lo, hi, CASE WHEN 10 * base - cell < 1.5 * (cell - u) THEN 10 * base ELSE u END AS u FROM w5),
    e AS (SELECT u, floor(lo / u + 1e-10) * u AS first,
                 CAST(greatest(ceil(hi / u - 1e-10), floor(lo / u + 1e-10) + 1) - floor(lo / u + 1e-10) AS INTEGER) AS bins FROM w),
    p AS (SELECT series, (v - first) / u AS place FROM ({series}), e),
    k AS (SELECT series, CASE WHEN place >= -1e-7 AND place <= bins + 1e-7 THEN least(greatest(ceil(place - 1e-7), 1), bins) END AS bin,
                 count(*) AS n FROM p, e GROUP BY 1, 2),
    t AS (SELECT series, sum(CASE WHEN bin IS NOT NULL THEN n END) AS inside, coalesce(sum(CASE WHEN bin IS NULL THEN n END), 0) AS n_outside
          FROM k GROUP BY 1),
    f AS (SELECT t.*, unnest(generate_series(1, bins)) AS bin, first, u FROM t, e)
    SELECT f.series, f.bin, first + (f.bin - 1) * u AS lower, first + f.bin * u AS upper, coalesce(k.n, 0) AS n,
           coalesce(k.n, 0) / (inside * u) AS density, n_outside
    FROM f LEFT JOIN k ON f.series = k.series AND f.bin = k.bin
    """


HEX_SQL = """
WITH q AS (SELECT mod, obs FROM site_daily WHERE mod IS NOT NULL AND obs IS NOT NULL),
l AS (SELECT round_even(greatest(quantile_cont(mod, 0.9999), quantile_cont(obs, 0.9999)), 0) AS top FROM q),
p AS (SELECT mod, obs, top / 50 AS w FROM q, l WHERE mod BETWEEN 0 AND top AND obs BETWEEN 0 AND top),
c AS (SELECT floor(min(mod) / any_value(w)) * any_value(w) - 1e-6 AS x0, floor(min(obs) / any_value(w)) * any_value(w) - 1e-6 AS y0 FROM p),
u AS (SELECT w, x0, y0, (mod - x0) / w AS u, (obs - y0) / (w * sqrt(3)) AS v FROM p, c),
d AS (SELECT *, floor(u + 0.5) AS eu, floor(v + 0.5) AS ev, floor(u) + 0.5 AS ou, floor(v) + 0.5 AS ov FROM u),
z AS (SELECT w, x0, y0, CASE WHEN pow(u - eu, 2) + 3 * pow(v - ev, 2) <= pow(u - ou, 2) + 3 * pow(v - ov, 2) THEN [eu, ev] ELSE [ou, ov] END AS cell FROM d)
SELECT x0 + cell[1] * w AS x, y0 + cell[2] * w * sqrt(3) AS y, count(*) AS n,
       (SELECT count(*) FROM q, l WHERE NOT (mod BETWEEN 0 AND top AND obs BETWEEN 0 AND top)) AS n_outside FROM z GROUP BY x0, y0, w, cell
"""


def kde_ctes(source: str, x: str, y: str, n: int) -> str:
    bandwidth = "4 * 1.06 * least(stddev_samp({a}), (quantile_cont({a}, 0.75) - quantile_cont({a}, 0.25)) / 1.34) * pow(count(*), -0.2) / 4 AS h{a}"
    return f"""
    pts AS MATERIALIZED (SELECT *, {x} AS x, {y} AS y, row_number() OVER () AS pid FROM {source}
                         WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
    s AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n, {bandwidth.format(a='x')}, {bandwidth.format(a='y')} FROM pts),
    g AS (SELECT CAST(unnest(generate_series(1, {n})) AS INTEGER) AS i),
    kx AS (SELECT pid, i AS ix, exp(-0.5 * pow((x0 + (i - 1) * (x1 - x0) / {n - 1} - x) / hx, 2)) / sqrt(2 * pi()) AS k FROM pts, s, g),
    ky AS (SELECT pid, i AS iy, exp(-0.5 * pow((y0 + (i - 1) * (y1 - y0) / {n - 1} - y) / hy, 2)) / sqrt(2 * pi()) AS k FROM pts, s, g),
    grid AS MATERIALIZED (SELECT ix, iy, x0 + (ix - 1) * (x1 - x0) / {n - 1} AS gx, y0 + (iy - 1) * (y1 - y0) / {n - 1} AS gy, z / (n * hx * hy) AS z
             FROM (SELECT ix, iy, sum(kx.k * ky.k) AS z FROM kx JOIN ky USING (pid) GROUP BY 1, 2), s)
    """


def _cell(v: str, low: str, high: str, n: int) -> str:
    return f"CAST(least(greatest(round_even(({v} - {low}) / ({high} - {low}) * {n} + 0.5, 0), 1), {n}) AS INTEGER)"


def _classes(spark, sf):
    return density.density_classes(daily(spark, sf).select("sitename", "date", "mod", "obs"), "mod", "obs", n=GRID)


def _event_points(spark, sf):
    e = table(spark, sf, "events")
    return e.select("value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def _nlevel(spark, sf):
    """Density view of model against observations; the grid is the default 100 x 100."""
    seen = model_against_obs(daily(spark, sf), "mod", "obs", kind="density")
    return seen.layer.withColumn("n_outside", seen.outside.scalar())


POSITIVE = "(SELECT mod, obs FROM site_daily WHERE mod >= 0 AND obs >= 0)"


def _pair_classes(spark, sf):
    return heat_pairs(_event_points(spark, sf), ["value", "k"], n=20)[1].groupBy("pair", "density_class").agg(F.count("*").alias("n"))


CASES = {
    "e14_histogram_of_anomalies": Case(
        "series:s bin:i lower:f upper:f n:i density:f9 n_outside:i", lambda s, d: density.histogram(_anomalies(s, d), ["obs", "mod"], 50),
        histogram_sql(ANOMALIES_SQL, ["obs", "mod"], 50),
    ),
    "e14_histogram_of_events": Case(
        "series:s bin:i lower:f upper:f n:i density:f9 n_outside:i", lambda s, d: density.histogram(table(s, d, "events"), ["value"], 20),
        histogram_sql("events", ["value"], 20),
    ),
    "e15_hexagon_counts": Case("x:f y:f n:i n_outside:i", lambda s, d: density.hex_bins(daily(s, d)), HEX_SQL),
    "e16_kernel_density": Case(
        "ix:i iy:i gx:f gy:f z:f9", lambda s, d: density.kernel_density(daily(s, d), "mod", "obs", n=GRID),
        f"WITH {kde_ctes('site_daily', 'mod', 'obs', GRID)} SELECT * FROM grid",
    ),
    "e16_kernel_density_of_one_axis": Case(
        "ix:i iy:i gx:f gy:f z:f9", lambda s, d: density.kernel_density(_event_points(s, d), "value", "k", n=10, only="x", log="x"),
        f"""WITH {kde_ctes("(SELECT log10(value) AS lv, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE value > 0)", 'lv', 'k', 10)},
            flat AS (SELECT ix, sum(k) AS z FROM kx GROUP BY 1)
            SELECT ix, i AS iy, x0 + (ix - 1) * (x1 - x0) / 9 AS gx, y0 + (i - 1) * (y1 - y0) / 9 AS gy, z / (n * hx * hy) AS z FROM flat, g, s""",
    ),
    "e16_density_levels": Case(
        "ix:i iy:i gx:f gy:f z:f9 nlevel:f n_outside:i", _nlevel,
        f"""WITH {kde_ctes(POSITIVE, 'mod', 'obs', 100)} SELECT *, z / (SELECT max(z) FROM grid) AS nlevel,
            (SELECT count(*) FROM site_daily WHERE mod IS NOT NULL AND obs IS NOT NULL AND NOT (mod >= 0 AND obs >= 0)) AS n_outside FROM grid""",
    ),
    "l12_classes_of_pairs": Case(
        "pair:s density_class:i n:i", _pair_classes,
        f"""WITH {kde_ctes("(SELECT value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)", 'value', 'k', 20)},
            zr AS (SELECT min(z) AS z0, max(z) AS z1 FROM grid),
            pl AS (SELECT {_cell('x', 'x0', 'x1', 20)} AS ix, {_cell('y', 'y0', 'y1', 20)} AS iy FROM pts, s)
            SELECT 'value|k' AS pair, {_cell('z', 'z0', 'z1', 30)} AS density_class, count(*) AS n FROM pl JOIN grid USING (ix, iy), zr GROUP BY 2""",
    ),
    "l12_density_classes": Case(
        "sitename:s date:d mod:f obs:f ix:i iy:i z:f9 density_class:i", _classes,
        f"""WITH {kde_ctes('site_daily', 'mod', 'obs', GRID)},
            zr AS (SELECT min(z) AS z0, max(z) AS z1 FROM grid),
            pl AS (SELECT sitename, date, mod, obs, {_cell('x', 'x0', 'x1', GRID)} AS ix, {_cell('y', 'y0', 'y1', GRID)} AS iy FROM pts, s)
            SELECT pl.*, z, {_cell('z', 'z0', 'z1', 30)} AS density_class FROM pl JOIN grid USING (ix, iy), zr""",
    ),
}
