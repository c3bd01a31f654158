"""Ordered operators against plain loops: scans, interpolation, runs, merging, quantiles, ranks."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteskill.operators.gaps import interpolate, interpolate_cycle
from siteskill.operators.quantiles import median_and_terciles, quantiles, summaries
from siteskill.operators.ranks import value_ranks
from siteskill.operators.runs import find_runs, index_series, merge_runs, running_length
from siteskill.operators.scan import number_chunk, running_totals

from .helpers import close, day


def lerp_loop(values, positions):
    known = [(p, v) for p, v in zip(positions, values) if v is not None]
    if len(known) < 2:
        return [None] * len(values)
    out = []
    for p, v in zip(positions, values):
        before = [k for k in known if k[0] <= p]
        after = [k for k in known if k[0] >= p]
        if v is not None:
            out.append(v)
        elif before and after:
            (p0, v0), (p1, v1) = before[-1], after[0]
            out.append(v0 + (v1 - v0) * (p - p0) / (p1 - p0))
        else:
            out.append(None)
    return out


@pytest.fixture(scope="module")
def series():
    rng = random.Random(5)
    out = {}
    for s in range(12):
        n, share = rng.randint(1, 60), rng.random()
        at = sorted(rng.sample(range(900), n))  # gaps in the calendar, several years
        out[f"s{s:02d}"] = [(i, rng.random() if rng.random() < share else None) for i in at]
    out["alone"] = [(0, None), (5, 2.0), (9, None)]
    return out


def test_interpolation_across_years(spark, series):
    df = spark.createDataFrame([(s, day(i), v) for s, pts in series.items() for i, v in pts], "site string, date date, v double")
    got = interpolate(df, ["site"], "date", ["v"], suffix="_f").toPandas().sort_values(["site", "date"])
    for s, pts in series.items():
        want = lerp_loop([v for _, v in pts], range(len(pts)))
        have = [None if pd.isna(x) else x for x in got[got.site == s]["v_f"]]
        assert all(close(a, b) for a, b in zip(have, want)) and len(have) == len(want), s


def test_interpolation_of_a_cycle_by_row_and_by_key(spark, series):
    df = spark.createDataFrame([(s, i, v) for s, pts in series.items() for i, v in pts], "site string, doy int, v double")
    for by in ("row", "key"):
        got = interpolate_cycle(df, ["site"], "doy", ["v"], by=by).toPandas().sort_values(["site", "doy"])
        chunked = interpolate(df, ["site"], "doy", ["v"], by=by, chunk=number_chunk("doy", 50)).toPandas().sort_values(["site", "doy"])
        for s, pts in series.items():
            want = lerp_loop([v for _, v in pts], range(len(pts)) if by == "row" else [i for i, _ in pts])
            for frame in (got, chunked):
                have = [None if pd.isna(x) else x for x in frame[frame.site == s]["v"]]
                assert all(close(a, b) for a, b in zip(have, want)), (s, by)


def test_running_totals(spark, series):
    df = spark.createDataFrame([(s, day(i), float(i)) for s, pts in series.items() for i, _ in pts], "site string, date date, v double")
    got = running_totals(df, ["site"], "date", {"rn": F.lit(1), "sum": F.col("v")}).toPandas().sort_values(["site", "date"])
    for s, g in got.groupby("site"):
        assert list(g.rn) == list(range(1, len(g) + 1))
        assert np.allclose(g["sum"], np.cumsum(g.v))


def runs_loop(flags, min_len):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            if i - start >= min_len:
                out.append((start + 1, i - start))
            start = None
    return out


def merge_loop(runs):
    runs = list(runs)
    changed = True
    while changed:
        changed = False
        for i in range(len(runs) - 1):
            (s0, n0), (s1, n1) = runs[i], runs[i + 1]
            if s1 - s0 - n0 < min(n0, n1):
                runs[i:i + 2] = [(s0, s1 + n1 - s0)]
                changed = True
                break
    return runs


def test_a_scan_exchanges_its_series_once(spark, capsys):
    """Window and join share an exchange and a sort, null keys or not; only the chunk table is shuffled for the join."""
    df = spark.createDataFrame([("a", day(0), True, 1.0), (None, None, None, None)], "site string, date date, hot boolean, v double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index_series(df, "hot").explain()
        once = capsys.readouterr().out
        interpolate(df, ["site"], "date", ["v"]).explain()
        both = capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    join = once[once.index("SortMergeJoin") :].splitlines()
    assert once.count("Exchange") == 4 and once.count("SortMergeJoin") == 1  # the series, chunk totals twice, offsets
    assert "isnull" not in join[0], join[0]
    top = both[: both.index("_total__position")]  # rows numbered, then their neighbours: still one exchange on this side
    assert top.count("Exchange hashpartitioning(_chunk") <= 2 and "isnull(_chunk" not in both


@pytest.fixture(scope="module")
def flagged():
    rng = random.Random(11)
    out = {f"s{s:02d}": [rng.choices([True, False, None], [p, 1 - p, 0.05])[0] for _ in range(rng.randint(1, 800))]
           for s, p in enumerate(np.linspace(0.2, 0.95, 12))}
    out["one_run"] = [False, True, True, True, False]
    out["to_the_end"] = [False] * 5 + [True] * 3
    out["from_the_start"] = [True] * 3 + [False] * 400
    out["all"] = [True] * 800
    out["over_new_year"] = [False] * 360 + [True] * 12 + [False] * 20
    return out


def flag_frame(spark, flagged):
    rows = [(s, day(i), f, float(i)) for s, fs in flagged.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "site string, date date, hot boolean, v double")


def test_runs_deficit_and_numbers(spark, flagged):
    got = find_runs(flag_frame(spark, flagged), "hot", 3, deficit="v").toPandas().sort_values(["site", "start_rn"])
    for s, fs in flagged.items():
        want = runs_loop(fs, 3)
        mine = got[got.site == s]
        assert list(zip(mine.start_rn, mine.len)) == want, s
        assert list(mine.run_id) == list(range(1, len(want) + 1))
        assert list(mine.start) == [day(a - 1) for a, _ in want]
        assert np.allclose(mine.deficit.astype(float), [sum(range(a - 1, a - 1 + n)) for a, n in want])


def test_a_null_makes_the_deficit_null(spark):
    df = spark.createDataFrame([("a", day(0), True, 1.0), ("a", day(1), True, None)], "site string, date date, hot boolean, v double")
    assert find_runs(df, "hot", 1, deficit="v").first()["deficit"] is None


def test_running_length(spark, flagged):
    got = running_length(flag_frame(spark, flagged), "hot").toPandas().sort_values(["site", "date"])
    for s, fs in flagged.items():
        want, n = [], 0
        for f in fs:
            n = n + 1 if f else 0
            want.append(n)
        assert list(got[got.site == s].run_len) == want


@pytest.mark.parametrize("size", [7, 40, 100_000])
def test_merged_runs_reach_the_fixed_point(spark, flagged, size):
    found = find_runs(flag_frame(spark, flagged), "hot", 2)
    merged = merge_runs(found, chunk=number_chunk("start_rn", size)).toPandas().sort_values(["site", "start_rn"])
    for s, fs in flagged.items():
        mine = merged[merged.site == s]
        assert list(zip(mine.start_rn, mine.len)) == merge_loop(runs_loop(fs, 2)), s


def test_a_chain_of_merges_needs_several_rounds(spark):
    fs, n = [True], 1
    for _ in range(7):  # each gap is shorter than both sides only once the left side has grown
        fs += [False] * (n - 1 or 1) + [True] * max(n, 2)
        n = len(fs)
    df = flag_frame(spark, {"chain": fs, "triple": [True] * 4 + [False] + [True] * 4 + [False] + [True] * 4 + [False] * 9 + [True] * 2})
    got = merge_runs(find_runs(df, "hot", 1)).toPandas().sort_values(["site", "start_rn"])
    for s, flags in {"chain": fs, "triple": [True] * 4 + [False] + [True] * 4 + [False] + [True] * 4 + [False] * 9 + [True] * 2}.items():
        mine = got[got.site == s]
        assert list(zip(mine.start_rn, mine.len)) == merge_loop(runs_loop(flags, 1))


@pytest.mark.parametrize("accuracy", [50, 400, 50_000])
def test_exact_quantiles_with_a_hot_group(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = np.where(rng.random(20_000) < 0.4, "hot", rng.integers(0, 300, 20_000).astype(str))
    values = np.round(np.exp(rng.normal(0, 3, 20_000)), 2)  # many ties, a long tail
    pdf = pd.DataFrame({"g": groups, "v": values, "u": rng.random(20_000)})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("u") > 0.05, F.col("v")))
    wanted = {"lo": ("v", 0.0), "q33": ("v", 0.33), "med": ("v", 0.5), "q66": ("u", 0.66), "top": ("v", 0.9999), "hi": ("u", 1.0)}
    got = quantiles(df, ["g"], wanted, accuracy=accuracy).toPandas().set_index("g")
    pdf["v"] = pdf.v.where(pdf.u > 0.05)
    for name, (c, p) in wanted.items():
        want = pdf.groupby("g")[c].quantile(p)
        assert np.allclose(got[name].astype(float).reindex(want.index), want, equal_nan=True), name


def test_quantiles_of_empty_and_null_groups(spark):
    df = spark.createDataFrame([("a", None), (None, 2.0), (None, 4.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in quantiles(df, ["g"], {"m": ("v", 0.5)}).collect()}
    assert got == {"a": None, None: 3.0}


def test_names_of_median_and_terciles():
    assert list(median_and_terciles(["x"])) == ["median", "q33", "q66"]
    assert list(median_and_terciles(["x", "y"])) == ["x_median", "y_median", "x_q33", "y_q33", "x_q66", "y_q66"]


def test_value_ranks(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 3000, p=[0.8, 0.2]), "v": rng.integers(0, 400, 3000).astype(float)})
    got = value_ranks(spark.createDataFrame(pdf), ["g"], "v").toPandas()
    pdf["rank"] = pdf.groupby("g").v.rank()
    want = pdf.drop_duplicates(["g", "v"]).merge(got, on=["g", "v"])
    assert len(want) == len(got) and np.allclose(want["rank"], want.avg_rank)


def test_summaries_by_name(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "x": rng.normal(size=400), "y": rng.normal(size=400)})
    df = spark.createDataFrame(pdf)
    got = summaries(df, ["g"], ["x", "y"], ["median", "mean", "n", "q66"]).toPandas().set_index("g").sort_index()
    assert list(got.columns) == [f"{v}_{n}" for n in ("median", "mean", "n", "q66") for v in ("x", "y")]
    for g, d in pdf.groupby("g"):
        assert close(got.loc[g, "x_median"], d.x.median()) and close(got.loc[g, "y_q66"], d.y.quantile(0.66)) and got.loc[g, "y_n"] == len(d)
    own = summaries(df, [], ["x"], ["top", "half"], {"top": F.max, "half": 0.5}).first()
    assert close(own["top"], pdf.x.max()) and close(own["half"], pdf.x.median())
    with pytest.raises(ValueError, match="median"):
        summaries(df, [], ["x"], ["mode"])
