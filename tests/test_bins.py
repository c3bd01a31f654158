import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteskill.functions import calendar as cal
from siteskill.operators import bins
from siteskill.operators.density import histogram, pretty_breaks

from .helpers import day

D = dt.date


def dates(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "date date")


def test_weeks_start_on_sunday(spark):
    got = [r[0] for r in dates(spark, D(2024, 6, 1), D(2024, 6, 2), D(2024, 6, 8)).select(cal.week_start("date")).collect()]
    assert got == [D(2024, 5, 26), D(2024, 6, 2), D(2024, 6, 2)]


def test_the_two_leap_rules_differ(spark):
    df = dates(spark, D(2024, 2, 29), D(2024, 12, 31), D(2023, 12, 31))
    got = [tuple(r) for r in df.select(cal.is_leap_day("date"), cal.is_day_366("date")).collect()]
    assert got == [(True, False), (False, True), (False, False)]


@pytest.mark.parametrize("include_last", [False, True])
def test_bins_are_left_closed(spark, include_last):
    breaks = spark.createDataFrame([(D(2000, 1, 1),), (D(2000, 1, 9),), (D(2000, 1, 17),)], "brk date")
    df = dates(spark, D(1999, 12, 31), D(2000, 1, 1), D(2000, 1, 8), D(2000, 1, 9), D(2000, 1, 16), D(2000, 1, 17), D(2000, 1, 18))
    want = [None, D(2000, 1, 1), D(2000, 1, 1), D(2000, 1, 9), D(2000, 1, 9), D(2000, 1, 9) if include_last else None, None]
    joined = {r["date"]: r["inbin"] for r in bins.assign_bins(df, breaks, include_last).collect()}
    regular = bins.regular_bin(F.col("date"), F.lit(D(2000, 1, 1)), 8, F.lit(D(2000, 1, 17)), include_last)
    assert [joined[r["date"]] for r in df.collect()] == want
    assert [r[0] for r in df.select(regular).collect()] == want


def test_irregular_breaks(spark):
    breaks = spark.createDataFrame([(D(2000, 1, 1),), (D(2000, 1, 2),), (D(2000, 3, 1),)], "brk date")
    got = {r["date"]: r["inbin"] for r in bins.assign_bins(dates(spark, D(2000, 1, 1), D(2000, 2, 29), D(2000, 3, 1)), breaks).collect()}
    assert got == {D(2000, 1, 1): D(2000, 1, 1), D(2000, 2, 29): D(2000, 1, 2), D(2000, 3, 1): None}


def test_break_tables(spark):
    df = dates(spark, *[day(i) for i in range(20)])
    assert [r[0] for r in bins.breaks_table(df, 8).orderBy("brk").collect()] == [day(0), day(8), day(16)]
    # January 1, 2000 is a Saturday: its week start is dropped as the first one
    assert [r[0] for r in bins.week_breaks(df).orderBy("brk").collect()] == [day(1), day(8), day(15)]


@pytest.mark.parametrize("before,after,nbins", [(20, 105, 10), (5, 10, 5), (3, 4, 6), (7, 1, 3)])
def test_offset_bins_equal_an_explicit_cut(spark, before, after, nbins):
    edges = np.arange(-before, after + 1e-9, (after + before + 1) / nbins)
    days = list(range(-before, after + 1))
    want = pd.cut(pd.Series(days), edges, labels=False)
    df = spark.createDataFrame([(d,) for d in days], "d int").orderBy("d")
    got = [r[0] for r in df.select(bins.offset_bin(F.col("d"), before, after, nbins)).collect()]
    assert got == [None if pd.isna(w) else int(w) + 1 for w in want]


def test_grid_cells_round_half_to_even(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 5.0, 10.0)], "v double")
    got = [r[0] for r in df.select(bins.grid_cell(F.col("v"), F.lit(0.0), F.lit(10.0), 10)).collect()]
    assert got == [1, 2, 2, 6, 10]


@pytest.mark.parametrize("low,high,n,want", [
    (0.0, 10.0, 5, (0.0, 2.0, 5)), (-1.3, 2.7, 20, (-1.4, 0.2, 21)), (0.0, 100.0, 50, (0.0, 2.0, 50)), (12.0, 87.0, 50, (12.0, 2.0, 38)),
    (0.01, 490.02, 20, (0.0, 20.0, 25)),
])
def test_pretty_breaks(low, high, n, want):
    first, width, count = pretty_breaks(low, high, n)
    assert (pytest.approx(want[0]), pytest.approx(want[1]), want[2]) == (first, width, count)
    assert first <= low and first + width * count >= high


def test_histogram_is_right_closed_and_counts_what_lies_outside(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0), (2.5, 30.0), (4.0, None), (10.0, 9.5)], "a double, b double")
    got = {(r["series"], r["bin"]): r for r in histogram(df, ["a", "b"], 5).collect()}
    assert [got["a", i]["n"] for i in range(1, 6)] == [2, 2, 0, 0, 1]
    assert [got["b", i]["n"] for i in range(1, 6)] == [2, 0, 0, 0, 1]
    assert got["a", 1]["n_outside"] == 0 and got["b", 1]["n_outside"] == 1
    assert got["b", 1]["density"] == pytest.approx(2 / (3 * 2.0))


@pytest.mark.parametrize("include_last", [False, True])
def test_breaks_of_any_spacing(spark, include_last):
    edges = [-3.0, 0.0, 0.5, 7.25, 100.0]
    values = [-3.1, -3.0, -1.0, 0.0, 0.49, 0.5, 7.25, 99.9, 100.0, 101.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for breaks in (edges, [], [1.0]):
        table = spark.createDataFrame([(e,) for e in [*breaks, None, *breaks]], "brk double")
        got = {r["v"]: r["inbin"] for r in bins.assign_breaks(df, "v", table, include_last).collect()}
        for v in values:
            inside = [] if v is None else [a for a, b in zip(breaks, breaks[1:]) if a <= v < b or (include_last and v == b == breaks[-1])]
            assert got[v] == (inside[-1] if inside else None), (v, breaks)
