import random
from statistics import median

import numpy as np
import pytest

from siteskill.plans.events import align_events, event_response

from .helpers import close, day
from .test_order import runs_loop

BEFORE, AFTER, MIN_LEN, NBINS = 4, 9, 3, 5


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    data = {}
    for s in range(8):
        p = rng.uniform(0.3, 0.8)
        data[f"s{s}"] = [(rng.random(), rng.choices([True, False, None], [p, 1 - p, 0.05])[0]) for _ in range(rng.randint(3, 420))]
    return data


def windows_loop(data):
    out = []
    for s, rows in data.items():
        for inst, (start, n) in enumerate(runs_loop([f for _, f in rows], MIN_LEN), 1):
            tail = min(AFTER, n)
            if start - BEFORE >= 1 and start + tail <= len(rows):
                out += [(s, inst, d, rows[start + d - 1][0]) for d in range(-BEFORE, tail + 1)]
    return sorted(out)


def frames(spark, data):
    rows = [(s, day(i), v, f) for s, pts in data.items() for i, (v, f) in enumerate(pts)]
    df = spark.createDataFrame(rows, "site string, date date, x double, isevent boolean")
    return df.select("site", "date", "x"), df.where("isevent IS NOT NULL").select("site", "date", "isevent")


def test_aligned_rows_and_aggregate(spark, rows, case):
    out = align_events(*frames(spark, case), ["x"], MIN_LEN, BEFORE, AFTER)
    want = windows_loop(case)
    assert rows(out.rows, "site", "inst", "dday", "x") == want
    for r in out.by_day.collect():
        values = [v for _, _, d, v in want if d == r["dday"]]
        assert close(r["median"], median(values)) and close(r["q33"], float(np.quantile(values, 0.33)))


def test_normalised_rows(spark, rows, case):
    out = align_events(*frames(spark, case), ["x"], MIN_LEN, BEFORE, AFTER, do_norm=True, nbins=NBINS)
    want = windows_loop(case)
    width = (BEFORE + AFTER + 1) / NBINS
    edges = np.arange(-BEFORE, AFTER + 1e-9, width)
    norm = median([v for _, _, d, v in want if edges[1] < d <= edges[2]])
    got = rows(out.rows, "site", "inst", "dday", "x")
    assert all(a[:3] == b[:3] and close(a[3], b[3] - norm) for a, b in zip(got, want)) and len(got) == len(want)


def test_one_event_is_enough(spark):
    df = spark.createDataFrame([("a", day(i), float(i), 0.0) for i in range(12)], "site string, date date, mod double, obs double")
    flags = spark.createDataFrame([("a", day(i), True) for i in (5, 6, 7)], "site string, date date, isevent boolean")
    got = {r["dday"]: r["median"] for r in event_response(df, flags, 3, 2, 9).collect()}
    assert got == {d: 5.0 + d for d in range(-2, 4)}


def test_events_do_not_cross_sites(spark, rows):
    df = spark.createDataFrame([(s, day(i), 1.0) for s in "ab" for i in range(6)], "site string, date date, x double")
    flags = spark.createDataFrame([("a", day(4), True), ("a", day(5), True), ("b", day(0), True)], "site string, date date, isevent boolean")
    assert align_events(df, flags, ["x"], 3, 0, 2).rows.count() == 0
