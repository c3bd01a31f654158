"""Every registered query against its SQL in DuckDB, over whole tables."""

import os
import re

import pytest

import __spark_entry__ as entry_points
from siteskill.catalog import all_cases
from siteskill.catalog.check import compare, oracle_connection
from siteskill.operators.gaps import interpolate
from siteskill.operators.runs import find_runs
from siteskill.operators.scan import number_chunk

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF_DIR)


def physical_plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", list(all_cases()))
def test_query_equals_its_sql(spark, duck, capsys, name):
    case = all_cases()[name]
    frame = case.frame(spark, SF_DIR)
    plan = physical_plan(frame, capsys)
    assert not [bad for bad in ("CartesianProduct", "NestedLoopJoin", "SortAggregate", "BatchEvalPython") if bad in plan]
    out = compare(duck, case, frame)
    assert out.startswith(("ok", "rows")), out


def test_long_series_are_windowed_by_chunk(spark, capsys):
    """No window over series rows is partitioned by the site alone."""
    df = spark.read.parquet(f"{SF_DIR}/events.parquet").selectExpr(
        "event_type AS site", "cast(ts AS date) AS date", "event_id", "value", "value > 20 AS hot")
    plans = physical_plan(find_runs(df, "hot", 2, order="event_id", chunk=number_chunk("event_id")), capsys)
    plans += physical_plan(interpolate(df, ["site"], "event_id", ["value"], chunk=number_chunk("event_id")), capsys)
    by_order = re.findall(r"windowspecdefinition\(([^\n]*?event_id#\d+L? (?:ASC|DESC))", plans)
    assert by_order and all("_chunk" in w for w in by_order)


def test_entry_points(spark):
    assert entry_points.entry(spark).count() == 10
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
