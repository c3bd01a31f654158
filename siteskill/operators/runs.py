"""Runs of a condition in an ordered series: detection, deficit and merging across short gaps."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.nulls import strict_sum
from ..session import stage
from .scan import nearest_known, number_chunk, running_totals

RUNS_PER_CHUNK_SPAN = 100_000


def index_series(
    df: DataFrame, flag: str, keys: Sequence[str] = ("site",), order: str = "date", chunk: Column | None = None,
    staged: str | None = None, keep_chunk: bool = False,
) -> DataFrame:
    """Add the row number `rn` and the number `tn` of rows so far that meet the condition."""
    held = F.coalesce(F.col(flag), F.lit(False))
    return running_totals(df, keys, order, {"rn": F.lit(1), "tn": held.cast("int")}, chunk, staged, keep_chunk)


def runs_of_indexed(
    indexed: DataFrame, flag: str, min_len: int, keys: Sequence[str] = ("site",), order: str = "date",
    deficit: str | None = None,
) -> DataFrame:
    """Runs from a series that already has `rn` and `tn`: `rn - tn` is the same within a run."""
    extra = [strict_sum(deficit).alias("deficit")] if deficit else []
    return (
        indexed.where(F.coalesce(F.col(flag), F.lit(False)))
        .groupBy(*keys, (F.col("rn") - F.col("tn")).alias("_island"))
        .agg(F.min("rn").alias("start_rn"), F.count(F.lit(1)).alias("len"), F.min(order).alias("start"), *extra)
        .where(F.col("len") >= min_len)
        .drop("_island")
    )


def number_runs(runs: DataFrame, keys: Sequence[str] = ("site",), name: str = "run_id") -> DataFrame:
    """Number the runs of each series from 1, in order."""
    return running_totals(runs, keys, "start_rn", {name: F.lit(1)}, number_chunk("start_rn", RUNS_PER_CHUNK_SPAN))


def find_runs(
    df: DataFrame, flag: str, min_len: int, keys: Sequence[str] = ("site",), order: str = "date",
    deficit: str | None = None, chunk: Column | None = None,
) -> DataFrame:
    """Runs of at least `min_len` rows that meet the condition; a null flag does not.

    Columns: keys, `run_id`, `start_rn`, `len`, `start` (value of the order column) and, if a column
    is named for it, `deficit`: its strict sum over the run.
    """
    runs = runs_of_indexed(index_series(df, flag, keys, order, chunk), flag, min_len, keys, order, deficit)
    return number_runs(runs, keys)


def running_length(
    df: DataFrame, flag: str, keys: Sequence[str] = ("site",), order: str = "date", chunk: Column | None = None
) -> DataFrame:
    """Add `run_len`: how many rows in a row, up to this one, meet the condition."""
    indexed = index_series(df, flag, keys, order, chunk, keep_chunk=True)
    broken = F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col("rn"))
    seen = nearest_known(indexed, keys, order, {"broken": (broken, broken)}, chunk)
    return seen.select(*df.columns, (F.col("rn") - F.coalesce(F.col("broken_before.p"), F.lit(0))).alias("run_len"))


def settled(runs: list[list]) -> list[list]:
    """The fixed point of joining neighbours of one series. A run is [start, length, first value, deficit], in order of start.

    One pass with a stack: a later run can only touch the last one so far, so a pair below it is settled.
    """
    stack: list[list] = []
    for run in runs:
        stack.append(list(run))
        while len(stack) > 1:
            (a, n, _, x), (b, m, _, y) = stack[-2:]
            if b - (a + n) >= min(n, m):
                break
            stack.pop()
            stack[-1][1] = b + m - a
            stack[-1][3] = None if x is None or y is None else x + y
    return stack


def open_ends(runs: list[list]) -> tuple[list[list], list[list]]:
    """Split the settled runs of a chunk into those that runs of other chunks may still reach, and the rest.

    A run shorter than or as long as the gaps on both sides never joins, whatever its neighbours grow to, since
    gaps do not change. So nothing between the first and the last such run can change. On either side of them lengths
    rise and then fall, the gaps between with them: open runs of a chunk grow with the square root of its rows at most.
    """
    gap = lambda i: runs[i + 1][0] - (runs[i][0] + runs[i][1])
    stuck = [i for i in range(1, len(runs) - 1) if runs[i][1] <= min(gap(i - 1), gap(i))]
    if len(stuck) < 2:
        return runs, []
    return runs[: stuck[0] + 1] + runs[stuck[-1] :], runs[stuck[0] + 1 : stuck[-1]]


def merge_runs(runs: DataFrame, keys: Sequence[str] = ("site",), chunk: Column | None = None) -> DataFrame:
    """Join neighbouring runs whose gap is shorter than both, until no such pair is left.

    Joining only makes runs longer, so a pair that may be joined stays so whatever else is joined, and the end result
    does not depend on the order. Chunks of the series (by `start_rn`) are therefore settled on their own and give up only their
    open ends; the open ends of a series are settled in a second step. Two shuffles, whatever the gaps are.
    """
    with_deficit = "deficit" in runs.columns
    columns = [*keys, "start_rn", "len", "start", *(["deficit"] if with_deficit else [])]
    part = number_chunk("start_rn", RUNS_PER_CHUNK_SPAN) if chunk is None else chunk
    cut = runs.select(*columns, part.alias("_part"))
    schema = StructType([f for f in cut.schema if f.name in columns]).add("_open", "boolean")
    values = columns[len(keys) :]

    def rows(table: pa.Table) -> list[list]:
        table = table.sort_by("start_rn")
        return [[*r, *([] if with_deficit else [0])] for r in zip(*[table.column(c).to_pylist() for c in values])]

    def told(table: pa.Table, found: list[list], waiting: int) -> pa.Table:
        types = {c: table.schema.field(c).type for c in columns}
        own = [pa.array([table.column(k)[0].as_py()] * len(found), types[k]) for k in keys]
        rest = [pa.array([r[i] for r in found], types[c]) for i, c in enumerate(values)]
        return pa.Table.from_arrays([*own, *rest, pa.array([i < waiting for i in range(len(found))])], names=[*columns, "_open"])

    def inside(table: pa.Table) -> pa.Table:
        reachable, rest = open_ends(settled(rows(table)))
        return told(table, reachable + rest, len(reachable))

    def across(table: pa.Table) -> pa.Table:
        return told(table, settled(rows(table)), 0)

    chunks = stage(cut.groupBy(*keys, "_part").applyInArrow(inside, schema), "runs")
    ends = chunks.where("_open").groupBy(*keys).applyInArrow(across, schema)
    return number_runs(chunks.where("NOT _open").unionByName(ends).drop("_open"), keys)
