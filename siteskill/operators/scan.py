"""Ordered scans over long series: running totals and the nearest known value.

A window over a whole series would put that series into one task. Here a series is cut into chunks
along its order (calendar years, by default). Windows run inside a chunk, a table with one row per
chunk carries totals and boundary values from chunk to chunk, and a join on (keys, chunk) puts both
together. The result is exact, and no task holds more than a chunk. A null key is a group like any
other, and a null order value comes first.

Keys and chunk travel as one struct, which is never null: windows are partitioned by it and joins compare it
as it is, so both are served by the same exchange of the series. Only the table of chunks is shuffled for a
join, if it is not small enough to be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: A struct of the keys and `_part`, the chunk of a row. Functions that find it in their input go on with it.
CHUNK = "_chunk"


def year_chunk(order: str) -> Column:
    return F.year(order)


def number_chunk(order: str, size: int = 100_000) -> Column:
    """Chunks of `size` consecutive numbers of an integer order column."""
    return F.floor(F.col(order) / F.lit(size))


def _cut(df: DataFrame, keys: Sequence[str], order: str, chunk: Column | None, more: Mapping[str, Column]) -> DataFrame:
    """Rows with `CHUNK` in place of the keys, and the columns of `more`."""
    part = year_chunk(order) if chunk is None else chunk
    place = F.col(CHUNK) if CHUNK in df.columns else F.struct(*keys, part.alias("_part"))
    others = [c for c in df.columns if c not in (*keys, CHUNK)]
    return df.select(place.alias(CHUNK), *others, *[c.alias(name) for name, c in more.items()])


def _whole(columns: Sequence[str], keys: Sequence[str], keep: bool) -> list[Column]:
    """The given columns with the keys taken out of `CHUNK` again."""
    kept = [F.col(CHUNK).getField(c).alias(c) if c in keys else F.col(c) for c in columns if c != CHUNK]
    return [*kept, F.col(CHUNK)] if keep else kept


def _inside(order: str | Column):
    return Window.partitionBy(CHUNK).orderBy(order)


def _across(keys: Sequence[str], descending: bool = False):
    part = F.col(CHUNK).getField("_part")
    whole = Window.partitionBy(*[F.col(CHUNK).getField(k) for k in keys])
    return whole.orderBy(part.desc() if descending else part).rowsBetween(Window.unboundedPreceding, -1)


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, measures: Mapping[str, Column], chunk: Column | None = None,
    staged: str | None = None, keep_chunk: bool = False,
) -> DataFrame:
    """Add, per measure, its total over the rows of the group up to and including this one.

    With the measure 1 this is the row number. (keys, order) must identify a row. Chunk totals and
    rows both read `df`. Where `df` is costly, name a table in `staged`: rows are then written once,
    with the totals inside their chunk, and both read that table. With `keep_chunk` the column `CHUNK` stays, for
    another scan by the same keys and chunks.
    """
    cut = _cut(df, keys, order, chunk, {f"_measure_{name}": m for name, m in measures.items()})
    upto = _inside(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"_local_{name}": F.sum(f"_measure_{name}").over(upto) for name in measures})
    if staged:
        local = cut = stage(local, staged)
    totals = cut.groupBy(CHUNK).agg(*[F.sum(f"_measure_{name}").alias(f"_total_{name}") for name in measures])
    offsets = totals.select(CHUNK, *[
        F.coalesce(F.sum(f"_total_{name}").over(_across(keys)), F.lit(0)).alias(f"_offset_{name}") for name in measures
    ])
    return local.join(offsets, CHUNK).select(
        *_whole(df.columns, keys, keep_chunk), *[F.expr(f"_local_{name} + _offset_{name} AS {name}") for name in measures]
    )


def nearest_known(
    df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, tuple[Column, Column]],
    chunk: Column | None = None, include_self: bool = True,
) -> DataFrame:
    """Add the last known and the next known (position, value) of each name, and how many there are.

    A position rises with `order` and is null where nothing is known. For a name `v` the new columns
    are the structs `v_before` and `v_after` with fields `p` and `v`, and the number `v_known`.

    The next value is the last one seen on the way back: a frame that runs forward to the end would
    be summed up anew for every row.
    """
    columns = {k: c for name, (p, v) in values.items() for k, c in ((f"_p_{name}", p), (f"_v_{name}", v))}
    cut = _cut(df, keys, order, chunk, columns)
    edge = 0 if include_self else -1
    start = Window.unboundedPreceding
    forward = _inside(order).rowsBetween(start, edge)
    backward = _inside(F.col(order).desc()).rowsBetween(start, edge)
    earlier, later = _across(keys), _across(keys, descending=True)
    whole = Window.partitionBy(*[F.col(CHUNK).getField(k) for k in keys])

    # Plain columns in this aggregate, not structs: it then hashes instead of sorting its input.
    per_chunk = cut.groupBy(CHUNK).agg(*[
        F.expr(e) for name in values for e in (
            f"max(_p_{name}) AS _lastp_{name}", f"max_by(_v_{name}, _p_{name}) AS _lastv_{name}",
            f"min(_p_{name}) AS _firstp_{name}", f"min_by(_v_{name}, _p_{name}) AS _firstv_{name}",
            f"count(_p_{name}) AS _count_{name}",
        )
    ])

    def known(position: str, value: str) -> Column:
        return F.expr(f"CASE WHEN {position} IS NOT NULL THEN struct({position} AS p, {value} AS v) END")

    carried = per_chunk.select(CHUNK, *[
        c for name in values for c in (
            F.last(known(f"_lastp_{name}", f"_lastv_{name}"), ignorenulls=True).over(earlier).alias(f"_earlier_{name}"),
            F.last(known(f"_firstp_{name}", f"_firstv_{name}"), ignorenulls=True).over(later).alias(f"_later_{name}"),
            F.sum(f"_count_{name}").over(whole).alias(f"{name}_known"),
        )
    ])
    local = cut.withColumns({
        k: c for name in values for k, c in (
            (f"_prev_{name}", F.last(known(f"_p_{name}", f"_v_{name}"), ignorenulls=True).over(forward)),
            (f"_next_{name}", F.last(known(f"_p_{name}", f"_v_{name}"), ignorenulls=True).over(backward)),
        )
    })
    return local.join(carried, CHUNK).select(*_whole(df.columns, keys, False), *[
        F.expr(e) for name in values for e in (
            f"coalesce(_prev_{name}, _earlier_{name}) AS {name}_before",
            f"coalesce(_next_{name}, _later_{name}) AS {name}_after",
            f"{name}_known",
        )
    ])
