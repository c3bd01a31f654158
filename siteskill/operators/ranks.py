"""Exact ranks of groups of any size, from one range-partitioned sort.

Values are first counted (so ties take one row), then range-partitioned by (group, value) and
written. In the written table the partition number of a value is fixed, whatever happens to the
executors later, and rises with the value. Counts per partition give the offset of each partition,
and a window inside a partition does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .joins import join_null_safe


def value_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per distinct non-null value of each group. A row counts once, or `weight` times.

    Columns: the keys, `value`, `ties` (rows with this value), `before` (rows with a smaller value)
    and `avg_rank` (ranks from 1, ties share their mean rank).
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(rows.alias("ties"))
    placed = stage(
        counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), f"ranks_{value}"
    )
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "_part")
        .agg(F.sum("ties").alias("_total"))
        .select(*by, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    upto = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_offset") + F.sum("ties").over(upto) - F.col("ties")
    return (
        join_null_safe(placed, offsets, [*by, "_part"])
        .withColumn("before", before)
        .select(*by, value, "ties", "before", (F.col("before") + (F.col("ties") + 1) / 2).alias("avg_rank"))
    )
