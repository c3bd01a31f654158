"""Pearson, Spearman and Kendall correlation, exact for groups of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..session import stage
from .joins import join_null_safe
from .ranks import value_ranks
from .scan import number_chunk, running_totals

BLOCK_ROWS = 50_000
BLOCKS_PER_CHUNK = 10_000


def _signed_root(sxy: Column, sxx: Column, syy: Column) -> Column:
    return F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    moments = df.groupBy(*by).agg(*S.moment_columns(x, y))
    return moments.selectExpr(*by, f"{S.CORRELATION} AS cor", "n")


def _counted_pairs(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Distinct complete pairs and how often each occurs; written, as both axes are ranked from it."""
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = complete.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w"))
    return stage(counts, "counted_pairs")


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks among the complete pairs."""
    counted = pairs = _counted_pairs(df, by, x, y)
    for c in ("_x", "_y"):
        ranks = value_ranks(counted, by, c, "_w").select(*by, c, F.col("avg_rank").alias(f"{c}_rank"))
        pairs = join_null_safe(pairs, ranks, [*by, c])
    w, rx, ry = F.col("_w"), F.col("_x_rank"), F.col("_y_rank")
    sums = pairs.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * rx * ry).alias("xy"), F.sum(w * rx * rx).alias("xx"), F.sum(w * ry * ry).alias("yy")
    )
    n = F.col("n").cast("double")
    centre = n * (n + 1) * (n + 1) / 4  # the mean rank is (n + 1) / 2 on both axes
    return sums.select(
        *by, _signed_root(F.col("xy") - centre, F.col("xx") - centre, F.col("yy") - centre).alias("cor"), "n"
    )


def _block_scorer(by: Sequence[str], x: str, y: str):
    """Function of one block of counted pairs. It is self-contained, so workers need only numpy and pandas."""
    keys = list(by)

    def sign_sum(xs: np.ndarray, ys: np.ndarray, ws: np.ndarray) -> float:
        """Sum of w_i w_j sign(x_j - x_i) sign(y_j - y_i) over the pairs of the block.

        Sorted by (x, y), a pair that differs in y is told apart at the highest bit in which the
        ranks of its two y values differ. So per bit, within rows that share the higher bits,
        running weights count the pairs in order and out of order. Pairs with equal x came out as
        "in order"; they are taken off again.
        """
        order = np.lexsort((ys, xs))
        xs, ws = xs[order], ws[order].astype(float)
        rank = np.unique(ys[order], return_inverse=True)[1]
        total = 0.0
        for bit in range(int(rank.max()).bit_length()):
            same = np.argsort(rank >> (bit + 1), kind="stable")
            high = ((rank[same] >> bit) & 1).astype(bool)
            weight, group = ws[same], rank[same] >> (bit + 1)
            start = np.concatenate(([True], group[1:] != group[:-1]))
            first = np.maximum.accumulate(np.where(start, np.arange(len(group)), 0))
            for side, sign in ((high, 1.0), (~high, -1.0)):
                seen = np.concatenate(([0.0], np.cumsum(np.where(side, 0.0, weight))))
                total += sign * float(np.sum(np.where(side, weight * (seen[:-1] - seen[first]), 0.0)))
        tied = pd.DataFrame({"x": xs, "y": rank, "w": ws})
        same_xy = tied.groupby(["x", "y"])["w"].sum()
        same_x = tied.groupby("x")["w"].sum()
        return total - (float((same_x**2).sum()) - float((same_xy**2).sum())) / 2

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keys].iloc[:1].copy()
        out["s"] = [sign_sum(pdf[x].to_numpy(), pdf[y].to_numpy(), pdf["_w"].to_numpy())]
        return out

    return score


def _block_sums(pairs: DataFrame, by: Sequence[str], block: str, x: str, y: str) -> DataFrame:
    """Summed signs of the pairs inside each block; a block has a bounded number of rows."""
    keyed = pairs.select(*dict.fromkeys([*by, block, x, y, "_w"]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields if f.name in by]
    return keyed.groupBy(*by, block).applyInPandas(_block_scorer(by, x, y), ", ".join([*fields, "s double"]))


def kendall(df: DataFrame, by: Sequence[str], x: str, y: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Kendall's tau-b without comparing all pairs.

    Both axes are cut into blocks of about `block_rows` rows; a value held by more rows than that is
    a block of its own. A pair of points falls into one of three parts: same x block (counted inside
    that block), same y block only (counted inside that one, where the x block number stands for x),
    or different blocks on both axes (counted from the totals of those pairs of blocks that hold rows, see
    `_between_blocks`). A block of a single value adds nothing on its own axis and is skipped there.
    """
    counted = pairs = _counted_pairs(df, by, x, y)
    # Larger blocks for very many rows, so that their number per axis stays below the square root of the rows.
    size = max(block_rows, math.isqrt(counted.agg(F.sum("_w")).first()[0] or 0))
    parts = []
    for c in ("_x", "_y"):
        number = F.floor(F.col("before") / F.lit(size)) * 2 + (F.col("ties") > size).cast("int")
        ranks = value_ranks(counted, by, c, "_w").withColumn(f"{c}_block", number)
        ties = F.col("ties").cast("double")
        parts.append(ranks.groupBy(*by).agg(
            F.sum(ties * (ties - 1) / 2).alias(f"{c}_tied"), F.sum("ties").alias(f"{c}_n")
        ))
        pairs = join_null_safe(pairs, ranks.select(*by, c, f"{c}_block"), [*by, c])
    pairs = stage(pairs, "pairs")
    parts.append(_block_sums(pairs.where(F.col("_x_block") % 2 == 0), by, "_x_block", "_x", "_y"))
    parts.append(_block_sums(pairs.where(F.col("_y_block") % 2 == 0), by, "_y_block", "_x_block", "_y"))
    parts.append(_between_blocks(pairs, by))

    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    total = stacked.groupBy(*by).agg(
        F.sum("s").alias("s"), F.sum("_x_tied").alias("_x_tied"), F.sum("_y_tied").alias("_y_tied"), F.sum("_x_n").alias("n")
    )
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2
    return total.select(
        *by, _signed_root(F.col("s"), every - F.col("_x_tied"), every - F.col("_y_tied")).alias("cor"), "n"
    )


def _between_blocks(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Concordant minus discordant pairs that differ in both block numbers.

    Two different y blocks are told apart at the highest bit in which their numbers differ. So for each bit, cells that agree in
    all higher bits form a group; in order of x, those with the bit set come after as many cells without it in order, and
    the others after as many with it out of order. A cell that holds rows takes part once a bit, an empty one never; totals run along x
    by chunks, so no group is ordered in one task.
    """
    cells = stage(pairs.groupBy(*by, "_x_block", "_y_block").agg(F.sum("_w").cast("double").alias("_n")), "block_cells")
    bits = int(cells.agg(F.max("_y_block")).first()[0] or 0).bit_length()
    if not bits:
        return cells.groupBy(*by).agg(F.lit(0.0).alias("s"))
    plane = "k -> struct(k AS _bit, shiftright(_y_block, k + 1) AS _higher, shiftright(_y_block, k) % 2 = 1 AS _set)"
    planes = cells.select(*by, "_x_block", "_n", F.expr(f"inline(transform(sequence(0, {bits - 1}), {plane}))"))
    group = [*by, "_bit", "_higher"]
    columns = planes.groupBy(*group, "_x_block").agg(*[
        F.coalesce(F.sum(F.when(F.col("_set") == on, F.col("_n"))), F.lit(0.0)).alias(f"_{name}") for name, on in (("ones", True), ("zeros", False))])
    upto = running_totals(
        columns, group, "_x_block", {"_all_ones": F.col("_ones"), "_all_zeros": F.col("_zeros")}, number_chunk("_x_block", BLOCKS_PER_CHUNK), staged="block_planes")
    score = F.col("_ones") * (F.col("_all_zeros") - F.col("_zeros")) - F.col("_zeros") * (F.col("_all_ones") - F.col("_ones"))
    return upto.groupBy(*by).agg(F.sum(score).alias("s"))


def _rank_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman correlation of all pairs of columns, each column ranked once.

    The rank of a value among the complete rows of a pair depends on how many smaller values stand beside a known one of the other column.
    So every distinct value carries a count per other column, and running sums of all of them over the column give its ranks for
    all pairs at once. The rows meet them by one join per column, and one aggregate makes all pairs.
    """
    k = len(columns)
    named = df.select(*[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    tuples = stage(named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("_w")), "distinct_rows")
    beside = [F.when(F.col(f"_c{j}").isNotNull(), F.col("_w")).otherwise(0).alias(f"_k{j}") for j in range(k)]
    cells = F.array(*[F.struct(F.lit(i).alias("_column"), F.col(f"_c{i}").alias("_value")) for i in range(k)])
    long = tuples.select(*beside, F.inline(cells)).where(F.col("_value").isNotNull())
    counts = long.groupBy("_column", "_value").agg(*[F.sum(f"_k{j}").alias(f"_k{j}") for j in range(k)])
    placed = stage(counts.repartitionByRange("_column", "_value").withColumn("_part", F.spark_partition_id()), "matrix_values")
    upto = running_totals(placed, ["_column"], "_value", {f"_r{j}": F.col(f"_k{j}") for j in range(k)}, F.col("_part"))
    ranks = stage(upto.select("_column", "_value", *[(F.col(f"_r{j}") - (F.col(f"_k{j}") - 1) / 2).alias(f"_r{j}") for j in range(k)]), "matrix_ranks")
    rows = tuples
    for i in range(k):
        of = ranks.where(F.col("_column") == i).select(F.col("_value").alias(f"_v{i}"), F.array(*[f"_r{j}" for j in range(k)]).alias(f"_rank{i}"))
        rows = rows.join(of, F.col(f"_c{i}") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    pairs = list(combinations(range(k), 2))

    def sums(i: int, j: int) -> Column:
        w, x, y = F.when(F.col(f"_c{i}").isNotNull() & F.col(f"_c{j}").isNotNull(), F.col("_w")), F.col(f"_rank{i}")[j], F.col(f"_rank{j}")[i]
        return F.struct(F.coalesce(F.sum(w), F.lit(0)).alias("n"), F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))

    wide = rows.agg(*[sums(i, j).alias(f"_p{m}") for m, (i, j) in enumerate(pairs)])
    found = F.array(*[
        F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"_p{m}").alias("s")) for m, (i, j) in enumerate(pairs)])
    n = F.col("s.n").cast("double")
    centre = n * (n + 1) * (n + 1) / 4
    cor = _signed_root(F.col("s.xy") - centre, F.col("s.xx") - centre, F.col("s.yy") - centre)
    return wide.select(F.inline(found)).select("a", "b", cor.alias("cor"), F.col("s.n").alias("n"))


METHODS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def correlation(df: DataFrame, x: str, y: str, method: str = "spearman", by: Sequence[str] = (), digits: int | None = 2) -> DataFrame:
    """Correlation of the complete pairs; `digits` rounds it as shown in a title."""
    out = METHODS[method](df, list(by), x, y)
    return out if digits is None else out.withColumn("cor", F.round("cor", digits))


def correlation_matrix(
    df: DataFrame, columns: Sequence[str], method: str = "spearman", digits: int | None = 2, positive_only: bool = False
) -> DataFrame:
    """Correlation of every pair of columns over that pair's complete rows: `a, b, cor, n`.

    `positive_only` keeps rows in which all columns are positive (log axes).
    """
    if positive_only:
        for c in columns:
            df = df.where(F.col(c) > 0)
    pairs = list(combinations(columns, 2))
    if method == "pearson":
        # All pairs in one aggregate over one scan; nothing is exploded.
        wide = df.agg(*[
            F.struct(*S.moment_columns(a, b)).alias(f"_p{i}") for i, (a, b) in enumerate(pairs)
        ])
        cells = F.array(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_p{i}").alias("m")) for i, (a, b) in enumerate(pairs)
        ])
        flat = wide.select(F.explode(cells).alias("c")).select("c.a", "c.b", "c.m.*")
        out = flat.selectExpr("a", "b", f"{S.CORRELATION} AS cor", "n")
    elif method == "spearman":
        out = _rank_matrix(df, columns)
    else:
        cells = F.array(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("u"), F.col(b).cast("double").alias("v"))
            for a, b in pairs
        ])
        long = df.select(F.explode(cells).alias("c")).select("c.*")
        out = METHODS[method](long, ["a", "b"], "u", "v")
    return out if digits is None else out.withColumn("cor", F.round("cor", digits))
