"""Site-level folds for cross-validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import drop_sites, join_null_safe, keep_sites
from .quantiles import quantiles
from .scan import running_totals


def _strata(sites: DataFrame, columns: Sequence[str], levels: int) -> list[Column]:
    """Quantile class 0..levels-1 of each stratum column; cut points from one exact pass."""
    wanted = {f"{c}_{i}": (c, i / levels) for c in columns for i in range(1, levels)}
    cuts = quantiles(sites, [], wanted).first()
    out = []
    for c in columns:
        edges = [cuts[f"{c}_{i}"] for i in range(1, levels)]
        above = [(F.col(c) > F.lit(e)).cast("int") for e in edges if e is not None]
        out.append(F.coalesce(sum(above, F.lit(0)), F.lit(-1)))
    return out


def fold_split(
    sites: DataFrame, k: int = 5, strata: Sequence[str] = (), levels: int = 3, seed: str = "1982", key: str = "sitename"
) -> DataFrame:
    """`(site, fold)` with folds 1..k of nearly equal size, also within each stratum.

    Sites are put into a fixed pseudo-random order (a hash of the name) and dealt out in turn, so
    every row of a site is in the same fold and a rerun gives the same split.
    """
    shuffled = F.md5(F.concat(F.col(key), F.lit(seed)))
    classes = _strata(sites, strata, levels) if strata else []
    label = F.concat_ws("|", *[c.cast("string") for c in classes]) if classes else F.lit("")
    dealt = sites.select(key, label.alias("stratum"), shuffled.alias("_hash"))
    order = running_totals(dealt, ["stratum"], "_hash", {"_turn": F.lit(1)}, F.substring("_hash", 1, 3))
    return order.select(key, "stratum", ((F.col("_turn") - 1) % k + 1).cast("int").alias("fold"))


def test_rows(df: DataFrame, folds: DataFrame, fold: int, key: str = "sitename") -> DataFrame:
    return keep_sites(df, folds.where(F.col("fold") == fold), key)


def train_rows(df: DataFrame, folds: DataFrame, fold: int, key: str = "sitename") -> DataFrame:
    return drop_sites(df, folds.where(F.col("fold") == fold), key)


def training_sets(df: DataFrame, folds: DataFrame, k: int = 5, key: str = "sitename") -> DataFrame:
    """All k training sets in one table: each row once per fold it trains, with the `fold` column."""
    every = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold")
    own = folds.select(key, F.col("fold").alias("_own"))
    return join_null_safe(df, own, [key]).select(*df.columns, "_own", every).where(F.col("fold") != F.col("_own")).drop("_own")
