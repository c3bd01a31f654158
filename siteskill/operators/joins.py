"""Joins. None carries a broadcast hint: a dimension is broadcast only when its known size allows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; the right-hand keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def match_to_obs(mod: DataFrame, obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right outer join: every observation stays, with a null model value where there is none."""
    return mod.join(obs, list(keys), "right")


def attach_metadata(series: DataFrame, meta: DataFrame, columns: Sequence[str], key: str = "sitename") -> DataFrame:
    """Add site columns to every row of a series, by key. Sites without metadata keep nulls."""
    return series.join(meta.select(key, *columns), key, "left")


def keep_sites(df: DataFrame, sites: DataFrame, key: str = "sitename") -> DataFrame:
    """Rows whose site is in `sites`, null among them; the list stays a table and never goes through the driver."""
    return join_null_safe(df, sites.select(key), [key], "left_semi")


def drop_sites(df: DataFrame, sites: DataFrame, key: str = "sitename") -> DataFrame:
    return join_null_safe(df, sites.select(key), [key], "left_anti")
