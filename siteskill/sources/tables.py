"""Scans and sinks. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import nan_to_null

SITE_INFO_SCHEMA = T.StructType([
    T.StructField("sitename", T.StringType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("elv", T.DoubleType()),
    T.StructField("whc", T.DoubleType()),
    T.StructField("koeppen_code", T.StringType()),
    T.StructField("igbp_land_use", T.StringType()),
])

SITE_YEARS_SCHEMA = T.StructType([
    T.StructField("sitename", T.StringType()),
    T.StructField("drop_gpp", T.BooleanType()),
    T.StructField("drop_le", T.BooleanType()),
    T.StructField("year_start_gpp", T.IntegerType()),
    T.StructField("year_end_gpp", T.IntegerType()),
    T.StructField("year_start_le", T.IntegerType()),
    T.StructField("year_end_le", T.IntegerType()),
])

EVENT_FLAGS_SCHEMA = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("isevent", T.BooleanType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("doy", T.IntegerType()),
    T.StructField("cluster", T.StringType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; `NA` and empty fields are null."""
    read = spark.read.schema(schema).option("header", True).option("nullValue", "NA").option("emptyValue", "NA")
    return nan_to_null(read.csv(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Save a table; with `columns` the light form, of which nothing else is computed."""
    (df.select(*columns) if columns else df).write.mode("overwrite").parquet(path)


def write_by_fold(df: DataFrame, path: str, fold: str = "fold") -> None:
    """One folder per fold. Folds that `df` has replace those of the same name; others stay as they are.

    So a rerun of one fold rewrites that fold alone.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(fold).parquet(path)


def read_fold(spark: SparkSession, path: str, value: object, fold: str = "fold") -> DataFrame:
    """The rows of one fold; folders of other folds are not scanned."""
    return read_table(spark, path).where(F.col(fold) == F.lit(value))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header that `read_csv` reads back: null is `NA`."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)
