"""Site series over the test tables, as DataFrames and as SQL.

A site is a nation, its daily series the mean of the line items its suppliers ship on a day. Some
values are set to null on fixed days so that null rules show; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Schemas of the test tables in use. A given schema saves the job that would infer it.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def site_name(key: str):
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 2, "0"))


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their site and day."""
    supplier = table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS l_suppkey", "s_nationkey", "concat('S', lpad(cast(s_nationkey AS string), 2, '0')) AS sitename"
    )
    return table(spark, sf, "lineitem").join(supplier, "l_suppkey").withColumn("date", F.col("l_shipdate").cast("date"))


def site_daily(spark: SparkSession, sf: str) -> DataFrame:
    means = shipments(spark, sf).groupBy("sitename", "date", "s_nationkey").agg(*[F.expr(e) for e in (
        "avg(l_extendedprice) / 1000 AS obs",
        "avg(l_extendedprice * (1 - l_discount)) / 1000 + 0.2D * (avg(l_quantity) - 25) AS mod",
        "avg(1 - 2 * l_discount) AS qc",
        "count(*) AS n_lines",
    )])
    return means.selectExpr(
        "sitename", "date",
        "CASE WHEN (dayofyear(date) + s_nationkey) % 11 <> 0 THEN obs END AS obs",
        "CASE WHEN (dayofyear(date) + s_nationkey) % 17 <> 0 THEN mod END AS mod",
        "qc", "n_lines",
    )


def site_info(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    region = F.element_at(F.array(*[F.lit(c) for c in ("Aw", "Cfb", "Dfb", "BSk", "Csa")]), F.col("n_regionkey") + 1)
    land = F.element_at(F.array(*[F.lit(c) for c in ("CRO", "WET", "ENF", "DBF", "GRA", "EBF")]), n % 6 + 1)
    return table(spark, sf, "nation").select(
        site_name("n_nationkey").alias("sitename"),
        ((n - 12) * 5.0).alias("lat"), (n * 7.0).alias("lon"), region.alias("koeppen_code"),
        land.alias("igbp_land_use"),
        F.when(n % 4 == 0, True).when(n % 4 != 1, False).alias("c4"),
        (1995 + n % 3).alias("year_start"), (2001 - n % 2).alias("year_end"),
        F.when(n % 5 == 0, "TRUE").when(n % 9 != 4, "FALSE").alias("drop_gpp"), (n % 7 == 0).alias("drop_le"),
        (1995 + n % 3).alias("year_start_gpp"), (2001 - n % 2).alias("year_end_gpp"),
        (1996 - n % 2).alias("year_start_le"), (2000 + n % 2).alias("year_end_le"),
    )


def forcing(spark: SparkSession, sf: str) -> DataFrame:
    """A forcing table: fluxes, weather and their units follow from the daily series."""
    return site_daily(spark, sf).select(
        "sitename", "date", F.col("obs").alias("gpp"), F.col("qc").alias("gpp_qc"),
        (F.col("obs") * 3.0).alias("le"), (F.col("mod") / 4.0).alias("temp"),
        (101325.0 - 20.0 * F.col("n_lines")).alias("patm"), (F.col("n_lines") * 0.00003).alias("rain"),
        (F.col("n_lines") * 0.5).alias("runoff"), (F.col("n_lines") * 4.0).alias("prec"),
        (F.col("mod") * 0.8).alias("ppfd"),
    )


def flags(daily: DataFrame, above: float = 60.0) -> DataFrame:
    return daily.select(F.col("sitename").alias("site"), "date", (F.col("obs") > above).alias("isevent"))


VIEWS_SQL = """
site_daily AS (
  SELECT sitename, date,
         CASE WHEN (dayofyear(date) + site_no) % 11 = 0 THEN NULL ELSE obs END AS obs,
         CASE WHEN (dayofyear(date) + site_no) % 17 = 0 THEN NULL ELSE mod END AS mod,
         qc, n_lines
  FROM (SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS sitename, n_nationkey AS site_no,
               CAST(l_shipdate AS DATE) AS date,
               avg(l_extendedprice) / 1000 AS obs,
               avg(l_extendedprice * (1 - l_discount)) / 1000 + 0.2 * (avg(l_quantity) - 25) AS mod,
               avg(1 - 2 * l_discount) AS qc, count(*) AS n_lines
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2, 3) t),
site_info AS (
  SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS sitename,
         CAST((n_nationkey - 12) * 5.0 AS DOUBLE) AS lat, CAST(n_nationkey * 7.0 AS DOUBLE) AS lon,
         CASE n_regionkey WHEN 0 THEN 'Aw' WHEN 1 THEN 'Cfb' WHEN 2 THEN 'Dfb' WHEN 3 THEN 'BSk' ELSE 'Csa' END AS koeppen_code,
         CASE n_nationkey % 6 WHEN 0 THEN 'CRO' WHEN 1 THEN 'WET' WHEN 2 THEN 'ENF' WHEN 3 THEN 'DBF'
              WHEN 4 THEN 'GRA' ELSE 'EBF' END AS igbp_land_use,
         CASE n_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS c4,
         1995 + n_nationkey % 3 AS year_start, 2001 - n_nationkey % 2 AS year_end,
         CASE WHEN n_nationkey % 5 = 0 THEN 'TRUE' WHEN n_nationkey % 9 = 4 THEN NULL ELSE 'FALSE' END AS drop_gpp,
         n_nationkey % 7 = 0 AS drop_le,
         1995 + n_nationkey % 3 AS year_start_gpp, 2001 - n_nationkey % 2 AS year_end_gpp,
         1996 - n_nationkey % 2 AS year_start_le, 2000 + n_nationkey % 2 AS year_end_le
  FROM nation),
forcing AS (
  SELECT sitename, date, obs AS gpp, qc AS gpp_qc, obs * 3.0 AS le, mod / 4.0 AS temp,
         CAST(101325.0 - 20.0 * n_lines AS DOUBLE) AS patm, CAST(n_lines * 0.00003 AS DOUBLE) AS rain,
         CAST(n_lines * 0.5 AS DOUBLE) AS runoff, CAST(n_lines * 4.0 AS DOUBLE) AS prec, mod * 0.8 AS ppfd
  FROM site_daily)
"""
