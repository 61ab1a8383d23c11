"""The propensity tables of the driver's data: persons are customers, proposals are orders, contracts are line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import propensity as P

SINCE = "2000-01-01"
CUTS = [100000.0, 200000.0, 300000.0]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent open orders."""
    rows = P.eligible_anchors(orders(spark, sf_dir), ["O"], SINCE, "2100-01-01", status="o_orderstatus", ts="o_orderdate")
    return rows.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders scored by their price, with bands and test or control by customer."""
    rows = anchors(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderkey").alias("record_id"), F.round(F.col("o_totalprice"), 0).alias("score"))
    return P.assigned(P.with_bands(rows), "20240101")
