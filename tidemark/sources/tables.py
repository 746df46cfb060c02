"""Parquet table scans of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clean import six_digits
from tidemark.session import bounded_broadcast


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def funds(spark: SparkSession, folder: str) -> DataFrame:
    """One row ``(fund, symbol)`` per instrument; ``fund`` is the six digits."""
    listed = table(spark, folder, "instruments").select(six_digits("symbol").alias("fund"), "symbol")
    return listed.where("fund IS NOT NULL").groupBy("fund").agg(F.min("symbol").alias("symbol"))


def with_symbol(df: DataFrame, folder: str) -> DataFrame:
    """Replace ``fund`` by the listed symbol; rows of codes that are no listed fund are left out."""
    listed = bounded_broadcast(funds(df.sparkSession, folder))
    return df.join(listed, "fund").drop("fund")
