"""Stored tables: Parquet folders and, where a driver is on the class path, JDBC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.sales import MONTH
from daybook.sinks.files import partitions


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """A stored fact or rollup. The month is a date even where no folder name
    says so, as when no order has a date."""
    sales = spark.read.parquet(path)
    return sales.withColumn(MONTH, F.col(MONTH).cast("date"))


def newest_month(spark: SparkSession, path: str) -> dt.date | None:
    """The newest month of a stored fact or rollup that holds dated orders, from its folder's listing."""
    months = [dt.date.fromisoformat(value) for value in partitions(spark, path, MONTH) if value is not None]
    return max(months, default=None)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int,
              tasks: int, **options: str) -> DataFrame:
    """A database table, read by ``tasks`` connections over ranges of an integer
    key. ``low`` and ``high`` only place the ranges; no row is left out. Pass
    user and password as options from a secret store, never in the URL."""
    return (
        spark.read.format("jdbc").options(**options)
        .option("url", url).option("dbtable", name)
        .option("partitionColumn", key).option("lowerBound", low).option("upperBound", high)
        .option("numPartitions", tasks).load()
    )
