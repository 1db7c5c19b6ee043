"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names.

A staged table cuts lineage and fixes what depends on the order of rows, such as
generated numbers. All executors can read it, so a lost executor costs only its tasks.
The tables stay as long as results that read them; clearing the folder is the cluster's policy.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.session import scratch


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet and read back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that have been staged: it does so once the driver has collected its garbage.

    What Python lets go of reaches the driver's JVM a moment later, hence twice.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def tasks(df: DataFrame) -> int:
    """How many tasks a shuffle of this session has."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: Sequence[Column], amount: Column, name: str, label: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before each in ``order``; staged.

    Rows are dealt out by range and summed in each range; what crosses ranges is
    one number for each of them. Equal rows in ``order`` should be told apart by it, else their order is open.
    """
    spread = df.repartitionByRange(tasks(df), *order).withColumn("_part", F.spark_partition_id())
    staged = stage(spread, label)
    parts = staged.groupBy("_part").agg(F.sum(amount).alias("_own"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each shuffle task: bounded by a setting, not by the input.
    return (
        staged.join(F.broadcast(parts), "_part")
        .withColumn(name, F.col("_before") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("_part", "_before")
    )

