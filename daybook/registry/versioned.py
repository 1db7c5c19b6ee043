"""Queries over a book that is added to and corrected by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.sales import MONTH
from daybook.plans import book
from daybook.plans.ledger import Ledger
from daybook.session import scratch
from daybook.sinks.versions import Store
from daybook.sources import sample

SHOWN = ("order_no", "order_date", "user_id", "amount", MONTH)


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return book.clean_orders(sample.orders_as_text(spark, folder))


def _begun(spark: SparkSession, folder: str) -> Ledger:
    """A book of two thirds of the orders."""
    ledger = Ledger(spark, scratch(spark, "book"), buckets=16)
    ledger.add(_orders(spark, folder).filter(F.col("order_no") % 3 != 0))
    return ledger


def _moved(spark: SparkSession, folder: str) -> DataFrame:
    """Every second order, twice, under a date in a later month: half of a third are new, the others known."""
    batch = _orders(spark, folder).filter(F.col("order_no") % 2 == 0).withColumn("order_date", F.date_add("order_date", 40))
    return batch.unionByName(batch.withColumn("order_date", F.date_add("order_date", 40)))


def fact_appended_moved(spark: SparkSession, folder: str) -> DataFrame:
    """Known orders that come again under another month's date stay as they are."""
    return _begun(spark, folder).add(_moved(spark, folder)).read("fact").select(*SHOWN)


def orders_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Known orders that come again as corrections take their new date, and count once."""
    return _begun(spark, folder).add(_moved(spark, folder), correct=True).read("fact").select(*SHOWN)


def rollup_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """The days of a book after three loads and a compaction of two."""
    ledger, orders = _begun(spark, folder), _orders(spark, folder)
    ledger.add(orders.filter(F.col("order_no") % 2 == 0))
    ledger.compact(loads=2)
    days = ledger.add(orders).read("days")
    return days.groupBy("order_date").agg(F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"))


def summary_pinned(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of a version after another one was published."""
    ledger = _begun(spark, folder)
    page = ledger.dashboard(ledger.at())
    ledger.add(_orders(spark, folder))
    return page.summary("1997-05-15")


def late_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by month after a stream of late ones, some of them known, has been taken."""
    ledger, late = _begun(spark, folder), scratch(spark, "late")
    _orders(spark, folder).filter(F.col("order_no") % 2 == 0).repartition(2, "order_no").write.parquet(late)
    stream = spark.readStream.schema(_orders(spark, folder).schema).option("maxFilesPerTrigger", 1).parquet(late)
    ledger.follow(stream, "late", scratch(spark, "progress")).awaitTermination()
    return ledger.at().read("fact").groupBy(MONTH).agg(F.count(F.lit(1)).alias("orders"))


def widened_by_version(spark: SparkSession, folder: str) -> DataFrame:
    """Parts, half of them stored before their number's type was widened and a column came."""
    store = Store(spark, scratch(spark, "parts"))
    parts = sample.table(spark, folder, "part")
    change = store.change()
    change.append("parts", parts.filter("p_partkey % 2 = 0").select(F.col("p_partkey").cast("int").alias("prod_id"), F.col("p_brand").alias("brand")))
    change.commit()
    rest = parts.filter("p_partkey % 2 = 1").select(
        F.col("p_partkey").cast("long").alias("prod_id"), F.col("p_brand").alias("brand"), F.col("p_size").cast("int").alias("size"))
    change = store.change()
    change.widen("parts", rest.schema)
    change.append("parts", rest)
    return change.commit().read("parts")


def queries() -> dict:
    return {f.__name__: f for f in (fact_appended_moved, orders_corrected, rollup_deltas, summary_pinned, late_orders, widened_by_version)}
