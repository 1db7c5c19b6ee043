"""Queries over books that change after they are stored, and over rows that reports leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.sales import MONTH
from daybook.plans import book, loads
from daybook.plans.dashboard import Dashboard
from daybook.registry.stored import written_csv
from daybook.schemas import ORDERS, PRODUCTS
from daybook.session import scratch
from daybook.sinks.json_rows import array_object, array_rows
from daybook.sources import sample
from daybook.sources.delimited import REASON
from daybook.sources.stored import read_sales, read_table


def rollup_refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """A stored rollup after all orders of a month have moved to the next one."""
    fact, rolled = scratch(spark, "fact"), scratch(spark, "rollup")
    lines = sample.lines(spark, folder)
    book.write_fact(lines, fact)
    book.write_rollup(read_sales(spark, fact), rolled)
    left = F.date_format("order_date", "yyyy-MM") == "1996-05"
    book.write_fact(lines.withColumn(
        "order_date", F.when(left, F.to_date(F.lit("1996-06-01"))).otherwise(F.col("order_date"))), fact)
    book.refresh_rollup(spark, read_sales(spark, fact), rolled, ["1996-05", "1996-06"])
    return read_sales(spark, rolled)


def fact_appended(spark: SparkSession, folder: str) -> DataFrame:
    """A stored fact that a batch adds to: some of its orders are known and all come twice."""
    path, orders = scratch(spark, "fact"), book.clean_orders(sample.orders_as_text(spark, folder))
    book.write_fact(orders.filter(F.col("order_no") % 3 != 0), path)
    batch = orders.filter(F.col("order_no") % 2 == 0)
    book.append_orders(batch.unionByName(batch), path)
    return read_sales(spark, path).select("order_no", "order_date", "user_id", "amount", MONTH)


def csv_load_orders_line_breaks(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Orders through a CSV file in which some date texts end in a line break."""
    mark = F.when(F.col("o_orderkey") % 5 == 0, "\n").otherwise("")
    rows = sample.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_no"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), mark).alias("order_date_time"))
    path = scratch(spark, "orders")
    with written_csv(rows) as csv:
        loads.load_table(spark, csv, ORDERS, path, **options)
    return read_table(spark, path).select("order_no", "order_date_time")


def csv_load_orders_by_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same by a reader that splits files among tasks."""
    return csv_load_orders_line_breaks(spark, folder, by_blocks=True)


def csv_quarantine_twice(spark: SparkSession, folder: str) -> DataFrame:
    """The bad rows of a file that was loaded twice."""
    rows = sample.table(spark, folder, "part").select(
        F.col("p_partkey").alias("prod_id"),
        F.when(F.col("p_size") > 40, "unlimited").otherwise(F.col("p_size").cast("string")).alias("data_limit"))
    path, rejected = scratch(spark, "products"), scratch(spark, "rejected")
    with written_csv(rows) as csv:
        for _ in range(2):
            loads.insert_good_rows(spark, csv, PRODUCTS, path, rejected)
    return read_table(spark, rejected).groupBy(F.col(REASON).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def _gaps(spark: SparkSession, folder: str) -> Dashboard:
    """Lines without creator or amount, of unknown products, and of products that cover nothing or begin with a comma."""
    order, product = F.col("order_no"), F.col("prod_id") % 5
    lines = sample.lines(spark, folder).withColumns({
        "created_by": F.when(order % 3 != 0, F.col("created_by")),
        "amount": F.when((order % 5 != 0) & (F.col("created_by") % 4 != 0), F.col("amount"))})
    coverage = F.col("coverage_destinations")
    products = sample.products(spark, folder).filter(F.col("prod_id") % 7 != 0).withColumn(
        "coverage_destinations", F.when(product == 1, "").when(product == 2, F.concat(F.lit(","), coverage)).when(product != 0, coverage))
    return Dashboard(lines, sample.suppliers(spark, folder), products, sample.destinations(spark, folder))


def leaderboard_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return _gaps(spark, folder).leaderboard("1998-03-31")


def destinations_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return _gaps(spark, folder).top_destinations("1998-03-31", limit=None)


def destinations_array(spark: SparkSession, folder: str) -> DataFrame:
    """The ten destinations as one JSON array."""
    board = Dashboard(sample.lines(spark, folder), None, sample.products(spark, folder), sample.destinations(spark, folder))
    return array_object(board.top_destinations("1998-03-31"), [-F.col("order_count"), F.col("destination_name")])


def leaderboard_array(spark: SparkSession, folder: str) -> DataFrame:
    """The objects of the leaderboard's stored JSON array."""
    path = scratch(spark, "array")
    Dashboard(sample.lines(spark, folder), sample.suppliers(spark, folder)).write_leaderboard(path, "1998-03-31")
    return array_rows(spark, path)


def sql_text_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """SQL text over the cleaned view, with bound parameters."""
    book.register_views(sample.orders_as_text(spark, folder))
    return spark.sql(
        "SELECT order_date, count(*) AS orders FROM orders_parsed WHERE order_date BETWEEN :first AND :last GROUP BY order_date",
        args={"first": "1998-03-01", "last": "1998-03-31"})


def queries() -> dict:
    return {f.__name__: f for f in (
        rollup_refreshed, fact_appended, csv_load_orders_line_breaks, csv_load_orders_by_blocks, csv_quarantine_twice, leaderboard_gaps,
        destinations_gaps, destinations_array, leaderboard_array, sql_text_parameters)}
