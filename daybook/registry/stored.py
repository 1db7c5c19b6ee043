"""Queries that go through files: the sample tables are written as CSV or as
stored tables into the scratch folder, loaded back and reported on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import ranking
from daybook.operators.sales import MONTH
from daybook.plans import book, loads
from daybook.plans.dashboard import Dashboard
from daybook.schemas import DESTINATIONS, LONG, ORDERS, PRODUCTS, USERS, Table
from daybook.session import scratch
from daybook.sinks.files import delete, write_csv
from daybook.sources import sample
from daybook.sources.delimited import REASON
from daybook.sources.stored import read_sales, read_table


@contextmanager
def written_csv(df: DataFrame) -> Iterator[str]:
    """``df`` as CSV files, deleted when they have been loaded."""
    path = scratch(df.sparkSession, "csv")
    write_csv(df, path)
    try:
        yield path
    finally:
        delete(df.sparkSession, path)


def _loaded(df: DataFrame, table: Table, **options) -> DataFrame:
    """``df`` through a CSV file and the loader of ``table``."""
    spark = df.sparkSession
    path = scratch(spark, table.name)
    with written_csv(df) as csv:
        loads.load_table(spark, csv, table, path, **options)
    return read_table(spark, path)


def csv_load_users(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as users; names hold commas, quotes and a line break."""
    rows = sample.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit('"'), "c_name", F.lit('",\n'), "c_mktsegment").alias("name"),
        F.col("c_nationkey").cast("string").alias("country_code"),
        F.lit("").alias("mobile"),
        F.lit(1).alias("user_role"),
        F.lit(None).cast("string").alias("created_datetime"),
    )
    return _loaded(rows, USERS).select("user_id", "name", "country_code", "mobile", "user_role")


def _product_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as products, under camelCase headers and in another column order."""
    return sample.table(spark, folder, "part").select(
        F.concat("p_brand", F.lit(" ,"), "p_type").alias("coverageDestinations"),
        F.col("p_name").alias("productName"),
        F.col("p_partkey").alias("prodId"),
        F.col("p_retailprice").cast("decimal(10,2)").cast("string").alias("amount"),
        F.col("p_size").cast("string").alias("dataLimit"),
    )


def csv_load_products(spark: SparkSession, folder: str) -> DataFrame:
    return _products(_loaded(_product_rows(spark, folder), PRODUCTS))


def _products(df: DataFrame) -> DataFrame:
    return df.select("prod_id", "data_limit", "amount", "product_name", "coverage_destinations")


def csv_load_destinations(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as destinations; the member list ends in a line break. Columns
    are taken by position, under headers that say nothing."""
    rows = sample.table(spark, folder, "nation").select(
        F.concat(F.lit("N"), "n_nationkey").alias("a"),
        F.col("n_regionkey").alias("b"),
        F.col("n_name").alias("c"),
        F.lit(None).cast("string").alias("d"),
        F.concat(F.lit("A, "), "n_name", F.lit("\n")).alias("e"),
        (F.col("n_regionkey") % 2).alias("f"),
    )
    return _loaded(rows, DESTINATIONS, header_names=False)


def csv_load_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders through a CSV file, the loader, cleaning and the stored fact."""
    orders = _loaded(sample.orders_as_text(spark, folder), ORDERS)
    return read_sales(spark, _stored_fact(book.clean_orders(orders))).select(
        "order_no", "order_date", "user_id", "amount", MONTH)


def csv_insert_all_or_nothing(spark: SparkSession, folder: str) -> DataFrame:
    """Parts are stored; a file then brings them again, under other names."""
    return _inserted_twice(spark, folder, loads.insert_all_or_nothing)


def csv_insert_good_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The same, with a file in which some rows are bad."""
    def insert(spark, csv_path, table, path):
        loads.insert_good_rows(spark, csv_path, table, path, scratch(spark, "rejected"))
    return _inserted_twice(spark, folder, insert, _spoiled)


def _spoiled(rows: DataFrame) -> DataFrame:
    """Large products have a text for their data limit, the others a number."""
    limit = F.col("dataLimit")
    return rows.withColumn("dataLimit", F.when(limit.cast("int") > 40, "unlimited").otherwise(limit))


def _inserted_twice(spark: SparkSession, folder: str, insert: Callable,
                    spoil: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    rows = _product_rows(spark, folder)
    cheap = F.col("amount").cast("decimal(10,2)") < 1000
    path = scratch(spark, PRODUCTS.name)
    for part in (rows.filter(cheap), rows.withColumn("productName", F.lit("again"))):
        with written_csv(spoil(part)) as csv:
            insert(spark, csv, PRODUCTS, path)
    return _products(read_table(spark, path))


def csv_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """The bad rows of that file, by reason."""
    rejected = scratch(spark, "rejected")
    with written_csv(_spoiled(_product_rows(spark, folder))) as csv:
        loads.insert_good_rows(spark, csv, PRODUCTS, scratch(spark, PRODUCTS.name), rejected)
    return read_table(spark, rejected).groupBy(F.col(REASON).alias("reason")).agg(
        F.count(F.lit(1)).alias("rows"))


def type_widening(spark: SparkSession, folder: str) -> DataFrame:
    """A stored table rewritten with a 64-bit key and a text for a number."""
    path = scratch(spark, PRODUCTS.name)
    with written_csv(_product_rows(spark, folder)) as csv:
        loads.load_table(spark, csv, PRODUCTS, path)
    wider = PRODUCTS.widen(add_on_id=255, prod_id=LONG, data_limit=PRODUCTS.field("product_name").type)
    loads.rewrite_types(spark, path, wider)
    return _products(read_table(spark, path))


def _stored_fact(orders: DataFrame) -> str:
    path = scratch(orders.sparkSession, "fact")
    book.write_fact(orders, path)
    return path


def summary_stored_fact(spark: SparkSession, folder: str) -> DataFrame:
    """As of the latest day, over a stored fact cleaned from text dates."""
    return Dashboard.stored(spark, _stored_fact(book.clean_orders(sample.orders_as_text(spark, folder)))).summary()


def summary_stored_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """As of the latest day, over a stored rollup."""
    return _rolled_up(spark, folder).summary()


def _rolled_up(spark: SparkSession, folder: str) -> Dashboard:
    path = scratch(spark, "rollups")
    book.write_rollups(sample.lines(spark, folder), path)
    return Dashboard.rolled_up(spark, path, sample.suppliers(spark, folder), sample.products(spark, folder),
                               sample.destinations(spark, folder))


def leaderboard_stored_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _rolled_up(spark, folder).leaderboard()


def destinations_stored_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _rolled_up(spark, folder).top_destinations()


def rollup_rows(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows the rollup for each use has."""
    lines = sample.lines(spark, folder)
    counts = [book.rollup(lines, keys).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
              for name, keys in book.USES.items()]
    return reduce(DataFrame.unionByName, counts)


def leaderboard_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Line orders per supplier, numbered block by block as for a large table."""
    per_creator = sample.lines(spark, folder).groupBy("created_by").agg(
        F.count(F.lit(1)).alias("orders"))
    return ranking.number_rows(per_creator, "orders", "created_by")


def csv_export(spark: SparkSession, folder: str) -> DataFrame:
    """The daily trend written as CSV and read back as text."""
    path = scratch(spark, "csv")
    write_csv(Dashboard(sample.orders(spark, folder)).daily("1998-03-31"), path)
    return spark.read.option("header", True).csv(path)
