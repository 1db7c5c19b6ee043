"""The sample tables read as the four tables of the model.

Two readings. In the *order book* an order is a row of ``orders``, its creator
the customer's nation and the users are the nations. In the *line book* an
order is a row of ``lineitem``, its creator the supplier, its product the part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.schemas import AMOUNT, SALES_REP


# The columns of the sample tables. Naming them spares a job that
# would infer them from the files' footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str, creators: bool = False) -> DataFrame:
    """The order book, cleaned. ``creators`` adds ``created_by``, at the price
    of a join with the customers that most reports do not need."""
    book = table(spark, folder, "orders")
    columns = [
        F.col("o_orderkey").alias("order_no"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast(AMOUNT).alias("amount"),
    ]
    if creators:
        nations = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
        book = book.join(nations, F.col("o_custkey") == F.col("c_custkey"), "left")
        columns.append(F.col("c_nationkey").alias("created_by"))
    return book.select(*columns)


def orders_as_text(spark: SparkSession, folder: str) -> DataFrame:
    """The order book before cleaning: dates spelled in the two known ways, with
    and without a time, or in neither way, by order number."""
    day = F.col("o_orderdate")
    spelling = F.col("o_orderkey") % 4
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_no"),
        F.when(spelling == 0, F.date_format(day, "MM-dd-yyyy"))
         .when(spelling == 1, F.date_format(day, "MM/dd/yyyy HH:mm:ss"))
         .when(spelling == 2, F.date_format(day, "MM/dd/yyyy"))
         .otherwise(F.date_format(day, "yyyy-MM-dd")).alias("order_date_time"),
        F.col("o_custkey").cast("int").alias("user_id"),
        F.lit(None).cast("int").alias("product_id"),
        F.col("o_totalprice").cast(AMOUNT).alias("amount"),
        F.lit(None).cast("decimal(10,2)").alias("discount_amount"),
        F.lit(None).cast("int").alias("created_by"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as users of the order book; those outside region 0 are reps."""
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("user_id"),
        _padded(F.col("n_name")).alias("name"),
        _role(F.col("n_regionkey")).alias("user_role"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """The line book, cleaned."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_no"),
        F.col("l_shipdate").cast("date").alias("order_date"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").cast(AMOUNT).alias("amount"),
        F.col("l_discount").cast("decimal(10,2)").alias("discount_amount"),
        F.col("l_suppkey").cast("int").alias("created_by"),
    )


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as users of the line book; those outside nation 0 are reps."""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("int").alias("user_id"),
        _padded(F.col("s_name")).alias("name"),
        _role(F.col("s_nationkey")).alias("user_role"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    """Parts; the brand is the first destination covered, the type the second."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("prod_id"),
        F.concat("p_brand", F.lit(" ,"), "p_type").alias("coverage_destinations"),
    )


def destinations(spark: SparkSession, folder: str) -> DataFrame:
    """Nations outside region 0 under brand names, so that some brands have none."""
    return table(spark, folder, "nation").filter(F.col("n_regionkey") != 0).select(
        F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("destination_id"),
        F.col("n_name").alias("destination_name"),
    )


def _padded(name: Column) -> Column:
    return F.concat(F.lit("  "), name, F.lit(" "))


def _role(group: Column) -> Column:
    return F.when(group != 0, F.lit(SALES_REP)).otherwise(F.lit(1))
