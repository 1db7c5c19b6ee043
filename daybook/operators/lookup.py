"""Orders per destination: product coverage and destination names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.text import is_filled, primary_member
from daybook.operators.sales import order_count


def orders_per_destination(sales: DataFrame, products: DataFrame, destinations: DataFrame) -> DataFrame:
    """``destination_name, order_count`` over the first destination each product covers.

    Counts are folded before each join, to one row per product and then to one
    per destination code. Every join is thus between unique keys, and a product
    or destination with a third of all orders is one row like any other.
    Codes without a destination show as themselves; orders whose product is
    unknown or covers nothing do not count.
    """
    per_product = (
        sales.filter(F.col("product_id").isNotNull())
        .groupBy("product_id").agg(order_count(sales).alias("n"))
    )
    covered = products.filter(is_filled(F.col("coverage_destinations"))).select(
        "prod_id", primary_member(F.col("coverage_destinations")).alias("code"))
    per_code = (
        per_product.join(covered, F.col("product_id") == F.col("prod_id"))
        .groupBy("code").agg(F.sum("n").alias("n"))
    )
    names = destinations.select("destination_id", "destination_name")
    return (
        per_code.join(names, F.col("code") == F.col("destination_id"), "left")
        .groupBy(F.coalesce("destination_name", "code").alias("destination_name"))
        .agg(F.sum("n").cast("bigint").alias("order_count"))
    )
