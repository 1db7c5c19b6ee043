"""Checks of loaded tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.operators.keyed import key_violations

#: Fixed value: the label of the orders whose date was read.
VALID_DATES = "orders_parsed (valid dates)"


def load_check(tables: dict[str, DataFrame], clean: DataFrame) -> DataFrame:
    """``table_name, rows`` for each table, for the orders and for those of them with a valid date.

    ``clean`` are the cleaned orders, as many as there are orders: one pass counts both.
    """
    counts = [_counted(name, df.agg(F.count(F.lit(1)).alias("rows"))) for name, df in tables.items()]
    orders = clean.agg(F.count(F.lit(1)).alias("orders"), F.count("order_date").alias(VALID_DATES))
    counts.append(orders.unpivot([], ["orders", VALID_DATES], "table_name", "rows"))
    return reduce(DataFrame.unionByName, counts)


def _counted(name: str, counted: DataFrame) -> DataFrame:
    return counted.select(F.lit(name).alias("table_name"), "rows")


def key_check(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``table_name, bad_keys, surplus_rows`` for each table and its key column;
    zeros for a valid primary key. A NULL key's rows are all surplus."""
    def bad(name: str, df: DataFrame, key: str) -> DataFrame:
        surplus = F.when(F.col(key).isNull(), F.col("rows")).otherwise(F.col("rows") - 1)
        return key_violations(df, key).agg(
            F.count(F.lit(1)).alias("bad_keys"),
            F.coalesce(F.sum(surplus), F.lit(0)).alias("surplus_rows"),
        ).select(F.lit(name).alias("table_name"), "bad_keys", "surplus_rows")

    return reduce(DataFrame.unionByName, [bad(n, df, k) for n, (df, k) in tables.items()])
