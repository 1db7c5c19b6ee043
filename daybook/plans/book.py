"""The cleaned order fact and its daily rollup, as stored tables.

Both are partitioned by month, so that a report opens only the months it needs,
and sorted by day within files, so that row groups of other days are skipped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.dates import as_month, looks_like_date, month_start, parse_order_date
from daybook.operators.keyed import first_per_key, insert_if_absent
from daybook.operators.sales import MONTH, daily_cells
from daybook.session import scratch
from daybook.sinks.files import delete, replace_partitions, replace_table
from daybook.sources.stored import read_sales


def clean_orders(orders: DataFrame, strict: bool = False) -> DataFrame:
    """``orders`` with ``order_date_time`` replaced by the date it spells."""
    day = parse_order_date(F.col("order_date_time"), strict).alias("order_date")
    return orders.select(
        "order_no", day, "user_id", "product_id", "amount", "discount_amount", "created_by")


def register_views(orders: DataFrame, **tables: DataFrame) -> None:
    """Names ``orders``, its cleaned form ``orders_parsed`` and any other tables
    for use in SQL text. Prefer a stored fact where it is queried often: the
    view reads the date texts anew each time."""
    views = {"orders": orders, "orders_parsed": clean_orders(orders), **tables}
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def date_quality(orders: DataFrame) -> DataFrame:
    """Orders whose date was read, names no day, is spelled in no known way, or is missing."""
    text = F.col("order_date_time")
    state = (
        F.when(parse_order_date(text).isNotNull(), "parsed")
        .when(looks_like_date(text), "no such day")
        .when(text.isNull() | (text == ""), "missing")
        .otherwise("unknown spelling")
    )
    return orders.groupBy(state.alias("date_state")).agg(F.count(F.lit(1)).alias("rows"))


def unreadable_dates(orders: DataFrame) -> DataFrame:
    """The orders no report counts, with the text that was not understood."""
    return orders.filter(parse_order_date(F.col("order_date_time")).isNull())


#: Rows of a month are spread over so many parts: by day, and rows without a date by their content.
PARTS = 31


def by_month(sales: DataFrame) -> DataFrame:
    """``sales`` laid out for a write partitioned by month.

    A month's days are dealt out among tasks, and so are the rows without a date, so that neither
    depends on adaptive execution to be split. With it, ``rebalance`` also joins small parts and splits large ones.
    """
    part = F.coalesce(F.dayofmonth("order_date"), F.pmod(F.xxhash64(*sales.columns), F.lit(PARTS)).cast("int"))
    return (
        sales.withColumns({MONTH: month_start(F.col("order_date")), "_part": part})
        .hint("rebalance", MONTH, "_part")
        .sortWithinPartitions(MONTH, "order_date")
        .drop("_part")
    )


def write_fact(orders: DataFrame, path: str) -> None:
    """Stores cleaned orders. Orders without a date are kept, in a partition of
    their own that no report reads."""
    replace_table(by_month(orders), path, partition_by=MONTH)


CELLS = ("created_by", "product_id")
#: One rollup for each use: summary and trends, leaderboard, destinations.
USES = {"days": (), "creators": ("created_by",), "products": ("product_id",)}


def rollup(sales: DataFrame, keys: Sequence[str] = CELLS) -> DataFrame:
    return daily_cells(sales, keys)


def write_rollup(sales: DataFrame, path: str, keys: Sequence[str] = CELLS) -> None:
    replace_table(by_month(rollup(sales, keys)), path, partition_by=MONTH)


def write_rollups(sales: DataFrame, folder: str) -> None:
    """A stored rollup for each use, as ``Dashboard.rolled_up`` reads them. The days come from the creators' table."""
    for name in ("creators", "products"):
        write_rollup(sales, f"{folder}/{name}", USES[name])
    write_rollup(read_sales(sales.sparkSession, f"{folder}/creators"), f"{folder}/days", USES["days"])


def append_orders(batch: DataFrame, path: str) -> list[str | None]:
    """Adds the cleaned orders of ``batch`` that the stored fact lacks, and returns the months
    (``YYYY-MM``, ``None`` for orders without a date) that got any, for :func:`refresh_rollup`.

    Only the months that the batch falls in are read and written: an order is known if its number is in the
    month of its date. Of a number repeated in the batch the row with the smallest date is taken. The fact must exist.
    """
    spark = batch.sparkSession
    staging = scratch(spark, "batch")
    try:
        dated = batch.withColumn("_day", F.col("order_date"))
        firsts = first_per_key(dated, "order_no", ["_day"]).withColumn(MONTH, month_start(F.col("order_date")))
        firsts.write.parquet(f"{staging}/firsts")
        rows = spark.read.schema(firsts.schema).parquet(f"{staging}/firsts")
        # One row for each month.
        touched = [row[0] for row in rows.select(MONTH).distinct().collect()]
        known = read_sales(spark, path).filter(_in_months(touched)).select("order_no")
        fresh = insert_if_absent(rows, known, "order_no")
        # Staged too: its months are named before its rows are added.
        fresh.write.parquet(f"{staging}/fresh")
        fresh = spark.read.schema(rows.schema).parquet(f"{staging}/fresh")
        added = [row[0] for row in fresh.select(MONTH).distinct().collect()]
        if added:
            by_month(fresh.drop(MONTH)).write.mode("append").partitionBy(MONTH).parquet(path)
    finally:
        delete(spark, staging)
    return sorted((None if month is None else f"{month:%Y-%m}" for month in added), key=str)


def _in_months(firsts: Sequence[dt.date | None]) -> Column:
    """Partition filter for months given by their first days."""
    kept = F.col(MONTH).isin(*[F.lit(day) for day in firsts if day is not None])
    return kept | F.col(MONTH).isNull() if None in firsts else kept


def refresh_rollups(spark: SparkSession, fact: DataFrame, folder: str, months: Sequence[str | None]) -> None:
    """:func:`refresh_rollup` for each use."""
    for name, keys in USES.items():
        refresh_rollup(spark, fact, f"{folder}/{name}", months, keys)


def refresh_rollup(spark: SparkSession, fact: DataFrame, path: str, months: Sequence[str | None],
                   keys: Sequence[str] = CELLS) -> None:
    """Recomputes some months (``YYYY-MM``, ``None`` for orders without a date) of a stored rollup.

    Name every month that lost or gained orders; :func:`append_orders` returns them. Only these months are
    read and replaced; one that has no orders left goes. A failure leaves the rollup as it was.
    """
    firsts = [None if month is None else as_month(month) for month in dict.fromkeys(months)]
    if firsts:
        touched = rollup(fact.filter(_in_months(firsts)), keys)
        replace_partitions(by_month(touched), path, MONTH, [None if day is None else day.isoformat() for day in firsts])
