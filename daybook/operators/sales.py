"""What the reports read: orders, or the daily rollup of orders.

Both carry ``order_date``; orders, and rollups by them, ``created_by`` and ``product_id``. Orders count one
each and bring an ``amount``; a rollup row stands for ``orders`` many with a
``revenue``. The measures below hide the difference, so every report runs on
either. A stored fact or rollup also has the partition column ``order_month``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.dates import month_start
from daybook.schemas import AMOUNT, TOTAL

MONTH = "order_month"


#: Marks the count column of a rollup. The mark is part of a stored table's schema, so no
#: table of orders is taken for a rollup for the names of its columns.
ROLLUP = {"daybook.rollup": True}


def is_rollup(sales: DataFrame) -> bool:
    return any(f.name == "orders" and f.metadata.get("daybook.rollup") for f in sales.schema.fields)


def order_count(sales: DataFrame, when: Column | None = None) -> Column:
    """Number of orders (for which ``when`` holds); 0 where there are none."""
    if is_rollup(sales):
        return F.coalesce(F.sum(_if(when, F.col("orders"))), F.lit(0)).cast("bigint")
    return F.count(_if(when, F.lit(1)))


def revenue(sales: DataFrame, when: Column | None = None) -> Column:
    """Sum of amounts (where ``when`` holds); NULL where there is none.

    The sum is exact decimal arithmetic, so it needs no rounding to cents and
    is the same for any order of tasks.
    """
    value = F.col("revenue") if is_rollup(sales) else _amount()
    return F.sum(_if(when, value)).cast(TOTAL)


def revenue_per_group(sales: DataFrame, when: Column | None = None) -> Column:
    """:func:`revenue` for use below ``groupBy``: same result, half the time.

    A decimal sum wider than 18 digits is kept as a byte array in each group's
    buffer and decoded for every row. So whole units and hundredths are summed
    apart, both as 64-bit integers, and put together once per group. That holds
    for 10^16 orders and 9 * 10^18 units per group.
    """
    if is_rollup(sales):
        return revenue(sales, when)
    units = _amount().cast("bigint")
    # Sums of up to 8 digits are integer sums in Spark.
    hundredths = (_amount() - units.cast(AMOUNT)).cast("decimal(8,2)")
    return (F.sum(_if(when, units)).cast(TOTAL) + F.sum(_if(when, hundredths))).cast(TOTAL)


def _amount() -> Column:
    return F.col("amount").cast(AMOUNT)


def _if(condition: Column | None, value: Column) -> Column:
    return value if condition is None else F.when(condition, value)


def between(sales: DataFrame, first: Column, last: Column) -> DataFrame:
    """Sales dated ``first`` to ``last``, both included.

    Plain ranges on the date reach the Parquet scan, unlike comparisons of
    extracted years and months; on a stored fact they also prune its months.
    Rows without a date drop out.
    """
    day = F.col("order_date")
    kept = (day >= first) & (day <= last)
    if MONTH in sales.columns:
        month = F.col(MONTH)
        kept = (month >= month_start(first)) & (month <= month_start(last)) & kept
    return sales.filter(kept)


def daily_cells(sales: DataFrame, keys: Sequence[str] = ("created_by", "product_id")) -> DataFrame:
    """Orders and revenue per day and ``keys``: a rollup, of orders or of a finer rollup.

    Count and sum fold before the shuffle, so a creator or product with a
    third of all orders still sends one row per task, day and counterpart.
    NULL keys are kept, the reports treat them like NULLs of the orders.
    """
    return sales.groupBy("order_date", *keys).agg(
        order_count(sales).alias("orders", metadata=ROLLUP), revenue_per_group(sales).alias("revenue"))
