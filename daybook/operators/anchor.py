"""The day a report is as of, as a column.

A given date is a literal: nothing is scanned for it and the report's ranges
become constants. Otherwise the day is an uncorrelated scalar subquery, which
Spark evaluates once per query however often the column is used.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.dates import as_date, as_month
from daybook.operators.sales import MONTH, between


def as_of(sales: DataFrame, date: dt.date | str | None = None, month: str | None = None,
          newest: dt.date | None = None) -> Column:
    """``date`` if given, else the last order date inside ``month`` if given,
    else the last order date of all, which is in the month ``newest`` if that is known."""
    if date is not None and month is not None:
        raise ValueError("give a date or a month, not both")
    if date is not None:
        return F.lit(as_date(date))
    if month is not None:
        return last_day_in(sales, month).scalar()
    return last_day(sales, newest).scalar()


def last_day(sales: DataFrame, newest: dt.date | None = None) -> DataFrame:
    """One row ``today``: the latest order date, NULL if there is none.

    On a stored fact only the newest month is read. Where the caller knows which one that is
    (``daybook.sources.stored.newest_month`` lists the folder), no other month is opened; else
    the partition column is read to the end, which costs no data column but passes over every row.
    """
    if newest is not None:
        sales = sales.filter(F.col(MONTH) == F.lit(newest))
    elif MONTH in sales.columns:
        newest = sales.agg(F.max(MONTH).alias(MONTH)).scalar()
        sales = sales.filter(F.col(MONTH) == newest)
    return sales.agg(F.max("order_date").alias("today"))


def last_day_in(sales: DataFrame, month: str) -> DataFrame:
    """One row ``today``: the latest order date inside ``month`` (``YYYY-MM``),
    or the month's last day if it has no orders."""
    first = F.lit(as_month(month))
    end = F.last_day(first)
    return between(sales, first, end).agg(F.coalesce(F.max("order_date"), end).alias("today"))
