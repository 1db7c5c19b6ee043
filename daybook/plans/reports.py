"""The reports. Each takes sales (orders or rollup) and the day it is as of,
a column made by :func:`daybook.operators.anchor.as_of`, and returns a DataFrame.

No report runs a job by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.dates import day_tick, month_start, month_tick, month_title
from daybook.operators.lookup import orders_per_destination
from daybook.operators.ranking import number_rows
from daybook.operators.sales import between, order_count, revenue, revenue_per_group
from daybook.schemas import MONTHLY_TARGET, SALES_REP, TOTAL

#: The daily trend reaches this many days back, the monthly one this many months.
TREND_DAYS = 60
TREND_MONTHS = 11
TOP_DESTINATIONS = 10


#: The day a report is as of, carried by each row it reads. Naming a column many
#: times is free; naming a scalar subquery makes Spark optimize it each time.
TODAY = "_today"


def _rows(sales: DataFrame, first: Column, last: Column, today: Column) -> DataFrame:
    return between(sales, first, last).withColumn(TODAY, today)


def _two_months(sales: DataFrame, today: Column) -> DataFrame:
    return _rows(sales, month_start(today, -1), today, today)


def _last_month(sales: DataFrame, today: Column) -> DataFrame:
    return _rows(sales, month_start(today, -1), F.date_sub(month_start(today), 1), today)


# Conditions on rows that reach from the previous month to today.

def _day() -> Column:
    return F.col("order_date")


def _is_today() -> Column:
    return _day() == F.col(TODAY)


def _this_month() -> Column:
    return _day() >= month_start(F.col(TODAY))


def _previous_month() -> Column:
    return _day() < month_start(F.col(TODAY))


def _to_same_day() -> Column:
    """Up to today's day of the month. The 31st takes a shorter month whole; the
    28th of February takes only 28 days of January."""
    return F.dayofmonth(_day()) <= F.dayofmonth(TODAY)


def summary(sales: DataFrame, today: Column) -> DataFrame:
    """One row with the four cards, from one pass over two months of sales.

    The today and same-day cards count 0 where there is nothing; the month
    cards are NULL then, labels included.
    """
    this_month, last_month = _this_month(), _previous_month()
    same_day = last_month & _to_same_day()
    return _two_months(sales, today).agg(
        order_count(sales, _is_today()).alias("today_orders"),
        revenue(sales, _is_today()).alias("today_revenue"),
        F.nullif(order_count(sales, this_month), F.lit(0)).alias("mtd_orders"),
        revenue(sales, this_month).alias("mtd_revenue"),
        order_count(sales, same_day).alias("prev_same_orders"),
        revenue(sales, same_day).alias("prev_same_revenue"),
        F.nullif(order_count(sales, last_month), F.lit(0)).alias("prev_full_orders"),
        revenue(sales, last_month).alias("prev_full_revenue"),
    ).withColumn("data_date", today).select(
        "data_date",
        "today_orders", "today_revenue",
        _label("mtd_orders", F.col("data_date")).alias("mtd_label"),
        "mtd_orders", "mtd_revenue",
        "prev_same_orders", "prev_same_revenue",
        _label("prev_full_orders", F.add_months("data_date", -1)).alias("prev_full_label"),
        "prev_full_orders", "prev_full_revenue",
    )


def _label(count: str, day: Column) -> Column:
    return F.when(F.col(count).isNotNull(), month_title(day))


def today_card(sales: DataFrame, today: Column) -> DataFrame:
    """Orders and revenue of the day; no row if it has no orders."""
    return _card(sales, between(sales, today, today), "today_orders", "today_revenue",
                 today.alias("data_date"))


def month_to_date_card(sales: DataFrame, today: Column) -> DataFrame:
    """Orders and revenue of the month so far; no row if it has no orders."""
    return _card(sales, between(sales, month_start(today), today), "mtd_orders", "mtd_revenue",
                 month_title(today).alias("month_label"))


def previous_same_day_card(sales: DataFrame, today: Column) -> DataFrame:
    """Orders and revenue of the previous month up to the same day; always one row."""
    rows = _last_month(sales, today).filter(_to_same_day())
    return rows.agg(order_count(sales).alias("prev_same_day_orders"),
                    revenue(sales).alias("prev_same_day_revenue"))


def previous_month_card(sales: DataFrame, today: Column) -> DataFrame:
    """Orders and revenue of the previous month; no row if it has no orders."""
    return _card(sales, _last_month(sales, today), "prev_month_orders", "prev_month_revenue",
                 month_title(F.add_months(today, -1)).alias("month_label"))


def _card(sales: DataFrame, rows: DataFrame, orders: str, money: str, label: Column) -> DataFrame:
    total = rows.agg(order_count(sales).alias(orders), revenue(sales).alias(money))
    return total.filter(F.col(orders) > 0).select(label, orders, money)


def leaderboard(sales: DataFrame, users: DataFrame, today: Column,
                target: int = MONTHLY_TARGET) -> DataFrame:
    """Sales representatives by orders of the month so far, best first.

    One aggregate per creator gives the day, the month and the previous month,
    and representatives are joined to its one row per creator. Those without
    an order this month are not listed. Ties are ranked by user id.
    """
    per_creator = (
        _two_months(sales, today).filter(F.col("created_by").isNotNull())
        .groupBy("created_by").agg(
            order_count(sales, _is_today()).alias("day_orders"),
            revenue_per_group(sales, _is_today()).alias("day_revenue"),
            order_count(sales, _this_month()).alias("mtd_orders"),
            revenue_per_group(sales, _this_month()).alias("mtd_revenue"),
            order_count(sales, _previous_month()).alias("prev_month_orders"))
        .filter(F.col("mtd_orders") > 0)
    )
    reps = users.filter(F.col("user_role") == SALES_REP).select(
        "user_id", F.trim("name").alias("sales_rep"))
    stats = per_creator.join(reps, F.col("created_by") == F.col("user_id"))
    orders, money = F.col("mtd_orders"), F.col("mtd_revenue")
    zero = F.lit(0).cast(TOTAL)
    return number_rows(stats, "mtd_orders", "user_id").select(
        "rank",
        "sales_rep",
        "day_orders",
        F.coalesce("day_revenue", zero).alias("day_revenue"),
        "mtd_orders",
        F.coalesce(money, zero).alias("mtd_revenue"),
        F.round(money / orders, 2).cast(TOTAL).alias("arpu"),
        F.lit(target).alias("target"),
        F.round((orders * 100).cast("decimal(20,0)") / F.lit(target), 0)
         .cast("decimal(20,0)").alias("target_pct"),
        "prev_month_orders",
    ).orderBy("rank")


def top_destinations(sales: DataFrame, products: DataFrame, destinations: DataFrame,
                     today: Column, limit: int | None = TOP_DESTINATIONS) -> DataFrame:
    """Most ordered destinations of the month so far; ties by name.
    ``limit=None`` lists all of them."""
    month = between(sales, month_start(today), today)
    ordered = orders_per_destination(month, products, destinations).orderBy(
        F.desc("order_count"), "destination_name")
    return ordered if limit is None else ordered.limit(limit)


def daily_trend(sales: DataFrame, today: Column) -> DataFrame:
    """Orders and revenue of today and the 60 days before; days without orders
    are left out."""
    days = (
        between(sales, F.date_sub(today, TREND_DAYS), today)
        .groupBy(_day().alias("date"))
        .agg(order_count(sales).alias("daily_orders"), revenue_per_group(sales).alias("daily_revenue"))
        .select("date", day_tick(F.col("date")).alias("date_label"), "daily_orders", "daily_revenue")
    )
    return _in_order(days, "date")


def monthly_trend(sales: DataFrame, today: Column) -> DataFrame:
    """Orders and revenue of twelve months, the last one up to today; months
    without orders are left out."""
    months = (
        between(sales, month_start(today, -TREND_MONTHS), today)
        .groupBy(month_start(_day()).alias("month_start"))
        .agg(order_count(sales).alias("monthly_orders"), revenue_per_group(sales).alias("monthly_revenue"))
        .select(month_tick(F.col("month_start")).alias("month_label"), "month_start",
                "monthly_orders", "monthly_revenue")
    )
    return _in_order(months, "month_start")


def _in_order(series: DataFrame, key: str) -> DataFrame:
    """Sorts a trend. It has at most 61 days or 12 months whatever the data, so
    its final rows go to one task, without the sampling job of a range sort."""
    return series.repartition(1).orderBy(key)
