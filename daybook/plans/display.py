"""Reports as display rows: every value a text, ready to be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions import display as d


# What is shown after amounts and where a label is missing.
REVENUE_SUFFIX = " Revenue"
NO_MONTH, NO_PREVIOUS_MONTH = "MTD", "Prev Month"


def summary_display(summary: DataFrame) -> DataFrame:
    def count(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("0")).alias(name)

    def money(name: str) -> Column:
        return F.concat(d.rupees(F.col(name)), F.lit(REVENUE_SUFFIX)).alias(name)

    def label(name: str, default: str) -> Column:
        return F.upper(d.or_default(F.col(name), default)).alias(name)

    return summary.select(
        d.long_date(F.col("data_date")).alias("data_date"),
        count("today_orders"), money("today_revenue"),
        label("mtd_label", NO_MONTH), count("mtd_orders"), money("mtd_revenue"),
        count("prev_same_orders"), money("prev_same_revenue"),
        label("prev_full_label", NO_PREVIOUS_MONTH), count("prev_full_orders"), money("prev_full_revenue"),
    )


def leaderboard_display(leaderboard: DataFrame) -> DataFrame:
    """The day's revenue shows only if there is some; the progress bar stays
    between 0 and 100 percent of its width, the percentage itself does not."""
    day_revenue, pct = F.col("day_revenue"), F.coalesce("target_pct", F.lit(0))
    return leaderboard.select(
        F.col("rank").cast("string").alias("rank"),
        "sales_rep",
        F.col("day_orders").cast("string").alias("day_orders"),
        F.when(day_revenue > 0, d.rupees_in_thousands(day_revenue)).otherwise("").alias("day_revenue"),
        F.col("mtd_orders").cast("string").alias("mtd_orders"),
        d.rupees(F.col("mtd_revenue")).alias("mtd_revenue"),
        d.whole_rupees(F.col("arpu")).alias("arpu"),
        d.percent(pct).alias("target_pct"),
        d.clamp(pct, F.lit(0), F.lit(100)).cast("int").alias("bar_width"),
        F.col("target").cast("string").alias("target"),
        F.col("prev_month_orders").cast("string").alias("prev_month_orders"),
    )


def destinations_display(destinations: DataFrame) -> DataFrame:
    return destinations.select(
        F.col("destination_name").alias("name"), F.col("order_count").cast("string").alias("badge"))


def daily_chart(daily: DataFrame) -> DataFrame:
    return daily.select("date", F.col("date_label").alias("label"), F.col("daily_orders").alias("orders"))


def monthly_chart(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        "month_start", F.col("month_label").alias("label"), F.col("monthly_orders").alias("orders"))
