"""The summary and the leaderboard said plainly: one aggregate per figure, months
told apart by their year and month numbers, figures put together afterwards.

Slower than the one-pass reports, and their check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.schemas import AMOUNT, TOTAL

DAY = "order_date"


def _same_month(day: Column) -> Column:
    return (F.year(DAY) == F.year(day)) & (F.month(DAY) == F.month(day))


def _figures(sales: DataFrame, *by: str) -> DataFrame:
    money = F.sum(F.col("amount").cast(AMOUNT)).cast(TOTAL)
    return sales.groupBy(*by).agg(F.count("*").alias("n"), money.alias("r"))


def _parts(sales: DataFrame, today: Column) -> dict[str, DataFrame]:
    before = F.add_months(today, -1)
    return {
        "day": sales.filter(F.col(DAY) == today),
        "mtd": sales.filter(_same_month(today) & (F.col(DAY) <= today)),
        "same": sales.filter(_same_month(before) & (F.dayofmonth(DAY) <= F.dayofmonth(today))),
        "full": sales.filter(_same_month(before)),
    }


def summary(sales: DataFrame, today: Column) -> DataFrame:
    cards = {name: _figures(part) for name, part in _parts(sales, today).items()}

    def figure(card: str, name: str) -> Column:
        return cards[card].select(name).scalar()

    def month_figures(card: str, prefix: str, day: Column) -> list[Column]:
        n = figure(card, "n")
        return [F.when(n > 0, F.date_format(day, "MMM yyyy")).alias(f"{prefix}_label"),
                F.when(n > 0, n).alias(f"{prefix}_orders"), figure(card, "r").alias(f"{prefix}_revenue")]

    return sales.sparkSession.range(1).select(
        today.alias("data_date"),
        figure("day", "n").alias("today_orders"), figure("day", "r").alias("today_revenue"),
        *month_figures("mtd", "mtd", today),
        figure("same", "n").alias("prev_same_orders"), figure("same", "r").alias("prev_same_revenue"),
        *month_figures("full", "prev_full", F.add_months(today, -1)))


def leaderboard(sales: DataFrame, users: DataFrame, today: Column, target: int = 125) -> DataFrame:
    joined = users.filter("user_role = 2").select("user_id", F.trim("name").alias("sales_rep"))
    parts = _parts(sales, today)
    for name in ("day", "mtd", "full"):
        figures = _figures(parts[name], "created_by").select(
            F.col("created_by").alias(name), F.col("n").alias(f"n_{name}"), F.col("r").alias(f"r_{name}"))
        joined = joined.join(figures, F.col("user_id") == F.col(name), "left")
    zero = F.lit(0).cast(TOTAL)
    rank = F.row_number().over(Window.orderBy(F.desc("n_mtd"), "user_id"))
    return joined.filter(F.coalesce("n_mtd", F.lit(0)) > 0).select(
        rank.cast("bigint").alias("rank"), "sales_rep",
        F.coalesce("n_day", F.lit(0)).alias("day_orders"), F.coalesce("r_day", zero).alias("day_revenue"),
        F.col("n_mtd").alias("mtd_orders"), F.coalesce("r_mtd", zero).alias("mtd_revenue"),
        F.round(F.col("r_mtd") / F.col("n_mtd"), 2).cast(TOTAL).alias("arpu"),
        F.lit(target).alias("target"),
        F.round((F.col("n_mtd") * 100).cast("decimal(20,0)") / target, 0).cast("decimal(20,0)").alias("target_pct"),
        F.coalesce("n_full", F.lit(0)).alias("prev_month_orders"))
