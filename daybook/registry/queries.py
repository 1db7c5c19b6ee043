"""Named queries over the sample tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import anchor, keyed
from daybook.plans import book, checks, display, reports
from daybook.plans.dashboard import Dashboard
from daybook.registry import changed, stored, versioned
from daybook.sources import sample

Query = Callable[[SparkSession, str], DataFrame]

#: A month's last day whose previous month is shorter, a day amid a month, and
#: a day after all data.
MONTH_END, MID_MONTH, AFTER_ALL = "1998-03-31", "1997-05-15", "2005-01-01"


def order_book(spark: SparkSession, folder: str, creators: bool = False) -> Dashboard:
    return Dashboard(sample.orders(spark, folder, creators), sample.users(spark, folder))


def line_book(spark: SparkSession, folder: str) -> Dashboard:
    return Dashboard(sample.lines(spark, folder), sample.suppliers(spark, folder),
                     sample.products(spark, folder), sample.destinations(spark, folder))


# ── Cleaning and checks ──────────────────────────────────────────────────────

def orders_parsed(spark: SparkSession, folder: str) -> DataFrame:
    return book.clean_orders(sample.orders_as_text(spark, folder)).select(
        "order_no", "order_date", "user_id", "amount")


def date_quality(spark: SparkSession, folder: str) -> DataFrame:
    return book.date_quality(sample.orders_as_text(spark, folder))


def unreadable_dates(spark: SparkSession, folder: str) -> DataFrame:
    return book.unreadable_dates(sample.orders_as_text(spark, folder)).select(
        "order_no", "order_date_time")


def load_check(spark: SparkSession, folder: str) -> DataFrame:
    orders = sample.orders_as_text(spark, folder)
    return checks.load_check({
        "users": sample.users(spark, folder),
        "products": sample.products(spark, folder),
        "destinations": sample.destinations(spark, folder),
    }, book.clean_orders(orders))


def primary_key_check(spark: SparkSession, folder: str) -> DataFrame:
    """The last table is no key: a line's order number repeats."""
    return checks.key_check({
        "users": (sample.users(spark, folder), "user_id"),
        "products": (sample.products(spark, folder), "prod_id"),
        "destinations": (sample.destinations(spark, folder), "destination_id"),
        "orders": (sample.orders(spark, folder), "order_no"),
        "lines": (sample.lines(spark, folder), "order_no"),
    })


def product_insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    """Stored rows are the suppliers; the batch names a customer per order, over
    and over, and the order with the lowest number wins."""
    stored_rows = sample.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    batch = sample.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label"),
        F.col("o_orderkey").alias("line"))
    fresh = keyed.insert_if_absent(keyed.first_per_key(batch, "id", ["line"]), stored_rows, "id")
    return stored_rows.unionByName(fresh)


# ── Anchors ──────────────────────────────────────────────────────────────────

def anchor_latest(spark: SparkSession, folder: str) -> DataFrame:
    return anchor.last_day(sample.orders(spark, folder))


def _anchor_month(month: str) -> Query:
    return lambda spark, folder: anchor.last_day_in(sample.orders(spark, folder), month)


# ── Reports ──────────────────────────────────────────────────────────────────

def _card(report: Callable, date: str | None = None) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        sales = sample.orders(spark, folder)
        return report(sales, anchor.as_of(sales, date))
    return run


def _orders(method: str, **arguments) -> Query:
    return lambda spark, folder: getattr(order_book(spark, folder), method)(**arguments)


def _creators(method: str, **arguments) -> Query:
    return lambda spark, folder: getattr(order_book(spark, folder, creators=True), method)(**arguments)


def _lines(method: str, **arguments) -> Query:
    return lambda spark, folder: getattr(line_book(spark, folder), method)(**arguments)


def _shown(form: Callable[[DataFrame], DataFrame], query: Query) -> Query:
    return lambda spark, folder: form(query(spark, folder))


# ── Rollup ───────────────────────────────────────────────────────────────────

def daily_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return book.rollup(sample.lines(spark, folder))


def _from_rollup(method: str, **arguments) -> Query:
    """A report over the rollup for its use instead of the lines it was made from."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        lines = line_book(spark, folder)
        days, creators, products = (book.rollup(lines.sales, keys) for keys in book.USES.values())
        rolled = Dashboard(days, lines.users, lines.products, lines.destinations, by_creator=creators, by_product=products)
        return getattr(rolled, method)(**arguments)
    return run


def queries() -> dict[str, Query]:
    return {
        "orders_parsed": orders_parsed,
        "date_quality": date_quality,
        "unreadable_dates": unreadable_dates,
        "load_check": load_check,
        "primary_key_check": primary_key_check,
        "product_insert_if_absent": product_insert_if_absent,
        "csv_load_users": stored.csv_load_users,
        "csv_load_products": stored.csv_load_products,
        "csv_load_destinations": stored.csv_load_destinations,
        "csv_load_orders": stored.csv_load_orders,
        "csv_insert_all_or_nothing": stored.csv_insert_all_or_nothing,
        "csv_insert_good_rows": stored.csv_insert_good_rows,
        "csv_quarantine": stored.csv_quarantine,
        "type_widening": stored.type_widening,
        "anchor_latest": anchor_latest,
        "anchor_month": _anchor_month("1998-03"),
        "anchor_month_empty": _anchor_month("2004-02"),
        "q1_today": _card(reports.today_card),
        "q2_mtd": _card(reports.month_to_date_card),
        "q3_prev_same_day": _card(reports.previous_same_day_card),
        "q4_prev_month": _card(reports.previous_month_card),
        "q1_today_empty": _card(reports.today_card, AFTER_ALL),
        "q3_prev_same_day_mid_month": _card(reports.previous_same_day_card, MID_MONTH),
        "summary_latest": _orders("summary"),
        "summary_month_end": _orders("summary", date=MONTH_END),
        "summary_mid_month": _orders("summary", date=MID_MONTH),
        "summary_empty": _orders("summary", date=AFTER_ALL),
        "summary_month": _orders("summary", month="1998-03"),
        "summary_month_empty": _orders("summary", month="2001-09"),
        "summary_stored_fact": stored.summary_stored_fact,
        "summary_stored_rollup": stored.summary_stored_rollup,
        "leaderboard_stored_rollup": stored.leaderboard_stored_rollup,
        "destinations_stored_rollup": stored.destinations_stored_rollup,
        "rollup_rows": stored.rollup_rows,
        "summary_rollup": _from_rollup("summary", date=MID_MONTH),
        "leaderboard_latest": _creators("leaderboard"),
        "leaderboard": _creators("leaderboard", date=MONTH_END),
        "leaderboard_target": _creators("leaderboard", date=MID_MONTH, target=8),
        "leaderboard_suppliers": _lines("leaderboard", date=MONTH_END),
        "leaderboard_blocks": stored.leaderboard_blocks,
        "leaderboard_rollup": _from_rollup("leaderboard", date=MONTH_END),
        "top_destinations_latest": _lines("top_destinations"),
        "top_destinations": _lines("top_destinations", date=MONTH_END),
        "all_destinations": _lines("top_destinations", date=MONTH_END, limit=None),
        "top_destinations_rollup": _from_rollup("top_destinations", date=MONTH_END),
        "daily_trend_latest": _orders("daily"),
        "daily_trend": _orders("daily", date=MONTH_END),
        "daily_trend_rollup": _from_rollup("daily", date=MONTH_END),
        "monthly_trend_latest": _orders("monthly"),
        "monthly_trend": _orders("monthly", date=MID_MONTH),
        "monthly_trend_rollup": _from_rollup("monthly", date=MID_MONTH),
        "daily_rollup": daily_rollup,
        "summary_display": _shown(display.summary_display, _orders("summary", date=MID_MONTH)),
        "summary_display_empty": _shown(display.summary_display, _orders("summary", date=AFTER_ALL)),
        "leaderboard_display": _shown(
            display.leaderboard_display, _creators("leaderboard", date=MONTH_END, target=8)),
        "destinations_display": _shown(
            display.destinations_display, _lines("top_destinations", date=MONTH_END)),
        "daily_chart": _shown(display.daily_chart, _orders("daily", date=MONTH_END)),
        "monthly_chart": _shown(display.monthly_chart, _orders("monthly", date=MID_MONTH)),
        "summary_json": _orders("summary_json", date=MID_MONTH),
        "summary_json_empty": _orders("summary_json", date=AFTER_ALL),
        "leaderboard_json": _creators("leaderboard_json", date=MONTH_END),
        "destinations_json": _lines("destinations_json", date=MONTH_END),
        "charts_json": _orders("charts_json", date=MONTH_END),
        "csv_export": stored.csv_export,
        **changed.queries(),
        **versioned.queries(),
    }
