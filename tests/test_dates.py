"""Order dates as spelled in the files, and dates given by callers."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from daybook.functions.dates import as_date, as_month, month_start, month_tick, month_title, day_tick
from daybook.plans.book import clean_orders, date_quality, register_views, unreadable_dates

READ = {
    "01-01-2026": "2026-01-01",
    "01/13/2026 03:48:47": "2026-01-13",
    "01/13/2026": "2026-01-13",
    "01/13/2026 03:48:47 xx": "2026-01-13",
    "02/29/2024": "2024-02-29",
}
NO_SUCH_DAY = ["13-45-2026", "02/30/2026 01:02:03", "02-29-2026"]
UNKNOWN = ["1/3/2026", "2026-01-13", "01-01-2026 10:00:00", "01-01-2026\n", " 01-01-2026",
           "01.01.2026", "x01/13/2026"]
MISSING = ["", None]


def orders(spark, texts):
    return spark.createDataFrame(
        [(i, t, None, None, None, None, None) for i, t in enumerate(texts)],
        "order_no long, order_date_time string, user_id int, product_id int, "
        "amount decimal(10,2), discount_amount decimal(10,2), created_by int")


def test_both_spellings_are_read(spark):
    got = [r.order_date for r in clean_orders(orders(spark, READ)).orderBy("order_no").collect()]
    assert got == [dt.date.fromisoformat(d) for d in READ.values()]


def test_anything_else_is_null(spark):
    df = clean_orders(orders(spark, NO_SUCH_DAY + UNKNOWN + MISSING))
    assert [r.order_date for r in df.collect()] == [None] * df.count()


@pytest.mark.parametrize("text", NO_SUCH_DAY)
def test_strict_stops_at_a_day_that_is_none(spark, text):
    with pytest.raises(PySparkException, match="no such order date"):
        clean_orders(orders(spark, [text]), strict=True).collect()


def test_strict_accepts_the_rest(spark):
    df = clean_orders(orders(spark, [*READ, *UNKNOWN, *MISSING]), strict=True)
    assert df.filter("order_date IS NOT NULL").count() == len(READ)


def test_quality_counts(spark):
    df = orders(spark, [*READ, *NO_SUCH_DAY, *UNKNOWN, *MISSING])
    assert {r.date_state: r.rows for r in date_quality(df).collect()} == {
        "parsed": len(READ), "no such day": len(NO_SUCH_DAY),
        "unknown spelling": len(UNKNOWN), "missing": len(MISSING)}
    assert unreadable_dates(df).count() == len(NO_SUCH_DAY) + len(UNKNOWN) + len(MISSING)


def test_views_for_sql_text(spark):
    register_views(orders(spark, [*READ, *UNKNOWN]), users=spark.createDataFrame([(1, "Ann")], "user_id int, name string"))
    counts = spark.sql("""
        SELECT count(*) AS orders, count(order_date) AS dated, max(order_date) AS latest,
               (SELECT count(*) FROM users) AS users
        FROM orders_parsed WHERE order_no >= :low""", args={"low": 0}).first()
    assert tuple(counts) == (len(READ) + len(UNKNOWN), len(READ), dt.date(2026, 1, 13), 1)


def test_month_arithmetic_and_labels(spark):
    day = F.lit(dt.date(2026, 3, 31))
    row = spark.range(1).select(
        month_start(day).alias("a"), month_start(day, -1).alias("b"), month_start(day, -11).alias("c"),
        F.add_months(day, -1).alias("d"), month_title(day).alias("e"), month_tick(day).alias("f"),
        day_tick(day).alias("g")).first()
    assert tuple(row) == (dt.date(2026, 3, 1), dt.date(2026, 2, 1), dt.date(2025, 4, 1),
                          dt.date(2026, 2, 28), "Mar 2026", "Mar '26", "31/03")


def test_given_dates():
    assert as_date("2026-01-13") == as_date(dt.date(2026, 1, 13)) == dt.date(2026, 1, 13)
    assert as_date(dt.datetime(2026, 1, 13, 5)) == dt.date(2026, 1, 13)
    assert as_month("2026-02") == dt.date(2026, 2, 1)


@pytest.mark.parametrize("text", ["", "13/01/2026", "2026-02-30", "yesterday"])
def test_a_text_that_is_no_date_is_refused(text):
    with pytest.raises(ValueError):
        as_date(text)


@pytest.mark.parametrize("text", ["", "2026-13", "2026-1", "01-2026"])
def test_a_text_that_is_no_month_is_refused(text):
    with pytest.raises(ValueError):
        as_month(text)
