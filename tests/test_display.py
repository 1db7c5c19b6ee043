"""Display texts and JSON."""

import json

import pytest
from pyspark.sql import functions as F

from daybook import Dashboard
from daybook.functions import display as d
from daybook.functions.text import empty_to_null, members, primary_member
from daybook.plans.display import leaderboard_display, summary_display
from daybook.sinks.files import write_csv
from daybook.sinks.json_rows import first_object, json_rows, write_json
from frames import dashboard, rows, sales


def shown(spark, form, value):
    return spark.range(1).select(form(F.lit(value).cast("decimal(28,2)")).alias("x")).first().x


@pytest.mark.parametrize("amount, text", [
    (None, "₹0"), ("0", "₹0"), ("0.49", "₹0"), ("0.50", "₹1"), ("999.49", "₹999"), ("999.50", "₹1000"),
    ("1000", "₹1.00K"), ("1234.50", "₹1.23K"), ("99999.99", "₹100.00K"),
    ("100000", "₹1.00L"), ("1234567.89", "₹12.35L"), ("-0.40", "₹0"), ("-1500.50", "₹-1500"),
])
def test_rupees(spark, amount, text):
    assert shown(spark, d.rupees, amount) == text


@pytest.mark.parametrize("amount, text", [("12345", "₹12.3"), ("50", "₹0.1"), ("49.99", "₹0.0")])
def test_thousands(spark, amount, text):
    assert shown(spark, d.rupees_in_thousands, amount) == text


def test_dates_and_defaults(spark):
    row = spark.sql("SELECT date'2026-01-05' a, cast(null as date) b, cast(null as string) c, '' e").select(
        d.long_date(F.col("a")), d.long_date(F.col("b")),
        d.or_default(F.col("c"), "MTD"), d.or_default(F.col("e"), "MTD")).first()
    assert tuple(row) == ("05 Jan 2026", "—", "MTD", "MTD")


def test_summary_display(spark):
    s = sales(spark, ("2026-05-15", 150000), ("2026-04-16", 1500))
    [row] = rows(summary_display(Dashboard(s).summary("2026-05-15")))
    assert row == {
        "data_date": "15 May 2026", "today_orders": "1", "today_revenue": "₹1.50L Revenue",
        "mtd_label": "MAY 2026", "mtd_orders": "1", "mtd_revenue": "₹1.50L Revenue",
        "prev_same_orders": "0", "prev_same_revenue": "₹0 Revenue",
        "prev_full_label": "APR 2026", "prev_full_orders": "1", "prev_full_revenue": "₹1.50K Revenue"}
    [row] = rows(summary_display(Dashboard(s).summary("2030-01-01")))
    assert (row["mtd_label"], row["prev_full_label"], row["mtd_orders"]) == ("MTD", "PREV MONTH", "0")


def test_leaderboard_display(spark):
    s = sales(spark, ("2026-05-15", 1500, 1), ("2026-05-14", 1, 1), ("2026-05-14", None, 2))
    board = dashboard(spark, s, [(1, "Ann", 2), (2, "Bo", 2)]).leaderboard("2026-05-15", target=1)
    ann, bo = rows(leaderboard_display(board))
    assert ann == {"rank": "1", "sales_rep": "Ann", "day_orders": "1", "day_revenue": "₹1.5",
                   "mtd_orders": "2", "mtd_revenue": "₹1.50K", "arpu": "₹751", "target_pct": "200%",
                   "bar_width": 100, "target": "1", "prev_month_orders": "0"}
    assert (bo["day_revenue"], bo["arpu"], bo["bar_width"]) == ("", "₹0", 100)


def test_json_keeps_nulls_and_scale(spark):
    s = sales(spark, ("2026-05-15", "1.50"))
    [line] = rows(Dashboard(s).summary_json("2026-05-15"))
    assert json.loads(line["json"]) == {
        "data_date": "2026-05-15", "today_orders": 1, "today_revenue": 1.5,
        "mtd_label": "May 2026", "mtd_orders": 1, "mtd_revenue": 1.5,
        "prev_same_orders": 0, "prev_same_revenue": None,
        "prev_full_label": None, "prev_full_orders": None, "prev_full_revenue": None}


def test_first_object_of_nothing(spark):
    empty = spark.range(0).select("id")
    assert rows(first_object(empty)) == [{"json": "{}"}]
    assert rows(json_rows(empty)) == []


def test_charts_object(spark):
    s = sales(spark, ("2026-05-15", 1), ("2026-04-01", 2), ("2026-05-02", 4))
    [line] = rows(Dashboard(s).charts_json("2026-05-15"))
    charts = json.loads(line["json"])
    assert [r["date"] for r in charts["daily"]] == ["2026-04-01", "2026-05-02", "2026-05-15"]
    assert charts["monthly"][1] == {"month_label": "May '26", "month_start": "2026-05-01",
                                    "monthly_orders": 2, "monthly_revenue": 5}
    [line] = rows(Dashboard(s).charts_json("2030-01-01"))
    assert json.loads(line["json"]) == {"daily": [], "monthly": []}


def test_files(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, cast(null as string) AS b, ' x \"y\",\n' AS c")
    write_json(df, f"{tmp_path}/json")
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/json").collect()] == [
        {"a": 1, "b": None, "c": ' x "y",\n'}]
    write_csv(df, f"{tmp_path}/csv")
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert rows(read) == [{"a": "1", "b": None, "c": ' x "y",\n'}]


def test_lists(spark):
    row = spark.sql("SELECT 'ALB , AND , UZB\n' AS s, '' AS e").select(
        primary_member(F.col("s")), members(F.col("s")), empty_to_null(F.col("e"))).first()
    assert tuple(row) == ("ALB", ["ALB", "AND", "UZB"], None)
