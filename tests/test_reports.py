"""Report semantics on small tables, row by row. Each test runs over the orders
and over their rollup."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from daybook import Dashboard
from daybook.operators.anchor import as_of, last_day, last_day_in
from daybook.operators.sales import revenue, revenue_per_group
from daybook.plans import reports
from daybook.plans.book import rollup
from frames import dashboard, date, rows, sales


@pytest.fixture(params=["orders", "rollup"])
def over(request):
    return (lambda s: s) if request.param == "orders" else rollup


def summary(orders, day=None, **arguments):
    [row] = rows(Dashboard(orders).summary(day, **arguments))
    return row


def test_anchor(spark, over):
    s = over(sales(spark, ("2026-03-05", 1), ("2026-02-10", 1), (None, 1)))
    assert rows(last_day(s)) == [{"today": date("2026-03-05")}]
    assert rows(last_day_in(s, "2026-02")) == [{"today": date("2026-02-10")}]
    assert rows(last_day_in(s, "2026-04")) == [{"today": date("2026-04-30")}]
    assert rows(last_day(s.limit(0))) == [{"today": None}]


def test_date_and_month_exclude_each_other(spark):
    with pytest.raises(ValueError):
        as_of(sales(spark, ("2026-03-05", 1)), "2026-03-05", "2026-03")


@pytest.mark.parametrize("bad", ["", "tomorrow"])
def test_bad_date_is_refused_before_any_job(spark, bad):
    with pytest.raises(ValueError):
        Dashboard(sales(spark, ("2026-03-05", 1))).summary(bad)


def test_day_without_orders(spark, over):
    row = summary(over(sales(spark, ("2026-03-05", 1))), "2026-03-06")
    assert (row["today_orders"], row["today_revenue"]) == (0, None)
    assert (row["mtd_orders"], row["mtd_revenue"], row["mtd_label"]) == (1, Decimal("1.00"), "Mar 2026")


def test_nothing_at_all(spark, over):
    row = summary(over(sales(spark, ("2026-03-05", 1))), "2027-01-01")
    assert row == {
        "data_date": date("2027-01-01"), "today_orders": 0, "today_revenue": None,
        "mtd_label": None, "mtd_orders": None, "mtd_revenue": None,
        "prev_same_orders": 0, "prev_same_revenue": None,
        "prev_full_label": None, "prev_full_orders": None, "prev_full_revenue": None}


def test_empty_table(spark, over):
    empty = over(sales(spark, (None, 1)))
    row = summary(empty)
    assert row["data_date"] is None and row["today_orders"] == 0 and row["mtd_orders"] is None
    for day in (None, "2026-03-05"):
        board = dashboard(spark, empty, [(1, "Ann", 2)])
        assert rows(board.leaderboard(day)) == []
        assert rows(board.top_destinations(day)) == []
        assert rows(board.daily(day)) == rows(board.monthly(day)) == []


def test_all_four_cards(spark, over):
    s = over(sales(
        spark, ("2026-05-15", "10.10"), ("2026-05-15", "0.15"), ("2026-05-01", "2.00"),
        ("2026-05-16", 99), ("2026-04-15", 4), ("2026-04-16", 8), ("2026-04-01", 16),
        ("2026-03-31", 99), (None, 99)))
    assert summary(s, "2026-05-15") == {
        "data_date": date("2026-05-15"), "today_orders": 2, "today_revenue": Decimal("10.25"),
        "mtd_label": "May 2026", "mtd_orders": 3, "mtd_revenue": Decimal("12.25"),
        "prev_same_orders": 2, "prev_same_revenue": Decimal("20.00"),
        "prev_full_label": "Apr 2026", "prev_full_orders": 3, "prev_full_revenue": Decimal("28.00")}


def test_month_end_takes_a_shorter_month_whole(spark, over):
    row = summary(over(sales(spark, ("2026-02-28", 1), ("2026-02-01", 1), ("2026-03-01", 1))), "2026-03-31")
    assert row["prev_same_orders"] == row["prev_full_orders"] == 2


def test_february_takes_28_days_of_january(spark, over):
    row = summary(over(sales(spark, ("2026-01-28", 1), ("2026-01-29", 1))), "2026-02-28")
    assert (row["prev_same_orders"], row["prev_full_orders"]) == (1, 2)


def test_previous_month_of_january(spark, over):
    row = summary(over(sales(spark, ("2025-12-05", 1), ("2026-12-05", 1))), "2026-01-10")
    assert (row["prev_full_label"], row["prev_full_orders"]) == ("Dec 2025", 1)


def test_month_argument(spark, over):
    s = over(sales(spark, ("2026-02-10", 1), ("2026-03-05", 2)))
    assert summary(s, month="2026-02")["data_date"] == date("2026-02-10")
    assert summary(s, month="2026-04")["data_date"] == date("2026-04-30")


def test_single_cards(spark, over):
    s = over(sales(spark, ("2026-05-15", 1), ("2026-05-02", 2), ("2026-04-15", 4), ("2026-04-16", 8)))
    today = as_of(s)
    assert rows(reports.today_card(s, today)) == [
        {"data_date": date("2026-05-15"), "today_orders": 1, "today_revenue": Decimal("1.00")}]
    assert rows(reports.month_to_date_card(s, today)) == [
        {"month_label": "May 2026", "mtd_orders": 2, "mtd_revenue": Decimal("3.00")}]
    assert rows(reports.previous_same_day_card(s, today)) == [
        {"prev_same_day_orders": 1, "prev_same_day_revenue": Decimal("4.00")}]
    assert rows(reports.previous_month_card(s, today)) == [
        {"month_label": "Apr 2026", "prev_month_orders": 2, "prev_month_revenue": Decimal("12.00")}]


def test_single_cards_without_orders(spark, over):
    s = over(sales(spark, ("2026-05-15", 1)))
    today = as_of(s, "2027-01-01")
    assert rows(reports.today_card(s, today)) == []
    assert rows(reports.month_to_date_card(s, today)) == []
    assert rows(reports.previous_month_card(s, today)) == []
    assert rows(reports.previous_same_day_card(s, today)) == [
        {"prev_same_day_orders": 0, "prev_same_day_revenue": None}]


def test_leaderboard(spark, over):
    s = over(sales(
        spark,
        ("2026-05-15", 10, 1), ("2026-05-02", "5.01", 1), ("2026-04-30", 99, 1), ("2026-04-01", 99, 1),
        ("2026-05-15", 1, 2), ("2026-05-14", 1, 2),
        ("2026-05-15", 1, 3), ("2026-05-15", 1, 3), ("2026-05-16", 1, 3),
        ("2026-04-15", 1, 4), ("2026-05-15", 1, 5), ("2026-05-15", 1, None), ("2026-05-15", 1, 77)))
    people = [(3, "Cy", 2), (2, "Bo", 2), (1, "  Ann ", 2), (4, "Only April", 2), (5, "Customer", 1)]
    board = rows(dashboard(spark, s, people).leaderboard("2026-05-15", target=8))
    assert [(r["rank"], r["sales_rep"]) for r in board] == [(1, "Ann"), (2, "Bo"), (3, "Cy")]
    assert board[0] == {
        "rank": 1, "sales_rep": "Ann", "day_orders": 1, "day_revenue": Decimal("10.00"),
        "mtd_orders": 2, "mtd_revenue": Decimal("15.01"), "arpu": Decimal("7.51"),
        "target": 8, "target_pct": Decimal("25"), "prev_month_orders": 2}
    assert (board[1]["day_orders"], board[1]["prev_month_orders"]) == (1, 0)


def test_leaderboard_rounds_halves_up(spark, over):
    s = over(sales(spark, *[("2026-05-15", 0, 1)] * 3))
    [row] = rows(dashboard(spark, s, [(1, "Ann", 2)]).leaderboard("2026-05-15", target=40))
    assert row["target_pct"] == Decimal("8")  # 7.5


def test_representative_whose_amounts_are_all_null(spark, over):
    s = over(sales(spark, ("2026-05-15", None, 1)))
    [row] = rows(dashboard(spark, s, [(1, "Ann", 2)]).leaderboard("2026-05-15"))
    assert (row["day_revenue"], row["mtd_revenue"], row["arpu"]) == (0, 0, None)


COVERAGE = [(1, "SGP,MYS"), (2, " SGP ,MYS"), (3, "ZZZ"), (4, ",SGP"), (5, ""), (6, None), (7, "OLD"), (8, "TWN")]
PLACES = [("SGP", "Singapore"), ("OLD", "Atlantis", 0), ("TWN", "Atlantis")]


def test_destinations(spark, over):
    s = over(sales(spark, *[("2026-05-10", 1, 9, p) for p in (1, 2, 3, 4, 5, 6, 7, 8, 99, None)],
                   ("2026-05-16", 1, 9, 1), ("2026-04-30", 1, 9, 1)))
    got = rows(dashboard(spark, s, (), COVERAGE, PLACES).top_destinations("2026-05-15"))
    assert [(r["destination_name"], r["order_count"]) for r in got] == [
        ("Atlantis", 2), ("Singapore", 2), ("", 1), ("ZZZ", 1)]


def test_ten_destinations(spark, over):
    products = [(p, f"D{p:02}") for p in range(12)]
    s = over(sales(spark, *[("2026-05-10", 1, 9, p) for p in range(12)], ("2026-05-10", 1, 9, 11)))
    board = dashboard(spark, s, (), products, PLACES)
    top = [r["destination_name"] for r in rows(board.top_destinations("2026-05-15"))]
    assert top == ["D11"] + [f"D{p:02}" for p in range(9)]
    assert len(rows(board.top_destinations("2026-05-15", limit=None))) == 12


def test_daily_trend_reaches_sixty_days_back(spark, over):
    s = over(sales(spark, ("2026-03-31", 1), ("2026-03-31", 2), ("2026-01-30", 4), ("2026-01-29", 8),
                   ("2026-04-01", 16), (None, 32)))
    assert rows(Dashboard(s).daily("2026-03-31")) == [
        {"date": date("2026-01-30"), "date_label": "30/01", "daily_orders": 1, "daily_revenue": Decimal("4.00")},
        {"date": date("2026-03-31"), "date_label": "31/03", "daily_orders": 2, "daily_revenue": Decimal("3.00")}]


def test_monthly_trend_has_twelve_months(spark, over):
    s = over(sales(spark, ("2025-04-01", 1), ("2025-03-31", 2), ("2026-03-15", 4), ("2026-03-16", 8)))
    assert rows(Dashboard(s).monthly("2026-03-15")) == [
        {"month_label": "Apr '25", "month_start": date("2025-04-01"),
         "monthly_orders": 1, "monthly_revenue": Decimal("1.00")},
        {"month_label": "Mar '26", "month_start": date("2026-03-01"),
         "monthly_orders": 1, "monthly_revenue": Decimal("4.00")}]


def test_both_ways_to_sum_amounts_agree(spark):
    amounts = ["0.01", "-0.01", "-1.99", "99999999.99", "-99999999.99", "12345678.90", None, "0.99"] * 50
    s = sales(spark, *[(f"2026-03-{1 + i % 7:02}", a) for i, a in enumerate(amounts)], ("2026-03-30", None))
    late = F.dayofmonth("order_date") > 3
    for when in (None, late):
        assert [r for r in rows(s.groupBy("order_date").agg(
            revenue(s, when).alias("a"), revenue_per_group(s, when).alias("b"))) if r["a"] != r["b"]] == []
    assert s.agg(revenue(s).alias("r")).dtypes == s.agg(revenue_per_group(s).alias("r")).dtypes


def test_revenue_of_a_day_without_amounts_is_null(spark, over):
    s = over(sales(spark, ("2026-03-15", None)))
    assert rows(Dashboard(s).daily("2026-03-15"))[0]["daily_revenue"] is None
