"""One-pass reports against SQL, and against the plain form of the same reports,
at arbitrary days, over orders and their rollup."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import naive
from daybook import Dashboard
from daybook.operators.anchor import as_of
from daybook.plans.book import rollup
from daybook.registry import oracles
from daybook.sources import sample
from oracle import TESTDATA, assert_same, database

FOLDER = f"{TESTDATA}/sf0.001"
# From before the first order to after the last one, month ends among them.
DAYS = st.one_of(
    st.dates(dt.date(1994, 11, 1), dt.date(2002, 2, 1)),
    st.sampled_from([dt.date(1996, 2, 29), dt.date(1997, 2, 28), dt.date(1995, 1, 20),
                     dt.date(2000, 1, 31), dt.date(2001, 9, 3), dt.date(1998, 12, 31)]))
RUNS = settings(max_examples=6, deadline=None, derandomize=True,
                suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.fixture(scope="module")
def lines(spark):
    return Dashboard(sample.lines(spark, FOLDER).cache(), sample.suppliers(spark, FOLDER),
                     sample.products(spark, FOLDER), sample.destinations(spark, FOLDER))


@RUNS
@given(day=DAYS)
def test_orders(spark, con, day):
    anchor = oracles.day(day.isoformat())
    orders = Dashboard(sample.orders(spark, FOLDER, creators=True), sample.users(spark, FOLDER))
    assert_same(orders.summary(day), con, oracles.summary(oracles.ORDER_BOOK, anchor))
    assert_same(orders.leaderboard(day), con, oracles.leaderboard(oracles.ORDER_BOOK, anchor))


@RUNS
@given(day=DAYS, rolled=st.booleans())
def test_lines(spark, con, lines, day, rolled):
    anchor, name = oracles.day(day.isoformat()), oracles.LINE_BOOK
    sales = rollup(lines.sales) if rolled else lines.sales
    board = Dashboard(sales, lines.users, lines.products, lines.destinations)
    assert_same(board.summary(day), con, oracles.summary(name, anchor))
    assert_same(board.leaderboard(day, target=3), con, oracles.leaderboard(name, anchor, 3))
    assert_same(board.top_destinations(day), con, oracles.destinations(anchor))
    assert_same(board.daily(day), con, oracles.daily(name, anchor))
    assert_same(board.monthly(day), con, oracles.monthly(name, anchor))


@RUNS
@given(day=st.one_of(st.none(), DAYS))
def test_plain_form(lines, day):
    today = as_of(lines.sales, day)
    assert lines.summary(day).collect() == naive.summary(lines.sales, today).collect()
    assert lines.leaderboard(day).collect() == sorted(
        naive.leaderboard(lines.sales, lines.users, today).collect())


def test_hot_keys(spark, lines):
    """A third of all orders by one creator, of one product, in one month."""
    hot = F.xxhash64("order_no", "product_id") % 3 == 0
    skewed = lines.sales.select(
        "order_no", "amount",
        F.when(hot, F.lit(dt.date(1998, 3, 9))).otherwise(F.col("order_date")).alias("order_date"),
        F.when(hot, F.lit(7)).otherwise(F.col("product_id")).alias("product_id"),
        F.when(hot, F.lit(3)).otherwise(F.col("created_by")).alias("created_by"))
    today = as_of(skewed, "1998-03-31")
    plain = naive.summary(skewed, today).collect()
    ranks = sorted(naive.leaderboard(skewed, lines.users, today).collect())
    counts = skewed.filter("order_date >= '1998-03-01' AND order_date <= '1998-03-31'").join(
        lines.products, F.col("product_id") == F.col("prod_id")).groupBy("coverage_destinations").count()
    for sales in (skewed, rollup(skewed)):
        board = Dashboard(sales, lines.users, lines.products, lines.destinations)
        assert board.summary("1998-03-31").collect() == plain
        assert board.leaderboard("1998-03-31").collect() == ranks
        found = board.top_destinations("1998-03-31", limit=None).agg(F.sum("order_count")).first()[0]
        assert found == counts.agg(F.sum("count")).first()[0]
