"""Every named query against its SQL counterpart on the sample tables."""

import pytest

import __spark_entry__ as contract
from daybook.registry.oracles import oracle_sql
from daybook.registry.queries import queries
from oracle import TESTDATA, assert_same, database

FOLDER = f"{TESTDATA}/sf0.01"
# As of a day after all data there is nothing to report.
EMPTY = {"q1_today_empty"}


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_a_counterpart():
    assert queries().keys() == oracle_sql().keys()
    assert queries().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", queries())
def test_query(spark, con, name):
    rows = assert_same(contract.queries()[name](spark, FOLDER), con, contract.oracle_sql()[name])
    assert (rows == 0) == (name in EMPTY)


def test_other_session_settings(spark):
    """No adaptive execution, no broadcast, lenient casts, another time zone."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.ansi.enabled": "false", "spark.sql.session.timeZone": "America/Sao_Paulo"}
    small = f"{TESTDATA}/sf0.001"
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        with database(small) as con:
            for name in queries():
                if not name.startswith("csv_"):
                    assert_same(contract.queries()[name](spark, small), con, contract.oracle_sql()[name])
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
