"""Tables that change by version: whole before and after any failure, read as of one moment, keys known across months."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.plans.ledger import BUCKET, Ledger
from daybook.sinks import versions
from daybook.sinks.versions import Conflict, Store
from frames import rows

ORDERS = "order_no long, order_date date, user_id int, product_id long, amount decimal(18,2), discount_amount decimal(10,2), created_by int"


def orders(spark, *found):
    """(number, day, amount[, creator])"""
    return spark.createDataFrame(
        [(n, None if day is None else dt.date.fromisoformat(day), 1, n, Decimal(amount), None, by[0] if by else 7) for n, day, amount, *by in found], ORDERS)


def book(version, name="fact"):
    return sorted((r.order_no, str(r.order_date), int(r.amount)) for r in version.read(name).collect())


def measures(ledger, version):
    """Orders and revenue by each of the rollups and by the fact."""
    totals = [tuple(version.read(name).agg(F.sum("orders"), F.sum("revenue")).first()) for name in ("days", "creators", "products")]
    return {*totals, tuple(version.read("fact").agg(F.count(F.lit(1)), F.sum("amount")).first())}


@pytest.fixture
def ledger(spark, tmp_path):
    found = Ledger(spark, f"{tmp_path}/book", buckets=8)
    found.add(orders(spark, (1, "2026-01-05", 10), (2, "2026-02-01", 20), (3, None, 30)))
    return found


class Killed(BaseException):
    """As if the process ended: nothing catches it to clean up."""


def steps(monkeypatch, stop_at):
    """Counts the steps of a change, and stops before one of them."""
    taken = []

    def stepped(owner, name):
        real = getattr(owner, name)

        def step(*args):
            if len(taken) == stop_at:
                raise Killed
            taken.append(name)
            return real(*args)
        monkeypatch.setattr(owner, name, step)

    stepped(versions.Change, "_write")
    stepped(versions.Store, "_put")
    stepped(versions.Store, "_name")
    return taken


@pytest.mark.parametrize("stop_at", range(8))
def test_a_process_that_ends_between_any_two_steps(spark, ledger, monkeypatch, stop_at):
    old = book(ledger.at())
    with monkeypatch.context() as patch:
        taken = steps(patch, stop_at)
        try:
            ledger.add(orders(spark, (4, "2026-01-09", 40), (5, "2026-03-01", 50)))
        except Killed:
            pass
    whole = sorted([*old, (4, "2026-01-09", 40), (5, "2026-03-01", 50)])
    assert taken == ["_write"] * min(stop_at, 5) + ["_put"] * (stop_at > 5) + ["_name"] * (stop_at > 6)
    assert book(ledger.at()) == (whole if stop_at > 6 else old)
    assert len(measures(ledger, ledger.at())) == 1
    if stop_at not in (3, 6):
        return
    # The next change isn't hindered by what was left lying.
    ledger.add(orders(spark, (4, "2026-01-09", 40), (5, "2026-03-01", 50)))
    assert book(ledger.at()) == whole and len(measures(ledger, ledger.at())) == 1


def test_known_orders_under_other_months(spark, ledger):
    first = ledger.at()
    again = ledger.add(orders(spark, (1, "2026-02-11", 99), (1, "2026-02-10", 98), (3, "2026-02-01", 97), (4, "2026-02-02", 40), (4, "2026-03-02", 41)))
    assert book(again) == [(1, "2026-01-05", 10), (2, "2026-02-01", 20), (3, "None", 30), (4, "2026-02-02", 40)]
    assert measures(ledger, again) == {(4, Decimal(100))}
    assert ledger.add(orders(spark, (1, "2027-01-01", 1))).number == again.number
    assert ledger.add(orders(spark)).number == again.number
    assert book(ledger.at(first.number)) == book(first) == [(1, "2026-01-05", 10), (2, "2026-02-01", 20), (3, "None", 30)]


def test_corrections_count_once(spark, ledger):
    fixed = ledger.add(orders(spark, (1, "2026-02-11", 11), (3, "2026-02-01", 30), (9, "2026-04-01", 90)), correct=True)
    assert book(fixed) == [(1, "2026-02-11", 11), (2, "2026-02-01", 20), (3, "2026-02-01", 30), (9, "2026-04-01", 90)]
    assert measures(ledger, fixed) == {(4, Decimal(151))}
    assert fixed.values("fact") == ["2026-02-01", "2026-04-01"]
    known = {(r.order_no, str(r.order_month)) for r in fixed.read("keys").collect()}
    assert known == {(1, "2026-02-01"), (2, "2026-02-01"), (3, "2026-02-01"), (9, "2026-04-01")}
    assert book(ledger.add(orders(spark, (1, "2026-01-05", 10)))) == book(fixed)


def test_orders_without_a_number(spark, ledger):
    with pytest.raises(ValueError, match="1 orders without a number"):
        ledger.add(orders(spark, (None, "2026-01-01", 1), (8, "2026-01-01", 1)))
    assert len(book(ledger.at())) == 3


def test_only_the_batch_s_months_and_keys_are_read(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/book", buckets=64)
    ledger.add(orders(spark, *[(n, f"2026-{1 + n % 12:02d}-01", 1) for n in range(600)]))
    version, batch = ledger.at(), orders(spark, (12, "2026-05-01", 1))
    low, high, buckets, _ = ledger._extent(ledger._firsts(batch))
    assert len(buckets) == 1
    known = version.read("keys", buckets).filter(F.col("order_no").between(low, high))
    files = known.inputFiles()
    assert files and all(f"/{BUCKET}={buckets[0]}/" in f for f in files)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_no,12)" in plan and "LessThanOrEqual(order_no,12)" in plan
    # A correction opens the months it touches.
    files = version.read("fact", ["2026-01-01", "2026-05-01"]).inputFiles()
    assert {f.split("order_month=")[1][:10] for f in files} == {"2026-01-01", "2026-05-01"}


def test_reports_of_one_moment(spark, ledger):
    users = spark.createDataFrame([(7, "Ada", 2), (8, "Bo", 2)], "user_id int, name string, user_role int")
    page = ledger.dashboard(ledger.at(), users)
    before = rows(page.summary()), rows(page.daily())
    ledger.add(orders(spark, (4, "2026-03-01", 40), (5, "2026-02-01", 50, 8)))
    assert (rows(page.summary()), rows(page.daily())) == before
    assert rows(ledger.dashboard(ledger.at(), users).summary()) != before[0]


def test_repeated_batches_and_two_writers(spark, ledger):
    one = ledger.add(orders(spark, (4, "2026-03-01", 40)), source="till", number=0)
    assert ledger.add(orders(spark, (5, "2026-03-01", 50)), source="till", number=0).number == one.number
    change = ledger.store.change()
    ledger.add(orders(spark, (6, "2026-03-01", 60)), source="till", number=1)
    with pytest.raises(Conflict):
        change.commit()
    assert [r[0] for r in book(ledger.at())] == [1, 2, 3, 4, 6]


def test_a_stream_of_late_orders(spark, ledger, tmp_path):
    folder = f"{tmp_path}/late"
    for n in range(3):
        orders(spark, (10 + n, "2026-01-02", 1), (1, "2026-05-01", 1)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(ORDERS).option("maxFilesPerTrigger", 1).parquet(folder)
    ledger.follow(stream, "late", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert [r[0] for r in book(ledger.at())] == [1, 2, 3, 10, 11, 12] and ledger.at().done == {"late": 2}
    ledger.follow(stream, "late", f"{tmp_path}/other checkpoint").awaitTermination(120)  # all batches come again
    assert len(book(ledger.at())) == 6 and len(measures(ledger, ledger.at())) == 1


def test_compaction(spark, ledger):
    for n in range(4, 8):
        ledger.add(orders(spark, (n, "2026-01-05", n)))
    before, total = ledger.at(), measures(ledger, ledger.at())
    folded = ledger.compact(loads=5)
    assert before.read("creators", ["2026-01-01"]).count() == 5 and folded.read("creators", ["2026-01-01"]).count() == 1
    assert measures(ledger, folded) == total and len(total) == 1
    assert ledger.compact(loads=5).number == folded.number
    assert len(ledger.at().tables["fact"].parts) == 5


def test_vacuum_keeps_what_is_in_use(spark, ledger, tmp_path):
    ledger.add(orders(spark, (1, "2026-02-11", 11)), correct=True)
    last = ledger.at()
    orphan = f"{tmp_path}/book/data/fact/load=l9_dead"
    os.makedirs(orphan)
    ledger.store.vacuum(keep=1)
    assert os.path.exists(orphan)  # it may be a change in the making
    ledger.store.vacuum(keep=1, older_than=-1)
    assert not os.path.exists(orphan) and ledger.store.versions() == [last.number]
    assert book(ledger.at()) == book(last) and len(measures(ledger, last)) == 1


def test_widening_writes_no_data(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    change = store.change()
    change.replace("products", spark.createDataFrame([(1, "a")], "prod_id int, name string"))
    change.commit()
    files = sorted(os.listdir(f"{tmp_path}/data/products"))
    change = store.change()
    change.widen("products", T.StructType.fromDDL("prod_id long, name string, days int"))
    change.commit()
    assert sorted(os.listdir(f"{tmp_path}/data/products")) == files
    change = store.change()
    change.append("products", spark.createDataFrame([(1 << 40, "b", 5)], "prod_id long, name string, days int"))
    change.commit()
    found = store.at().read("products")
    assert found.dtypes == [("prod_id", "bigint"), ("name", "string"), ("days", "int")]
    assert sorted(map(tuple, found.collect())) == [(1, "a", None), (1 << 40, "b", 5)]
    assert store.at(1).read("products").dtypes == [("prod_id", "int"), ("name", "string")]
    with pytest.raises(ValueError, match="lose"):
        store.change().widen("products", T.StructType.fromDDL("prod_id long"))


def test_an_empty_store(spark, tmp_path):
    assert Store(spark, f"{tmp_path}/none").at().tables == {} and Store(spark, f"{tmp_path}/none").versions() == []
