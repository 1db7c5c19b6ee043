"""What Spark makes of the reports: scans, pushed filters, shuffles, broadcasts."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as contract
from daybook import Dashboard
from daybook.operators import ranking
from daybook.plans import book
from daybook.registry.queries import queries
from daybook.sources import sample
from oracle import TESTDATA

FOLDER = f"{TESTDATA}/sf0.01"
DAY = "1998-03-31"


@pytest.fixture(scope="module")
def fact_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("book") / "fact")
    book.write_fact(sample.lines(spark, FOLDER), path)
    return path


@pytest.fixture(scope="module")
def stored(spark, fact_path):
    return Dashboard.stored(spark, fact_path, sample.suppliers(spark, FOLDER), sample.products(spark, FOLDER),
                            sample.destinations(spark, FOLDER))


def plan(df) -> str:
    """The plan as executed, with its subqueries and what adaptive planning replaced."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def executed(text: str) -> list[str]:
    """The lines of a plan without what adaptive planning replaced."""
    kept, below = [], None
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if below is None or depth < below:
            below = depth if "== Initial Plan ==" in line else None
            kept.append(line)
    return kept


def fact_scans(text: str) -> list[str]:
    """The distinct scans of the stored fact; a plan may print one several times."""
    scans = {}
    for line in executed(text):
        scan = re.search(r"FileScan parquet .*?order_month#(\d+)", line)
        if scan:
            scans[scan.group(1)] = line
    return list(scans.values())


REPORTS = ["summary", "leaderboard", "top_destinations", "daily", "monthly"]


@pytest.mark.parametrize("report", REPORTS)
def test_one_pruned_scan_for_a_given_day(stored, report):
    text = plan(getattr(stored, report)(DAY))
    [scan] = fact_scans(text)
    assert re.search(r"PartitionFilters: \[[^\]]*order_month", scan)
    assert "GreaterThanOrEqual(order_date" in scan and "LessThanOrEqual(order_date,1998-03-31)" in scan


@pytest.mark.parametrize("report, columns", [
    ("summary", {"order_date", "amount"}), ("leaderboard", {"order_date", "amount", "created_by"}),
    ("top_destinations", {"order_date", "product_id"}), ("daily", {"order_date", "amount"})])
def test_only_needed_columns_are_read(stored, report, columns):
    [scan] = fact_scans(plan(getattr(stored, report)(DAY)))
    schema = re.search(r"ReadSchema: struct<(.*)>", scan).group(1)
    assert set(re.findall(r"(\w+):", schema)) == columns


@pytest.mark.parametrize("report", REPORTS)
def test_latest_day_is_found_once_and_prunes(stored, report):
    text = plan(getattr(stored, report)())
    scans = fact_scans(text)
    # The newest month's dates and the report itself.
    assert len(scans) == 2
    assert not any("PartitionFilters: []" in s for s in scans)


def test_latest_day_reads_the_newest_month_alone(spark, stored):
    from daybook.operators.anchor import last_day
    df = last_day(stored.sales, stored.newest)
    assert df.collect() == last_day(stored.sales).collect()
    emitted = []
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            nodes.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        if "Scan parquet" in node.nodeName():
            emitted.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    assert 0 < sum(emitted) <= stored.sales.filter(F.col("order_month") == F.lit(stored.newest)).count()


def test_a_given_month_prunes_its_anchor(stored):
    scans = fact_scans(plan(stored.summary(month="1998-03")))
    assert len(scans) == 2 and not any("PartitionFilters: []" in s for s in scans)


@pytest.mark.parametrize("name", queries())
def test_no_python_and_no_unbounded_cross_join(spark, name):
    df = contract.queries()[name](spark, FOLDER)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_raw_timestamps_are_filtered_in_the_scan(spark):
    text = plan(Dashboard(sample.orders(spark, FOLDER)).summary(DAY))
    assert "GreaterThanOrEqual(o_orderdate,1998-02-01" in text and "LessThan(o_orderdate,1998-04-01" in text


def test_ranks_alike_under_any_broadcast_threshold(spark, stored):
    single = r"Window \[row_number\(\) windowspecdefinition\(mtd_orders#\w+ DESC"
    assert not re.search(single, plan(stored.leaderboard(DAY)))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    small = [tuple(r) for r in stored.leaderboard(DAY).collect()]
    spark.conf.set(threshold, "-1")
    try:
        large = stored.leaderboard(DAY)
        text = plan(large).split("== Initial Plan ==")[0]
        assert not re.search(single, text) and "SortMergeJoin" in text and "Broadcast" not in text
        # Both branches of the ranking share the aggregate per representative.
        assert "ReusedExchange" in text
        assert [tuple(r) for r in large.collect()] == small
    finally:
        spark.conf.set(threshold, before)


@pytest.mark.parametrize("seed", range(4))
def test_block_ranks_equal_plain_ranks(spark, seed):
    """Ids on both sides of block borders, a third of all scores tied."""
    df = spark.sql(f"""
        SELECT cast(id * 4001 - 70000000 AS int) AS id,
               CASE WHEN hash(id, {seed}) % 3 = 0 THEN 1 ELSE abs(hash(id, {seed}, 1)) % 50 END AS score
        FROM range(40000)""")
    plain = df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint"))
    blocks = ranking.number_rows(df, "score", "id")
    assert blocks.columns == plain.columns
    assert plain.exceptAll(blocks).isEmpty() and blocks.exceptAll(plain).isEmpty()


def test_same_rows_for_any_number_of_tasks(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    names = ["leaderboard_suppliers", "all_destinations", "leaderboard_blocks",
             "summary_latest", "daily_rollup", "product_insert_if_absent"]
    seen = []
    try:
        for tasks in ("1", "4", "200"):
            spark.conf.set(key, tasks)
            seen.append({n: sorted(map(str, contract.queries()[n](spark, FOLDER).collect())) for n in names})
    finally:
        spark.conf.set(key, before)
    assert seen[0] == seen[1] == seen[2]


@pytest.fixture
def hot(spark):
    """One month holds most rows, and many have no date."""
    return spark.sql("""
        SELECT id AS order_no, CASE WHEN id % 5 <> 0 THEN date_add(date'2026-01-01',
                 cast(CASE WHEN id % 10 = 1 THEN id % 300 ELSE id % 28 END AS int)) END AS order_date, uuid() AS note
        FROM range(0, 200000, 1, 8)""")


def test_hot_months_are_spread_without_adaptive_execution(spark, hot, tmp_path):
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        book.write_fact(hot, f"{tmp_path}/fact")
    finally:
        spark.conf.set(key, before)
    for name in ("2026-01-01", "__HIVE_DEFAULT_PARTITION__"):
        assert len(list((tmp_path / "fact" / f"order_month={name}").glob("*.parquet"))) > 4


def test_a_hot_month_is_written_by_many_tasks(spark, hot, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "256k")
    try:
        book.write_fact(hot, f"{tmp_path}/fact")
    finally:
        spark.conf.set(key, before)
    files = list((tmp_path / "fact" / "order_month=2026-01-01").glob("*.parquet"))
    assert len(files) > 4
    assert spark.read.parquet(f"{tmp_path}/fact").count() == 200000
