"""JSON arrays of any length, stored as ordered parts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from daybook.sinks import json_rows
from daybook.sinks.json_rows import array_bytes, array_rows, write_array
from frames import dashboard, sales


def text(spark, path) -> str:
    return b"".join(array_bytes(spark, path)).decode()


@pytest.fixture
def numbers(spark):
    """A third of the rows share a key; texts with whatever JSON and line readers take for an end."""
    return spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") * 7919 % 5003).alias("key"), "id",
        F.when(F.col("id") % 2 == 0, F.lit('],[{"\n\r,\u2028ü')).alias("note"))


@pytest.mark.parametrize("settings", [
    {}, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "13"},
    {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k"},
    {"spark.sql.files.maxRecordsPerFile": "100"}])
def test_the_parts_make_one_array_in_order(spark, numbers, tmp_path, settings):
    before = {key: spark.conf.get(key) for key in settings}
    path = f"{tmp_path}/array"
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        write_array(numbers, path, [F.desc("key"), F.col("id")])
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    expected = [r.asDict() for r in sorted(numbers.collect(), key=lambda r: (-r.key, r.id))]
    assert json.loads(text(spark, path)) == expected
    assert sorted((json.loads(r.json)["id"] for r in array_rows(spark, path).collect())) == list(range(5000))
    if settings.get("spark.sql.adaptive.enabled") == "false":
        assert sum(name.startswith("part-") and not name.endswith("~") for name in os.listdir(path)) > 5


@pytest.mark.parametrize("rows", [0, 1])
def test_short_arrays(spark, numbers, tmp_path, rows):
    write_array(numbers.filter(F.col("id") < rows), f"{tmp_path}/array", [F.col("id")])
    assert len(json.loads(text(spark, f"{tmp_path}/array"))) == rows
    assert array_rows(spark, f"{tmp_path}/array").count() == rows


def test_a_path_that_is_taken_stays_as_it_was(spark, numbers, tmp_path):
    write_array(numbers.filter("id < 3"), f"{tmp_path}/array", [F.col("id")])
    with pytest.raises(FileExistsError):
        write_array(numbers, f"{tmp_path}/array", [F.col("id")])
    assert len(json.loads(text(spark, f"{tmp_path}/array"))) == 3


def test_a_failing_job_leaves_nothing(spark, numbers, tmp_path):
    bad = numbers.withColumn("note", F.when(F.col("id") == 4999, F.raise_error(F.lit("bad row"))).otherwise("x"))
    with pytest.raises(Exception, match="bad row"):
        write_array(bad, f"{tmp_path}/array", [F.col("id")])
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("step", range(4))
def test_a_writer_that_stops_between_steps_shows_nothing(spark, numbers, tmp_path, monkeypatch, step):
    """A killed process runs no handler: KeyboardInterrupt stands for it."""
    done = []

    def stop(*args):
        raise KeyboardInterrupt

    real = json_rows.put
    monkeypatch.setattr(json_rows, "put", lambda *args: stop() if len(done) == step else (done.append(1), real(*args)))
    if step == 3:
        monkeypatch.setattr(json_rows, "_rename", stop)
        monkeypatch.setattr(json_rows, "put", real)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several parts
    try:
        with pytest.raises(KeyboardInterrupt):
            write_array(numbers, f"{tmp_path}/array", [F.col("id")])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert not os.path.exists(f"{tmp_path}/array")
    monkeypatch.undo()
    write_array(numbers, f"{tmp_path}/array", [F.col("id")])
    assert len(json.loads(text(spark, f"{tmp_path}/array"))) == 5000


def test_a_long_array_is_passed_on_in_pieces(spark, numbers, tmp_path, monkeypatch):
    write_array(numbers, f"{tmp_path}/array", [F.col("id")])
    monkeypatch.setattr(json_rows, "CHUNK", 1000)
    pieces = list(array_bytes(spark, f"{tmp_path}/array"))
    assert max(map(len, pieces)) == 1000 and len(json.loads(b"".join(pieces))) == 5000


def test_leaderboard(spark, tmp_path):
    people = [(n, f"rep {n}", 2) for n in range(1, 6)]
    board = dashboard(spark, sales(spark, *[("2026-03-02", 5, n) for n in (1, 2, 2, 4)]), people)
    board.write_leaderboard(f"{tmp_path}/array", "2026-03-31")
    found = json.loads(text(spark, f"{tmp_path}/array"))
    assert [(r["rank"], r["sales_rep"], r["mtd_orders"]) for r in found] == [(1, "rep 2", 2), (2, "rep 1", 1), (3, "rep 4", 1)]
