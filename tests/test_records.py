"""Records of large CSV files: cut into blocks anywhere, they are those of a reader that passes over a file in one go."""

import random

import pytest
from pyspark.errors import PySparkException

from daybook.plans import loads
from daybook.schemas import DESTINATIONS, ORDERS, USERS
from daybook.sources import records
from daybook.sources.delimited import POSITION, REASON, RECORD, read_csv

SIZE, COST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


@pytest.fixture(params=[(48, 1 << 16), (400, 4)])
def small_blocks(request, spark, monkeypatch):
    """Splits of a few bytes, or blocks of a few lines in them."""
    size, lines = request.param
    monkeypatch.setattr(records, "_LINES", lines)
    before = {name: spark.conf.get(name) for name in (SIZE, COST)}
    spark.conf.set(SIZE, str(size))
    spark.conf.set(COST, "0")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def both(spark, path, table=USERS, **options):
    def read(by_blocks):
        df = read_csv(spark, path, table, by_blocks=by_blocks, **options)
        return [tuple(r[c] for c in [*table.names, REASON, RECORD]) for r in df.orderBy(*POSITION).collect()]
    return read(True), read(False)


def field(draw, quoted):
    text = "".join(draw.choices(["a", "b,", "\n", '"', "é", " ", ",\n", '",', '\n"', "long text "], k=draw.randint(0, 9)))
    return '"' + text.replace('"', '""') + '"' if quoted else text.replace(",", "").replace("\n", "").replace('"', "")


@pytest.mark.parametrize("seed", range(3))
def test_as_read_in_one_go(spark, tmp_path, small_blocks, seed):
    draw = random.Random(seed)
    for n in range(3):
        lines = [f"{n * 100 + i},{field(draw, draw.random() < 0.6)}\n" for i in range(40)]
        (tmp_path / f"{n}.csv").write_text("user_id,name\n" + "".join(lines) + "7,last", encoding="utf-8", newline="")
    got, want = both(spark, str(tmp_path))
    assert got == want and len(got) == 123


@pytest.mark.parametrize("text", [
    "user_id,name\n", "user_id,name", "\n\nuser_id,name\n\n1,Ann\n\n\n2,Bo", "﻿user_id,name\n1,Ann\n",
    'user_id,name\r\n1,"An\r\nn"\r\n2,Bo\r\n', 'user_id,name\n1,in"ch\n2,x"y"\n3,"z"\n', 'user_id,"name"\n"1","""\n"\n2,""\n3,\n',
    "user_id,name\n1,a,b\nx,y\n1\n", 'user_id,name\n1, "a\n2,b"\n', 'user_id,name\n1,"' + "line of the text\n" * 40 + '"\n2,"b"\n',
    'user_id,name\n1,"' + '""\n' * 40 + '"\n2,"b"\n', 'name,user_id\n"a\n",1\n'])
def test_awkward_files(spark, tmp_path, small_blocks, text):
    path = tmp_path / "one.csv"
    path.write_bytes(text.encode())
    got, want = both(spark, str(path))
    assert got == want


def test_columns_by_position(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('a,b,c,d,e,f\nSGP,1,"Sing\napore",,,1\n')
    got, want = both(spark, str(tmp_path), DESTINATIONS, header_names=False)
    assert got == want and got[0][:3] == ("SGP", 1, "Sing\napore")


def test_an_open_quote_is_refused(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('user_id,name\n1,"Ann\n' + "2,Bo\n" * 30)
    with pytest.raises(PySparkException, match="quotes are not closed"):
        read_csv(spark, str(tmp_path), USERS, by_blocks=True).collect()


def test_files_share_their_header(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("user_id,name\n1,Ann\n")
    for other in ("name,user_id\nBo,2\n", "user_id,name,age\n2,Bo,3\n"):
        (tmp_path / "b.csv").write_text(other)
        with pytest.raises(PySparkException, match="header does not conform"):
            read_csv(spark, str(tmp_path), USERS, by_blocks=True).collect()


def test_first_row_of_a_key_wins(spark, tmp_path, small_blocks):
    (tmp_path / "in.csv").write_text("order_no,order_date_time\n" + "".join(f'{i % 50},"{i}\n"\n' for i in range(400)))
    loads.insert_all_or_nothing(spark, str(tmp_path / "in.csv"), ORDERS, f"{tmp_path}/t", by_blocks=True)
    found = spark.read.parquet(f"{tmp_path}/t").select("order_no", "order_date_time").collect()
    assert sorted(map(tuple, found)) == [(i, f"{i}\n") for i in range(50)]


def test_many_tasks_read_one_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,name\n" + "".join(f'{i},"n\n{i}"\n' for i in range(20_000)))
    before = spark.conf.get(SIZE)
    spark.conf.set(SIZE, "16384")
    try:
        df = read_csv(spark, str(tmp_path), USERS, by_blocks=True)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert df.filter("name = concat('n\n', user_id)").count() == 20_000
        assert "CartesianProduct" not in plan and "Python" not in plan
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set(SIZE, before)
