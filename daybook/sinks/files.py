"""CSV export and replacement of stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: how Spark names the partition of rows without a value.
EMPTY_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def write_csv(df: DataFrame, path: str) -> None:
    """With quotes doubled and blanks kept, as other CSV readers expect."""
    (df.write.option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path, mode="error"))


def replace_table(df: DataFrame, path: str, partition_by: str | None = None,
                  check=None) -> None:
    """Writes ``df`` beside ``path`` and swaps it in once it is whole.

    An overwrite deletes first and loses the table if the job then fails. Here
    a failed write, or a ``check`` of the written rows that raises, leaves the
    table at ``path`` as it was.
    """
    spark = df.sparkSession
    staging = sibling(path, "staging")
    try:
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(staging)
        if check is not None:
            check(spark.read.parquet(staging))
    except Exception:
        delete(spark, staging)
        raise
    swap(spark, staging, path)


def sibling(path: str, label: str) -> str:
    return f"{path.rstrip('/')}__{label}_{uuid.uuid4().hex}"


def hidden(path: str, label: str) -> str:
    """A path beside ``path`` that readers of the folder around it pass over."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_{name.replace('=', '_')}__{label}_{uuid.uuid4().hex}"


def swap(spark: SparkSession, staging: str, path: str) -> None:
    """Renames ``staging`` to ``path``; what was there is deleted last, and put back if that fails.

    A reader that comes between the two renames finds no table. On a store where a
    rename copies, write versions and point a catalog's table at the new one instead.
    """
    publish(spark, {path: staging})


def publish(spark: SparkSession, folders: dict[str, str | None]) -> None:
    """Puts new folders in the place of old ones: ``{path: staged}``, ``None`` for none.

    The old ones are moved aside first and deleted when all new ones are in place.
    If a rename fails, the old ones are put back and the new ones are left out.
    """
    aside: dict[str, str] = {}
    placed: list[str] = []
    try:
        for path in folders:
            if exists(spark, path):
                aside[path] = hidden(path, "old")
                _rename(spark, path, aside[path])
        for path, staged in folders.items():
            if staged is not None:
                _rename(spark, staged, path)
                placed.append(path)
    except Exception:
        for path in placed:
            delete(spark, path)
        for path, old in aside.items():
            if exists(spark, old):
                _rename(spark, old, path)
        raise
    for old in aside.values():
        delete(spark, old)


def replace_partitions(df: DataFrame, path: str, partition_by: str, values: Sequence[str | None]) -> None:
    """Replaces some partitions of a stored table by the rows of ``df``, all of which fall
    in them. A partition without rows goes; the others of the table are not touched.

    Rows are written aside, so a failing job changes nothing.
    """
    spark = df.sparkSession
    staging = sibling(path, "staging")
    try:
        df.write.partitionBy(partition_by).parquet(staging)
        names = [f"{partition_by}={EMPTY_PARTITION if value is None else value}" for value in values]
        publish(spark, {f"{path.rstrip('/')}/{name}": staged if exists(spark, staged := f"{staging}/{name}") else None for name in names})
    finally:
        delete(spark, staging)


def partitions(spark: SparkSession, path: str, partition_by: str) -> list[str | None]:
    """The values of a stored table's partitions, from a listing of its folder."""
    fs, folder = _file_system(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(folder) if status.isDirectory()]
    values = [name.partition("=")[2] for name in names if name.startswith(f"{partition_by}=")]
    return [None if value == EMPTY_PARTITION else value for value in values]


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def file_names(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names and sizes of the files in ``folder``, in the order of the names' bytes."""
    fs, target = _file_system(spark, folder)
    return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(target) if s.isFile())


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A new small file."""
    fs, target = _file_system(spark, path)
    stream = fs.create(target, False)
    try:
        stream.write(content)
    finally:
        stream.close()


def open_bytes(spark: SparkSession, path: str, chunk: int) -> Iterator[bytes]:
    """The content of a file, at most ``chunk`` bytes at a time."""
    fs, target = _file_system(spark, path)
    stream = fs.open(target)
    try:
        while piece := bytes(stream.readNBytes(chunk)):
            yield piece
    finally:
        stream.close()


def _rename(spark: SparkSession, source: str, target: str) -> None:
    fs, source_path = _file_system(spark, source)
    if not fs.rename(source_path, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not rename {source} to {target}")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target
