"""Reports as JSON. NULL fields are kept as ``null``; decimals are numbers with
their scale, dates ISO texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.sinks.files import _rename, delete, exists, file_names, hidden, open_bytes, put

KEEP_NULLS = {"ignoreNullFields": "false"}

#: How many bytes of a stored array are held at a time while it is passed on.
CHUNK = 1 << 20
#: Low bits of ``monotonically_increasing_id``: the place of a row in its task.
_PLACE = (1 << 33) - 1


def row_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), KEEP_NULLS)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return df.select(row_json(df).alias("json"))


def first_object(df: DataFrame) -> DataFrame:
    """One row: the first row as an object, ``{}`` if there is none."""
    return df.limit(1).agg(F.coalesce(F.first(row_json(df)), F.lit("{}")).alias("json"))


def charts_object(daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """One row: ``{"daily": [...], "monthly": [...]}``.

    Only for trends: their rows are days and months of a fixed span, at most
    61 and 12, so that each list is bounded whatever the data.
    """
    months = _series(monthly, "month_start", "monthly").scalar()
    both = F.struct("daily", months.alias("monthly"))
    return _series(daily, "date", "daily").select(F.to_json(both, KEEP_NULLS).alias("json"))


def array_object(df: DataFrame, order: list[Column]) -> DataFrame:
    """One row: all rows as one array, in ``order``. Only for lists of a bounded length."""
    sortable = F.struct(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]).alias("_key"), F.struct(*df.columns).alias("_row"))
    rows = F.transform(F.array_sort(F.collect_list(sortable)), lambda s: s["_row"])
    return df.agg(F.to_json(rows, KEEP_NULLS).alias("json"))


def _series(df: DataFrame, key: str, alias: str) -> DataFrame:
    """All rows as one sorted array of structs, with the fields in ``df``'s order."""
    sortable = F.struct(F.col(key).alias("_key"), F.struct(*df.columns).alias("_row"))
    rows = F.transform(F.array_sort(F.collect_list(sortable)), lambda s: s["_row"])
    return df.agg(rows.alias(alias))


def write_json(df: DataFrame, path: str) -> None:
    """One object per line, written by the tasks that hold the rows."""
    df.write.option("ignoreNullFields", "false").json(path, mode="error")


def write_array(df: DataFrame, path: str, order: list[Column]) -> None:
    """All rows as one JSON array, in ``order``, whatever their number.

    The array is a folder of parts that gives the text when they are put together in the order of their names. Every
    task writes one part, a range of the order, with commas between its own rows; the brackets and the commas between parts
    are small files beside them. All come into sight by one rename, so readers find the whole array or none, and
    a job that fails leaves nothing. ``path`` must not be there yet. No rows give ``[]``.
    """
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    staging = hidden(path, "staging")
    # Numbered after the sort, in the task that writes the part: its first row has no comma before it.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)) == 0
    rows = df.orderBy(*order).select(F.concat(F.when(first, "").otherwise(","), row_json(df)).alias("value"))
    try:
        # A part must stay one file also where the session splits tables by their rows.
        rows.write.option("maxRecordsPerFile", 0).option("compression", "none").text(staging)
        parts = [name for name, size in file_names(spark, staging) if size and not name.startswith(("_", "."))]
        put(spark, f"{staging}/array-begin", b"[\n")
        for name in parts[:-1]:
            put(spark, f"{staging}/{name}~", b",\n")
        put(spark, f"{staging}/~array-end", b"]\n")
        _rename(spark, staging, path)
    except (PySparkException, OSError):
        delete(spark, staging)
        raise


def array_bytes(spark: SparkSession, path: str) -> Iterator[bytes]:
    """The text of a stored array, piece by piece; empty parts, checksums and Spark's own marks are passed over."""
    for name, size in file_names(spark, path):
        if size and not name.startswith(("_", ".")):
            yield from open_bytes(spark, f"{path}/{name}", CHUNK)


def array_rows(spark: SparkSession, path: str) -> DataFrame:
    """The objects of a stored array, one per row, read by many tasks."""
    value = F.regexp_replace("value", "^,", "")
    return spark.read.text(path).select(value.alias("json")).filter(F.col("json").startswith("{"))
