"""Header-driven CSV reading with explicit types and a verdict on every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.functions.text import empty_to_null
from daybook.schemas import TEXT, Field, Table
from daybook.sources.records import FIRST, PLACE, RECORD_TEXT, read_records

#: Why a row cannot be stored; NULL for a good row.
REASON = "_reason"
#: The record of a bad row, as it was read.
RECORD = "_record"
#: Input order: file, place of the split in the file, place of the row in the split.
POSITION = PLACE

_MALFORMED = "_malformed"


def read_csv(spark: SparkSession, path: str, table: Table, *, header_names: bool = True,
             multi_line: bool = True, by_blocks: bool = False) -> DataFrame:
    """The rows of CSV files with ``table``'s columns, plus ``REASON``, ``RECORD``
    and ``POSITION``.

    Columns are found by header name, snake_case or camelCase and in any order;
    with ``header_names=False`` the header is skipped and columns are taken by
    position. A column the files lack is NULL. Empty fields are NULL.

    A quoted field may hold a line break, so a file is read by one task. ``by_blocks=True`` finds the records of large files
    by many tasks, for one shuffle of the lines (``daybook.sources.records``). ``multi_line=False`` splits files
    among tasks without one, for those known to hold no such record: one that does is refused as malformed, line by line.

    Fields are read as text and converted here, since a typed CSV scan checks
    only the columns a query happens to use.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if header_names:
        header = reader.csv(path).columns
        names = table.resolve(header)
    else:
        header = names = table.names
    if by_blocks:
        raw = _parsed(read_records(spark, path), header, header_names)
    else:
        layout = T.StructType([T.StructField(h, TEXT) for h in [*header, _MALFORMED]])
        raw = (
            reader.schema(layout)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _MALFORMED)
            # With names the header of every file must be the one just resolved.
            .option("enforceSchema", not header_names)
            .csv(path)
            .select("*", F.col("_metadata.file_path").alias(POSITION[0]), F.col("_metadata.file_block_start").alias(POSITION[1]),
                    F.monotonically_increasing_id().alias(POSITION[2]))
        )
    texts = raw.select(
        *[empty_to_null(F.col(_quoted(h))).alias(n) for h, n in zip(header, names)],
        *[F.lit(None).cast(TEXT).alias(n) for n in table.names if n not in names],
        _MALFORMED, *POSITION,
    )
    # Each field is converted once; the verdict looks at the outcome.
    converted = texts.select("*", *[_converted(f).alias(_value(f)) for f in table.fields])
    judged = converted.select("*", _reason(table).alias(REASON))
    record = F.coalesce(_MALFORMED, F.to_json(F.struct(*table.names), {"ignoreNullFields": "false"}))
    return judged.select(
        *[F.col(_value(f)).alias(f.name) for f in table.fields],
        REASON,
        F.when(F.col(REASON).isNotNull(), record).alias(RECORD),
        *POSITION,
    )


def _parsed(records: DataFrame, header: list[str], check: bool) -> DataFrame:
    """``records`` by Spark's CSV parser, without the first of each file, which with ``check`` must be ``header``."""
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED}
    layout = ", ".join(f"{_quoted(name)} STRING" for name in [*header, _MALFORMED])
    rows = records.select(F.from_csv(F.regexp_replace(RECORD_TEXT, "^\ufeff", ""), layout, options).alias("_row"), FIRST, *POSITION)
    conforms = F.lit(True)
    if check:
        conforms = F.col("_row")[_MALFORMED].isNull()
        for name in header:
            conforms &= F.lower(F.col("_row")[name]).eqNullSafe(name.lower())
    complaint = F.raise_error(F.concat(F.lit("CSV header does not conform to the schema in "), POSITION[0])).cast("boolean")
    kept = F.when(F.col(FIRST), F.when(conforms, False).otherwise(complaint)).otherwise(True)
    return rows.filter(kept).select("_row.*", *POSITION)


def accept_all(rows: DataFrame) -> DataFrame:
    """The rows if all are good; the first bad one stops the job that reads any
    column of it.

    The check sits in the columns. As a filter Spark would move it below the
    conversions and repeat them all.
    """
    complaint = F.raise_error(F.concat(F.lit("bad row: "), REASON, F.lit(" in "), RECORD))
    own = {REASON, RECORD, *POSITION}
    return rows.select(*[
        c if c in own else
        F.when(F.col(REASON).isNull(), F.col(c)).otherwise(complaint.cast(rows.schema[c].dataType)).alias(c)
        for c in rows.columns])


def _value(field: Field) -> str:
    return f"_{field.name}"


def _converted(field: Field) -> Column:
    text = F.col(field.name)
    if field.type != TEXT:
        return text.try_cast(field.type)
    # Blanks beyond the allowed length are cut off, as SQL's VARCHAR(n) does.
    return text if field.length is None else F.substring(text, 1, field.length)


def _reason(table: Table) -> Column:
    malformed = F.when(F.col(_MALFORMED).isNotNull(), F.lit("malformed record"))
    missing = F.when(F.col(table.key).isNull(), F.lit(f"no {table.key}"))
    checked = [f for f in table.fields if f.type != TEXT or f.length is not None]
    return F.coalesce(malformed, missing, *map(_complaint, checked))


def _complaint(field: Field) -> Column:
    text = F.col(field.name)
    if field.type != TEXT:
        failed = text.isNotNull() & F.col(_value(field)).isNull()
        return F.when(failed, F.concat(
            F.lit(f"{field.name} is no {field.type.simpleString()}: "), text))
    return F.when(F.length(F.rtrim(text)) > field.length,
                  F.lit(f"{field.name} is longer than {field.length}"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
