"""Loads of CSV files into stored tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from daybook.operators.keyed import first_per_key, insert_if_absent, key_violations
from daybook.schemas import Table
from daybook.session import scratch
from daybook.sinks.files import delete, exists, replace_table
from daybook.sources.delimited import POSITION, REASON, RECORD, accept_all, read_csv


#: The partition column of stored bad rows.
LOAD = "load"


@dataclass(frozen=True)
class LoadReport:
    """Counts of records: ``read = inserted + duplicates + rejected``."""
    read: int
    inserted: int
    duplicates: int
    rejected: int


def load_table(spark: SparkSession, csv_path: str, table: Table, path: str, **options) -> None:
    """Stores a CSV as a new table in place of the one at ``path``, or fails and
    leaves that one alone: on a bad row, or on a key that is not unique."""
    rows = accept_all(read_csv(spark, csv_path, table, **options)).select(*table.names)
    replace_table(rows, path, check=lambda written: _refuse_violations(written, table))


def _refuse_violations(written: DataFrame, table: Table) -> None:
    repeated = key_violations(written, table.key).select(table.key).head(3)
    if repeated:
        raise ValueError(f"{table.name}: {table.key} is not unique: {[r[0] for r in repeated]}")


def insert_all_or_nothing(spark: SparkSession, csv_path: str, table: Table, path: str,
                          **options) -> LoadReport:
    """Adds the rows whose key is new; a single bad row stops the load before
    the table is touched."""
    return _insert(spark, accept_all(read_csv(spark, csv_path, table, **options)), table, path)


def insert_good_rows(spark: SparkSession, csv_path: str, table: Table, path: str,
                     quarantine: str, load_id: str | None = None, **options) -> LoadReport:
    """Adds the good rows whose key is new; bad rows go to ``quarantine`` with
    the reason and the record as read, under the load's id.

    The bad rows are stored before the table is touched. A load that is run again, after a failure or a correction
    of its file, replaces the bad rows of its first run; ``load_id`` names it, by default its path.
    """
    bad_rows = f"{quarantine.rstrip('/')}/{LOAD}={load_id or hashlib.sha256(csv_path.encode()).hexdigest()[:16]}"
    return _insert(spark, read_csv(spark, csv_path, table, **options), table, path, bad_rows)


def _insert(spark: SparkSession, rows: DataFrame, table: Table, path: str,
            bad_rows: str | None = None) -> LoadReport:
    # The text is parsed once, into a staged table that all later steps read. It
    # also fixes the row positions, which a lost task would otherwise number anew.
    # Rows are counted as they are written, so no table is read for its size.
    staging = scratch(spark, f"load-{table.name}")
    try:
        parsed, added = Observation(), Observation()
        rows.observe(parsed, F.count(F.lit(1)).alias("rows"), F.count(REASON).alias("bad")).write.parquet(f"{staging}/rows")
        staged = spark.read.schema(rows.schema).parquet(f"{staging}/rows")
        if bad_rows is not None:
            if parsed.get["bad"]:
                bad = staged.filter(F.col(REASON).isNotNull())
                replace_table(bad.select(REASON, RECORD, *POSITION), bad_rows)
            else:
                delete(spark, bad_rows)
        good = staged.filter(F.col(REASON).isNull()).drop(REASON, RECORD)
        # Staged as well: known keys are looked up from these rows, and added from them.
        firsts = first_per_key(good, table.key, POSITION).select(*table.names)
        firsts.write.parquet(f"{staging}/firsts")
        fresh = spark.read.schema(firsts.schema).parquet(f"{staging}/firsts")
        if exists(spark, path):
            fresh = insert_if_absent(fresh, spark.read.schema(table.schema).parquet(path), table.key)
        fresh.observe(added, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
        read, rejected, inserted = parsed.get["rows"], parsed.get["bad"], added.get["rows"]
    finally:
        delete(spark, staging)
    return LoadReport(read, inserted, read - rejected - inserted, rejected)


def rewrite_types(spark: SparkSession, path: str, widened: Table) -> None:
    """Rewrites a stored table with wider column types (see ``Table.widen``)."""
    stored = spark.read.parquet(path)
    replace_table(stored.select(*[F.col(f.name).cast(f.type).alias(f.name) for f in widened.fields]), path)
