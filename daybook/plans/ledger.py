"""A book of orders that is added to: fact, key directory and rollups, published together by version.

``fact``    cleaned orders by month
``keys``    every order's number and month, partitioned by a hash of the number: a batch looks up its own numbers in the
            partitions they fall in, so an order is known whatever month it comes under
``days``, ``creators``, ``products``    rollups as the deltas of each load; reports add them up as they read, :meth:`Ledger.compact` folds them
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daybook.functions.dates import month_start
from daybook.operators.keyed import first_per_key, insert_if_absent
from daybook.operators.sales import MONTH
from daybook.plans.book import USES, by_month, rollup
from daybook.plans.dashboard import Dashboard
from daybook.session import scratch
from daybook.sinks.files import delete
from daybook.sinks.versions import Change, Store, Version

KEY, BUCKET = "order_no", "key_bucket"
#: Partitions of the key directory. Fixed once a book exists.
BUCKETS = 256
#: A month of a rollup is worth folding from so many loads on.
LOADS = 8


class Ledger:
    """The book at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.store, self.buckets = spark, Store(spark, path), buckets

    def add(self, batch: DataFrame, correct: bool = False, source: str | None = None, number: int = 0) -> Version:
        """Adds the cleaned orders of ``batch`` whose numbers the book lacks, to all tables in one step.

        Of a number repeated in the batch the row with the smallest date is taken. An order that is known stays as it is,
        also if it comes under another month; with ``correct`` it is replaced by the batch's. A ``source`` that numbers its
        batches in order can send one again: it changes nothing. Orders without a number are refused.
        """
        change = self.store.change()
        if source is not None and change.base.done.get(source, -1) >= number:
            return change.base
        done = {} if source is None else {source: number}
        staging = scratch(self.spark, "batch")
        try:
            rows = self._staged(self._firsts(batch), f"{staging}/firsts")
            low, high, buckets, nulls = self._extent(rows)
            if nulls:
                raise ValueError(f"{nulls} orders without a number")
            if not buckets:
                return change.commit(**done) if done else change.base
            known = None
            if "keys" in change.base.tables:
                known = change.base.read("keys", buckets).filter(F.col(KEY).between(low, high))
            if correct and known is not None:
                old = self._staged(known.join(rows.select(KEY), KEY, "left_semi"), f"{staging}/old")
                self._replace(change, rows, old, buckets)
            else:
                fresh = rows if known is None else self._staged(insert_if_absent(rows, known.select(KEY), KEY), f"{staging}/fresh")
                if known is not None and fresh.isEmpty():
                    return change.commit(**done) if done else change.base
                self._append(change, fresh)
            return change.commit(**done)
        finally:
            delete(self.spark, staging)

    def follow(self, orders: DataFrame, source: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Adds the cleaned orders of a stream as they come. A batch that was published before a failure is known by its number."""
        def take(batch: DataFrame, number: int) -> None:
            self.add(batch, source=source, number=number)
        return orders.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()

    def at(self, number: int | None = None) -> Version:
        """The book as of a version. All that is read from it is of one moment."""
        return self.store.at(number)

    def dashboard(self, version: Version, *tables: DataFrame) -> Dashboard:
        """The reports of one version, over its rollups. Its newest month comes from the manifest."""
        users, products, destinations = (*tables, None, None, None)[:3]
        newest = max((dt.date.fromisoformat(v) for v in version.values("days") if v is not None), default=None)
        return Dashboard(version.read("days"), users, products, destinations, newest, version.read("creators"), version.read("products"))

    def compact(self, loads: int = LOADS) -> Version:
        """Folds the rollup months that have come to lie in ``loads`` loads or more. Fact and keys stay as they are."""
        change = self.store.change()
        touched = False
        for name, keys in USES.items():
            values = [v for part in change.base.tables[name].parts for v in part.values]
            crowded = sorted({v for v in values if values.count(v) >= loads}, key=str)
            if crowded:
                folded = rollup(change.base.read(name, crowded), keys)
                change.replace_partitions(name, by_month(folded), crowded)
                touched = True
        return change.commit() if touched else change.base

    def _bucket(self):
        return F.pmod(F.xxhash64(KEY), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _firsts(self, batch: DataFrame) -> DataFrame:
        dated = batch.withColumn("_day", F.col("order_date"))
        return first_per_key(dated, KEY, ["_day"]).withColumn(MONTH, month_start(F.col("order_date")))

    def _staged(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _extent(self, rows: DataFrame) -> tuple[int, int, list[str], int]:
        """Smallest and largest number, the buckets that hold any (at most ``BUCKETS``), and how many rows lack a number."""
        found = rows.agg(F.min(KEY), F.max(KEY), F.collect_set(F.when(F.col(KEY).isNotNull(), self._bucket())), F.count_if(F.col(KEY).isNull())).first()
        return found[0], found[1], [str(b) for b in sorted(found[2])], found[3]

    def _keys(self, rows: DataFrame) -> DataFrame:
        # Each bucket is one task's, and its numbers lie in order, so that a range of them reads few row groups.
        return rows.select(KEY, MONTH, self._bucket()).repartition(BUCKET).sortWithinPartitions(BUCKET, KEY)

    def _append(self, change: Change, fresh: DataFrame) -> None:
        change.append("fact", by_month(fresh.drop(MONTH)), MONTH)
        change.append("keys", self._keys(fresh), BUCKET)
        for name, keys in USES.items():
            change.append(name, by_month(rollup(fresh, keys)), MONTH)

    def _replace(self, change: Change, rows: DataFrame, old: DataFrame, buckets: Sequence[str]) -> None:
        """The months that any order leaves or comes to are written anew, and so are the directory's buckets."""
        both = old.select(MONTH).unionByName(rows.select(MONTH)).distinct().collect()
        months = [None if row[0] is None else row[0].isoformat() for row in both]
        fact = change.base.read("fact", months)
        kept = fact.join(rows.select(KEY), KEY, "left_anti").select(fact.columns)
        now = kept.unionByName(rows.select(fact.columns))
        change.replace_partitions("fact", by_month(now.drop(MONTH)), months)
        keys = change.base.read("keys", buckets).join(rows.select(KEY), KEY, "left_anti").select(KEY, MONTH)
        change.replace_partitions("keys", self._keys(keys.unionByName(rows.select(KEY, MONTH))), buckets)
        for name, cells in USES.items():
            change.replace_partitions(name, by_month(rollup(now, cells)), months)
