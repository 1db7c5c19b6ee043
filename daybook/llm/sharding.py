"""Consistent hashing with bounded loads.

A ring of cells holds virtual nodes of every shard. A row's key hashes to a cell and goes to the
shard of the next virtual node clockwise; when that shard is full, on to the next that is not.
With ``load_factor`` 1 the capacities add up to the rows, so shards differ by one row at most;
above 1 a shard takes up to that multiple of the mean, and fewer rows move when shards are added.

Which rows overflow is settled on counts. Rows are counted by cell and by one of a few salts, drawn
from a number that is fixed with the staged row, so that a key repeated in a third of all rows is
spread too. The counts, ``CELLS * SALTS`` at most whatever the input, are walked around the ring, salt
by salt, and give each run of rows of a cell its shard and its first slot. Rows then only look up the run they are in.

A null key is a key like any other, and so is a null text with a size of 1 and the checksum of an empty one.
Repeated rows are placed one by one. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.staging import stage

CELLS = 4096
SALTS = 16
VNODES = 64


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """The virtual nodes as (cell, shard), in order. Of two in one cell the smaller shard stays."""
    if shards * 2 > cells:
        raise ValueError("more cells are needed for so many shards")
    cell = F.pmod(F.xxhash64(F.lit("node"), "shard", "copy"), F.lit(cells))
    nodes = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("copy"))
        .groupBy(cell.alias("cell")).agg(F.min("shard").alias("shard"))
    )
    return sorted((row.cell, row.shard) for row in nodes.collect())


def capacities(rows: int, shards: int, load_factor: float = 1.0) -> list[int]:
    """Exact shares for a factor of 1, in whole rows; else the factor times the mean, rounded up."""
    if load_factor < 1:
        raise ValueError("load_factor must be 1 at least")
    if load_factor == 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-load_factor * rows // shards)] * shards


def settle(counts: dict[tuple[int, int], int], nodes: list[tuple[int, int]], room: list[int],
           cells: int = CELLS, salts: int = SALTS) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of rows as (cell, salt, first row, rows, shard, first slot).

    Rows come in the order of salt, then cell; the ones of a cell that a full shard
    can't take go on clockwise.
    """
    room, filled, runs = list(room), [0] * len(room), []
    at, node = [0] * cells, 0
    for cell in range(cells):
        while node < len(nodes) and nodes[node][0] < cell:
            node += 1
        at[cell] = node % len(nodes)
    for salt in range(salts):
        for cell in range(cells):
            left, first, node = counts.get((cell, salt), 0), 0, at[cell]
            while left:
                shard = nodes[node][1]
                if taken := min(left, room[shard]):
                    runs.append((cell, salt, first, taken, shard, filled[shard]))
                    room[shard] -= taken
                    filled[shard] += taken
                    first += taken
                    left -= taken
                node = (node + 1) % len(nodes)
    return runs


def shard(rows: DataFrame, key: Column, columns: list[Column], shards: int, vnodes: int = VNODES,
          load_factor: float = 1.0) -> DataFrame:
    """``columns`` of ``rows`` with ``shard``, ``slot`` (gapless from 0 in a shard) and
    ``home_shard``, the one that the ring names before capacities.

    ``columns`` are staged and shuffled, so leave out texts; join them on a key later.
    """
    spark = rows.sparkSession
    cell = F.pmod(F.xxhash64(F.lit("key"), key), F.lit(CELLS)).cast("int")
    numbered = rows.select(*columns, cell.alias("_cell"), F.monotonically_increasing_id().alias("_row"))
    staged = stage(numbered, "shard").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    # CELLS * SALTS counts at most.
    counts = {(r[0], r[1]): r[2] for r in staged.groupBy("_cell", "_salt").count().collect()}
    nodes = ring(spark, shards, vnodes)
    runs = settle(counts, nodes, capacities(sum(counts.values()), shards, load_factor))
    homes = dict(zip(range(CELLS), _homes(nodes)))
    table = spark.createDataFrame(
        [(c, s, first, first + n, to, slot, homes[c]) for c, s, first, n, to, slot in runs],
        "_cell int, _salt int, _first long, _end long, shard int, _slot long, home_shard int")
    place = F.row_number().over(Window.partitionBy("_cell", "_salt").orderBy("_row")) - 1
    ranked = staged.withColumn("_place", place.cast("long"))
    # At most a run for each count, and one more for each time that a shard fills up.
    found = ranked.join(
        F.broadcast(table), ["_cell", "_salt"]).where((F.col("_place") >= F.col("_first")) & (F.col("_place") < F.col("_end")))
    return found.withColumn("slot", F.col("_slot") + F.col("_place") - F.col("_first")).drop(
        "_cell", "_salt", "_row", "_place", "_first", "_end", "_slot")


def _homes(nodes: list[tuple[int, int]]) -> list[int]:
    homes, node = [], 0
    for cell in range(CELLS):
        while node < len(nodes) and nodes[node][0] < cell:
            node += 1
        homes.append(nodes[node % len(nodes)][1])
    return homes
