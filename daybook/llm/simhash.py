"""Near-duplicates by SimHash, found through counts of bits in segments.

A fingerprint has 64 bits; a text's bit is 1 if it is set in over half of the hashes of its shingles.
A fingerprint is mapped to the number of bits set in each segment. Two fingerprints that differ in d bits lie
within d of each other in Manhattan distance, so that distance is a lower bound: a
range join on the grid of counts finds every candidate, and bits decide.

The join meets half-way. Two points within d have a grid point within d // 2 of the one and d - d // 2 of the
other, so each fingerprint goes to all cells within that radius (33 cells for 16 segments and 2 bits) and
candidates share a cell. Equal fingerprints are one. A cell with more than ``CROWD`` of them is not paired; its members go to the
finest grid instead, of 64 segments of one bit, where sharing a cell of the half radius is a proof, and a cell
links its members to its smallest one. So links grow with fingerprints, not with pairs, and none is lost.

Null and empty texts and those without words have the fingerprint zero and are linked like any other. Null ids are never the smallest;
a component of null ids alone has a null id. Repeated rows fall together. An empty table gives empty results. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.components import components
from daybook.llm.staging import stage
from daybook.llm.workers import ready

# Production parameters.
SHINGLE = 3
DISTANCE = 2
SEGMENTS = 16
CROWD = 24
SEED = 42
# Hashes that are held as bits at a time.
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(shingle)))]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), _BLOCK):
        part = shingles[at:at + _BLOCK]
        hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), part), dtype=np.uint64, count=len(part))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * total > len(shingles), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ``_text`` (a hash of the text) and ``fp``, a long, of every row; whole texts, A-Z in lower case."""
    ready(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text or b"", shingle) for text in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_text"), pa.array(found, pa.int64())], ["doc_id", "_text", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"), "text")
    return texts.mapInArrow(run, "doc_id long, _text long, fp long")


def _cells(fps: np.ndarray, segments: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, cell, steps) for the grid points within ``radius`` of each fingerprint's counts.

    A cell's number has a digit for each segment; for 64 segments it is the fingerprint's own bits.
    """
    width = 64 // segments
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    digits = bits.reshape(-1, segments, width).sum(axis=2, dtype=np.uint64)
    place = np.array([(width + 1) ** i for i in range(segments)], dtype=np.uint64)
    index, cells = np.arange(len(fps)), digits @ place
    found = [(index, cells, np.zeros(len(fps), dtype=np.int64))]
    for step in range(1, radius + 1):
        moves = []
        for s in range(segments):
            for up in (True, False):
                fits = digits[:, s] < width if up else digits[:, s] > 0
                moved = digits[fits].copy()
                moved[:, s] = moved[:, s] + 1 if up else moved[:, s] - 1
                moves.append((index[fits], cells[fits] + place[s] if up else cells[fits] - place[s], moved))
        index, cells, digits = (np.concatenate(x) for x in zip(*moves))
        found.append((index, cells, np.full(len(index), step)))
    index, cells, steps = (np.concatenate(x) for x in zip(*found))
    if radius > 1:  # some cells are reached in several ways
        order = np.lexsort((steps, cells, index))
        index, cells, steps = index[order], cells[order], steps[order]
        first = np.ones(len(index), dtype=bool)
        first[1:] = (index[1:] != index[:-1]) | (cells[1:] != cells[:-1])
        index, cells, steps = index[first], cells[first], steps[first]
    return index, cells, steps


def _to_cells(fps: DataFrame, segments: int, distance: int) -> DataFrame:
    """(cell, fp, near): each fingerprint in the cells within the larger half of ``distance``;
    ``near`` tells those within the smaller half."""
    near, far = distance // 2, distance - distance // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy()
            for at in range(0, len(own), 1024):
                part = np.ascontiguousarray(own[at:at + 1024])
                index, cells, steps = _cells(part, segments, far)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.view(np.int64)), pa.array(part[index]), pa.array(steps <= near)], ["cell", "fp", "near"])

    return fps.select("fp").mapInArrow(run, "cell long, fp long, near boolean")


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp``, enough to connect all that differ in
    ``distance`` bits or fewer, directly or through others."""
    ready(fps.sparkSession)
    spread = _to_cells(fps, segments, distance)
    shared = stage(
        spread.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"),
        "cells")
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= distance
    couples = shared.filter("n = 2").select("a", "b")
    few = spread.join(shared.filter(f"n between 3 and {crowd}").select("cell"), "cell").groupBy("cell").agg(
        F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda a: F.transform(
        F.filter("fps", lambda b: (b > a) & close(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    found = [couples.filter(close(F.col("a"), F.col("b"))), few.select(F.explode(pairs).alias("p")).select("p.a", "p.b")]
    many = shared.filter(F.col("n") > crowd).select("cell")
    crowded = stage(spread.join(many, "cell").select("fp").distinct(), "crowded")
    finest = _to_cells(crowded, 64, distance)
    hubs = finest.groupBy("cell").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.count(F.lit(1)).alias("n"))
    hubs = hubs.filter("n > 1 and a is not null").drop("n")
    found.append(finest.join(hubs, "cell").filter("a <> fp").select("a", F.col("fp").alias("b")))
    return reduce(DataFrame.unionByName, found).distinct()


def _grouped(docs: DataFrame, shingle: int, distance: int, segments: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _text, fp) of every row, and (fp, root, component_id) of every fingerprint."""
    prints = stage(fingerprints(docs, shingle), "prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, distance, segments)).withColumnsRenamed({"node": "fp"})
    named = stage(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, named.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, ``fp`` and ``component_id``, the smallest doc_id that links reach, of every row."""
    prints, named = _grouped(docs, shingle, distance, segments)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, and of its texts that of the smallest hash."""
    prints, named = _grouped(docs, shingle, distance, segments)
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_text")).alias("kept")
    kept = prints.join(named, "fp").groupBy("root").agg(smallest).select("kept.*")
    # Keys without nulls: the join and the removal of equal rows then share one shuffle of the texts.
    key = lambda doc_id, text: (
        F.coalesce(doc_id, F.lit(0)).alias("_doc"), doc_id.isNull().alias("_nameless"), text.alias("_hash"))
    rows = docs.select(F.struct("*").alias("doc"), *key(F.col("doc_id").cast("long"), F.xxhash64("text")))
    names = ["_doc", "_nameless", "_hash"]
    kept = kept.select(*key(F.col("doc_id"), F.col("_text")))
    return rows.join(kept, names, "left_semi").dropDuplicates(names).select("doc.*")
