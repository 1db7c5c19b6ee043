"""Best-fit packing of documents into sequences, over a tree of partitions.

Each document becomes its ids and an end id; only one longer than a sequence is cut, into full pieces and
a rest. A task packs what its partition holds, longest first, each piece into the fullest sequence
that takes it. Sequences that are nearly full are done, and so are those that not even the smallest one left
fits into. The others are the items of the next round, in fewer partitions, until one partition of ``CHUNK`` items at most has been packed, until all that are left are over
half full, so that no two fit together, or until a round no longer joins any in as few partitions as hold them.

A null text is an empty one and gives one piece, the end id. Null ids stay null. Repeated rows are packed
each. An empty table gives no pieces. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.staging import stage
from daybook.llm.tokens import encoder, pack as pack_ids
from daybook.llm.workers import ready

# Production parameters.
CAPACITY = 2048
END = 0
SLACK = 4
CHUNK = 16_384
FAN = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BINS = "sequence_id long, fill int, done boolean, items binary"
# A piece as it travels inside a sequence.
_ITEM = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("piece", "<i8"), ("start", "<i8"), ("length", "<i8"), ("ids_crc32", "<i8")])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    ready(docs.sparkSession)
    tail = pack_ids([end])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        width = 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + tail
                rows += [(doc_id, n, at // 4, len(part) // 4, zlib.crc32(part))
                         for n, at in enumerate(range(0, len(ids), width)) for part in (ids[at:at + width],)]
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of indices into ``sizes``, longest first, each into the
    fullest sequence with room for it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []  # the bit of each room that some sequence has
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if fitting := rooms >> sizes[i]:
            room = sizes[i] + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, own = capacity, len(bins)
            bins.append([])
        bins[own].append(i)
        if room := room - sizes[i]:
            by_room[room].append(own)
            rooms |= 1 << room
    return bins


def pack(cut: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """``cut`` (as from ``pieces``, lengths up to ``capacity``) with sequence_id and offset."""
    ready(cut.sparkSession)
    level = stage(cut.mapInArrow(_singles, _BINS), "pack")
    parts, count, finished, depth = level.rdd.getNumPartitions(), None, [], 0
    while True:
        packed = stage(level.mapInArrow(_packer(capacity, slack, depth), _BINS), f"pack-{depth}")
        fills = {row.fill: row["count"] for row in packed.filter("not done").groupBy("fill").count().collect()}  # at most ``capacity``
        most = capacity - min(fills, default=0)  # what the smallest one still fits into
        left, small, joinable = (sum(n for fill, n in fills.items() if fill <= top) for top in (capacity, capacity // 2, most))
        fewer = max(-(-joinable // CHUNK), -(-parts // FAN))
        # In the first round a task may have packed more than one chunk.
        whole = parts == 1 and count is not None
        if not small or joinable < 2 or whole or (left == count and fewer >= parts):
            finished.append(packed)
            break
        goes_on = ~F.col("done") & (F.col("fill") <= most)
        finished.append(packed.filter(~goes_on))
        parts, count = fewer, joinable
        level, depth = packed.filter(goes_on).repartition(parts), depth + 1
    every = reduce(DataFrame.unionByName, finished)
    return every.select("sequence_id", "items").mapInArrow(_placed, f"{PIECES}, sequence_id long, offset long")


def _singles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece as a sequence of its own."""
    for batch in batches:
        table = np.zeros(batch.num_rows, dtype=_ITEM)
        ids = batch.column("doc_id")
        table["doc_id"], table["has_id"] = ids.fill_null(0), ids.is_valid().to_numpy(False)
        for name in ("piece", "start", "length", "ids_crc32"):
            table[name] = batch.column(name).to_numpy()
        yield _bins([0] * len(table), table["length"], [False] * len(table), [row.tobytes() for row in table])


def _bins(ids, fills, done, items) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(fills, pa.int32()), pa.array(done, pa.bool_()), pa.array(items, pa.binary())],
        ["sequence_id", "fill", "done", "items"])


def _packer(capacity: int, slack: int, depth: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The round, the task and a count make a sequence's number.
        first = depth << 56 | TaskContext.get().partitionId() << 32
        sizes, items = [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            bins = best_fit(sizes, capacity)
            fills = [sum(sizes[i] for i in own) for own in bins]
            for at in range(0, len(bins), 4096):
                part = slice(at, at + 4096)
                yield _bins(range(first + at, first + at + len(bins[part])), fills[part], [f >= capacity - slack for f in fills[part]],
                            [b"".join(items[i] for i in own) for own in bins[part]])
            first += len(bins)
            sizes.clear()
            items.clear()

        for batch in batches:
            sizes += batch.column("fill").to_pylist()
            items += batch.column("items").to_pylist()
            if len(sizes) >= CHUNK:
                yield from flush()
        yield from flush()
    return run


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences taken apart, with each piece's place."""
    for batch in batches:
        items = batch.column("items").to_pylist()
        counts = [len(x) // _ITEM.itemsize for x in items]
        table = np.frombuffer(b"".join(items), dtype=_ITEM)
        before = np.cumsum(table["length"]) - table["length"]
        heads = np.cumsum([0, *counts[:-1]])
        offsets = before - np.repeat(before[heads] if len(table) else before, counts)
        columns = [pa.array(table["doc_id"], mask=table["has_id"] == 0), pa.array(table["piece"].astype("i4")),
                   *[pa.array(table[c]) for c in ("start", "length", "ids_crc32")],
                   pa.array(np.repeat(batch.column("sequence_id").to_numpy(), counts)), pa.array(offsets)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
