"""Token ids as files of compressed documents.

A table is a folder: ``dictionary`` holds one zstandard dictionary with its SHA-256, ``shards``
the documents in order of doc_id. A shard is one binary value::

    magic (8 bytes), bytes an id (8), documents (8), SHA-256 of the dictionary (32),
    offsets of the frames (8 each, one more than documents), one frame a document

with little-endian numbers. Frames are compressed one by one, so a short document is read by its two offsets and
one frame. Shards are values of a Parquet table, so that Spark commits them whole wherever it can write;
beside each stand its documents' ids and where it comes.

Null texts are empty documents, of the end id only. Null ids come first; rows with equal ids
are ordered by a hash of the text. An empty table has no shards. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.staging import tasks
from daybook.llm.tokens import encoder, pack
from daybook.llm.workers import ready

# Production parameters.
END = 2
SHARD_DOCS = 1024
SHARD_BYTES = 8 << 20
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
# The dictionary is trained on documents of up to so many bytes, and on so many of them at most.
SAMPLE_DOCS = 1000
SAMPLE_TEXT = 16 << 10

MAGIC = b"DAYBTOK1"
_SHARD = "part int, seq int, before long, n_tokens long, first_doc long, last_doc long, doc_ids array<long>, shard binary"
_READ = "doc_id long, part int, before long, n_tokens long, ids_crc32 long, ids array<long>"


def serialize(ids: bytes, width: int) -> bytes:
    """Little-endian 32-bit ids in ``width`` bytes each."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def train(docs: DataFrame, tokenizer: str, end: int = END) -> bytes:
    """A dictionary from ids of a bounded sample: the documents with the smallest hashes among
    the shorter ones. Empty where there are too few to train on."""
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    # The draw lets through about as many as are wanted, so that tasks send little to the driver.
    drawn = docs.filter(draw * docs.count() < SAMPLE_DOCS).filter(F.octet_length("text") <= SAMPLE_TEXT)
    encode, tail = encoder(tokenizer).ids, pack([end])
    width = _width(tokenizer, end)
    texts = drawn.select("text", draw.alias("draw")).orderBy("draw", "text").limit(SAMPLE_DOCS).collect()
    samples = [serialize(encode(row.text) + tail, width) for row in texts]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 10), samples).as_bytes()
    except zstandard.ZstdError:  # too small or too much alike
        return b""


def _width(tokenizer: str, end: int) -> int:
    return 2 if max(encoder(tokenizer).highest, end) < 1 << 16 else 4


def build_shard(documents: list[bytes], width: int, dictionary: bytes) -> bytes:
    """Documents given as little-endian 32-bit ids."""
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=own).compress
    frames = [press(serialize(ids, width)) for ids in documents]
    offsets = np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes()
    head = MAGIC + np.array([width, len(frames)], "<u8").tobytes() + hashlib.sha256(dictionary).digest()
    return b"".join([head, offsets, *frames])


class Shard:
    """Reads documents of a shard by their place in it."""

    def __init__(self, blob: bytes, dictionary: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a shard")
        if blob[24:56] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.width, self.documents = (int(x) for x in np.frombuffer(blob, "<u8", 2, 8))
        self._offsets = np.frombuffer(blob, "<u8", self.documents + 1, 56)
        self._frames = memoryview(blob)[56 + 8 * (self.documents + 1):]
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._plain = zstandard.ZstdDecompressor(dict_data=own).decompress

    def __getitem__(self, place: int) -> np.ndarray:
        start, stop = (int(x) for x in self._offsets[place:place + 2])
        return np.frombuffer(self._plain(self._frames[start:stop]), f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Writes the files of ``docs``; texts are shuffled once, by range of doc_id."""
    spark = docs.sparkSession
    ready(spark)
    dictionary = train(docs, tokenizer, end)
    spark.createDataFrame(
        [(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary"
    ).coalesce(1).write.parquet(f"{path}/dictionary")
    width = _width(tokenizer, end)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, tail = encoder(tokenizer).ids, pack([end])
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs_of, texts, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, before, held
            tokens = sum(map(len, texts)) // 4
            known = [d for d in docs_of if d is not None]
            row = {"part": part, "seq": seq, "before": before, "n_tokens": tokens, "first_doc": min(known, default=None),
                   "last_doc": max(known, default=None), "doc_ids": docs_of, "shard": build_shard(texts, width, dictionary)}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()),
                ("last_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("shard", pa.binary())]))
            seq, before, held = seq + 1, before + tokens, 0
            docs_of.clear()
            texts.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs_of.append(doc_id)
                texts.append(ids_of(text) + tail)
                held += len(texts[-1])
                if len(texts) >= SHARD_DOCS or held >= SHARD_BYTES:
                    yield from flush()
        if texts:
            yield from flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    (docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie"))
     .repartitionByRange(tasks(docs), *order).sortWithinPartitions(*order).drop("_tie")
     .mapInArrow(encode, _SHARD).write.parquet(f"{path}/shards"))


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """A row for each document: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian 32-bit integers) and, if wanted, ids."""
    ready(spark)
    dictionary = _dictionary(spark, path)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, before, rows = Shard(row["shard"], dictionary), row["before"], []
                for place, doc_id in enumerate(row["doc_ids"]):
                    ids = shard[place]
                    rows.append((doc_id, row["part"], before, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None))
                    before += len(ids)
                columns = zip(*rows)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                                 ["doc_id", "part", "before", "n_tokens", "ids_crc32", "ids"])

    shards = spark.read.parquet(f"{path}/shards")
    # A row for each task that wrote: bounded by a setting, not by the input.
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    rows = shards.select("part", "before", "doc_ids", "shard").mapInArrow(decode, _READ).join(F.broadcast(totals), "part")
    kept = ["n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return rows.select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), *kept)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents called ``doc_id``: shards are found by their first and last id."""
    dictionary = _dictionary(spark, path)
    shards = spark.read.parquet(f"{path}/shards").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    found = []
    for row in shards.filter(F.array_contains("doc_ids", doc_id)).select("doc_ids", "shard").toLocalIterator():
        shard = Shard(bytes(row.shard), dictionary)
        found += [shard[place].tolist() for place, own in enumerate(row.doc_ids) if own == doc_id]
    return found


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != row.sha256:
        raise ValueError(f"the dictionary of {path} is damaged")
    return dictionary
