"""Repeated passages, found by super-k-mers.

A window is ``WINDOW`` consecutive words. Its minimiser is the smallest hash of the ``MINIMISER``-word
runs in it, so equal windows have equal minimisers. Consecutive windows of a document that share theirs travel to the
minimiser's bucket as one string of words, and the bucket sorts the windows of its strings to see exactly which
begin in several documents.

Only strings that can matter travel. Of documents with the same words the one with the smallest id stands for all;
the others lose every word that a window covers, which is all of them. Minimisers that occur in one document
alone are settled by counting. A minimiser in more than ``CROWD`` strings, or in strings of more than ``WINDOWS`` windows together as one word
repeated makes them, is no bucket: its equal strings are folded to the smallest id before any shuffle, by a digest of 128 bits, and so are the windows of
those that are left, so that a passage in a third of all documents is no one's group.

Rows are told apart by doc_id and a hash of the text. Rows with one doc_id don't take words from each other; those without
an id keep all words and take none. Null and empty texts have no words; shorter documents than a window keep theirs.
Repeated rows travel once and get the same result. An empty table gives an empty one. Other columns pass through; those
named like a result or with a leading underscore are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from daybook.llm.staging import stage
from daybook.llm.workers import ready

# Production parameters.
WINDOW = 50
MINIMISER = 8
CROWD = 2048
WINDOWS = 1 << 16
HOT = 4096
RESULTS = ("n_words", "n_removed", "kept_sha256")

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_REMEMBERED = 400_000
_AT_ONCE = 10_000


class _Hashes(dict):
    """Hashes of words, the latest remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


_HASHES = _Hashes()


def minimisers(words: list[bytes], window: int = WINDOW, length: int = MINIMISER) -> np.ndarray:
    """The minimiser of every window, as unsigned 64-bit integers."""
    if len(words) < window:
        return np.zeros(0, dtype=np.uint64)
    run = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    run = _windowed(run, length, lambda a, b, gap: a + b * np.uint64(pow(int(_ODD), gap, 1 << 64)))
    run ^= run >> np.uint64(31)
    run *= _MIX
    run ^= run >> np.uint64(29)
    return _least(run, window - length + 1)


def _windowed(values: np.ndarray, length: int, join) -> np.ndarray:
    """Joins runs of ``length`` values, from joined powers of two."""
    done, have, power, size = None, 0, values, 1
    while have < length:
        if length & size:
            if done is None:
                done = power
            else:
                n = len(power) - have
                done = join(done[:n], power[have:have + n], have)
            have += size
        if have < length:
            power, size = join(power[:len(power) - size], power[size:], size), 2 * size
    return done


def _least(values: np.ndarray, length: int) -> np.ndarray:
    size = 1
    while 2 * size <= length:
        values, size = np.minimum(values[:len(values) - size], values[size:]), 2 * size
    rest = length - size
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def _offsets(words: list[bytes]) -> np.ndarray:
    """Where each word begins in the words joined by a space, and where the next one would."""
    return np.cumsum([0, *(len(w) + 1 for w in words)])


def _outlines(window: int, length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                least = minimisers(words, window, length)
                starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else []
                rows.append((len(words), hashlib.blake2b(b" ".join(words), digest_size=16).digest(),
                             pa.scalar(np.asarray(starts, "i4"), pa.list_(pa.int32())), least[starts].view("i8") if len(least) else []))
            n, words, starts, least = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_text"), pa.array(n, pa.int64()), pa.array(words, pa.binary()),
                 pa.array([s.values for s in starts], pa.list_(pa.int32())), pa.array(least, pa.list_(pa.int64()))],
                ["doc_id", "_text", "n_words", "words", "starts", "least"])
    return run


def _strings(window: int):
    """Of each document with the runs that travel: a row for each string, with a digest of it."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                words = (row.column("text").cast(pa.binary())[0].as_py() or b"").split()
                joined, at = b" ".join(words), _offsets(words)
                spans = row.column("spans")[0].as_py()
                strings = [joined[at[s["start"]]:at[s["start"] + s["windows"] + window - 1] - 1] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["least"] for s in spans], pa.int64()), pa.array([s["crowded"] for s in spans], pa.bool_()),
                     pa.array([s["start"] for s in spans], pa.int32()), pa.array([s["windows"] for s in spans], pa.int32()),
                     pa.array([_digest(x) for x in strings], pa.binary()), pa.array(strings, pa.binary()),
                     pa.array(row.column("doc_id").to_pylist() * len(spans), pa.int64()),
                     pa.array(row.column("_text").to_pylist() * len(spans), pa.int64())],
                    ["least", "crowded", "start", "windows", "digest", "string", "doc_id", "_text"])
    return run


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _windows(window: int):
    """A row for each window of each string, with a digest of it."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                at = _offsets(row["string"].split(b" "))
                for first in range(0, len(at) - window, _AT_ONCE):
                    found = [_digest(row["string"][at[i]:at[i + window] - 1]) for i in range(first, min(first + _AT_ONCE, len(at) - window))]
                    start = row["start"] + first
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found, pa.binary()), pa.array(range(start, start + len(found)), pa.int32()),
                         pa.array([1] * len(found), pa.int32()), pa.array([row["doc_id"]] * len(found), pa.int64()),
                         pa.array([row["_text"]] * len(found), pa.int64())], ["digest", "start", "windows", "doc_id", "_text"])
    return run


def _later(rows: DataFrame) -> DataFrame:
    """The spans of staged ``rows`` whose digest also comes in a document with a smaller id.

    A digest that has more than one row in ``HOT`` is looked up in a table sent to all tasks, which has
    fewer than ``HOT`` rows; only the others meet by digest, none of them many.
    """
    firsts = stage(rows.groupBy("digest").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b"), "firsts")
    hot = F.col("n") * HOT > rows.count()
    spans = rows.select("digest", "doc_id", "_text", "start", "windows")
    often = F.broadcast(firsts.filter(hot).select("digest", "a"))
    found = spans.join(often, "digest").unionByName(
        spans.join(often, "digest", "left_anti").join(firsts.filter(~hot).select("digest", "a"), "digest"))
    return found.filter("doc_id > a").select("doc_id", "_text", "start", "windows")


def _repeats(window: int):
    """Rows sorted by minimiser: the windows of each bucket that begin in a document with a smaller id."""
    def settle(bucket: list[tuple[int, int, int, bytes]], out: list) -> None:
        # Equal strings are cut once, for the smallest id.
        lowest: dict[bytes, int] = {}
        for doc_id, _, _, string in bucket:
            lowest[string] = min(lowest.get(string, doc_id), doc_id)
        cuts = {}
        every = []
        for string, doc_id in lowest.items():
            at = _offsets(string.split(b" "))
            cuts[string] = own = [string[at[i]:at[i + window] - 1] for i in range(len(at) - window)]
            every += [(part, doc_id) for part in own]
        every.sort()
        first: dict[bytes, int] = {}
        before = None
        for part, doc_id in every:  # the first of equal windows has the smallest id
            if part != before:
                first[part] = doc_id
            before = part
        for doc_id, text, start, string in bucket:
            hits = [start + i for i, part in enumerate(cuts[string]) if first[part] < doc_id]
            for i, hit in enumerate(hits):
                if i and hits[i - 1] == hit - 1:
                    out[-1][3] += 1
                else:
                    out.append([doc_id, text, hit, 1])

    def spans(out: list) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "_text", "start", "windows"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket, out = None, [], []
        for batch in batches:
            for least, *row in zip(*(batch.column(c).to_pylist() for c in ("least", "doc_id", "_text", "start", "string"))):
                if least != now and bucket:
                    settle(bucket, out)
                    bucket.clear()
                now = least
                bucket.append(tuple(row))
            if out:
                yield spans(out)
                out = []
        if bucket:
            settle(bucket, out)
            yield spans(out)
    return run


def repeats(docs: DataFrame, window: int = WINDOW, length: int = MINIMISER, crowd: int = CROWD, windows: int = WINDOWS) -> DataFrame:
    """doc_id, ``_text`` (the hash of the text), ``whole`` (it loses every word) and ``spans`` of (start, windows),
    for the documents that lose words."""
    ready(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"), "text").filter(
        "doc_id is not null")
    outlines = stage(texts.mapInArrow(
        _outlines(window, length), "doc_id long, _text long, n_words long, words binary, starts array<int>, least array<long>"), "outlines")
    long = outlines.filter(F.col("n_words") >= window)
    firsts = stage(long.groupBy("words").agg(F.min("doc_id").alias("lowest")), "firsts")
    # The runs follow from the words. Rows repeated whole, and their texts below, are folded before they meet.
    folded = long.groupBy("words", "doc_id").agg(
        F.collect_set("_text").alias("texts"), *[F.first(c).alias(c) for c in ("n_words", "starts", "least")])
    speakers = folded.join(firsts.withColumnRenamed("lowest", "doc_id"), ["words", "doc_id"], "left_semi").withColumn(
        "_text", F.explode("texts"))
    last = F.col("n_words") - (window - 1)
    runs = speakers.select(
        "doc_id", "_text", F.explode(F.arrays_zip("starts", "least", F.concat(
            F.slice("starts", 2, F.size("starts")), F.array(last.cast("int"))).alias("ends"))).alias("run"))
    runs = runs.select("doc_id", "_text", F.col("run.starts").alias("start"),
                       (F.col("run.ends") - F.col("run.starts")).alias("windows"), F.col("run.least").alias("least"))
    shared = runs.groupBy("least").agg(
        F.count(F.lit(1)).alias("n"), F.sum("windows").alias("all"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    spans = (
        runs.join(shared.select("least", ((F.col("n") > crowd) | (F.col("all") > windows)).alias("crowded")), "least")
        .groupBy("doc_id", "_text").agg(F.collect_list(F.struct("start", "windows", "least", "crowded")).alias("spans"))
    )
    strings = stage(texts.dropDuplicates(["doc_id", "_text"]).join(spans, ["doc_id", "_text"]).mapInArrow(
        _strings(window), "least long, crowded boolean, start int, windows int, digest binary, string binary, doc_id long, _text long"),
        "strings")
    bucketed = strings.filter("not crowded").repartition("least").sortWithinPartitions("least")
    from_buckets = bucketed.mapInArrow(_repeats(window), "doc_id long, _text long, start int, windows int")
    # Of equal strings that of the smallest id stands for all; the others lose it whole.
    crowds = strings.filter("crowded")
    firsts_of = crowds.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    single = stage(crowds.join(firsts_of, ["digest", "doc_id"], "left_semi").mapInArrow(
        _windows(window), "digest binary, start int, windows int, doc_id long, _text long"), "windows")
    partly = from_buckets.unionByName(_later(crowds)).unionByName(_later(single)).groupBy("doc_id", "_text").agg(
        F.collect_list(F.struct("start", "windows")).alias("spans")).withColumn("whole", F.lit(False))
    wholly = long.select("words", "doc_id", "_text").join(firsts, "words").filter("doc_id > lowest").select(
        "doc_id", "_text").distinct().withColumn("spans", F.lit(None).cast("array<struct<start:int,windows:int>>")).withColumn("whole", F.lit(True))
    return partly.unionByName(wholly)


def remove(docs: DataFrame, window: int = WINDOW, length: int = MINIMISER, crowd: int = CROWD) -> DataFrame:
    """``docs`` without the words that repeated windows cover, and n_words, n_removed, kept_sha256.

    A text that loses words becomes the others joined by one space; any other stays as it is.
    """
    docs = docs.drop(*RESULTS, *[c for c in docs.columns if c.startswith("_")])
    found = repeats(docs, window, length, crowd)
    found = found.withColumnsRenamed({"doc_id": "_doc", "_text": "_hash", "whole": "_whole", "spans": "_spans"})
    same = (F.col("doc_id").cast("long") == F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    joined = docs.join(found, same, "left")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_sha256", T.StringType())])
    names, arrow = docs.columns, to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_texts, results = [], []
            for text, whole, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "_whole", "_spans"))):
                words = (text or "").encode().split()
                keep = np.ones(len(words), dtype=bool)
                if whole:
                    keep[:] = False
                for span in spans or ():
                    keep[span["start"]:span["start"] + span["windows"] + window - 1] = False
                gone = len(words) - int(keep.sum())
                kept = b" ".join(w for w, k in zip(words, keep) if k) if gone else b" ".join(words)
                kept_texts.append(kept.decode() if gone else text)
                results.append((len(words), gone, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(kept_texts, arrow.field("text").type) if c == "text" else batch.column(c) for c in names]
            counts = list(zip(*results)) or [()] * 3
            columns += [pa.array(c, arrow.field(name).type) for c, name in zip(counts, RESULTS)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *RESULTS])

    return joined.select(*names, "_whole", "_spans").mapInArrow(run, schema)
