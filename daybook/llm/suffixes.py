"""Repeated byte strings, by the distributed difference-cover form of suffix sorting, to the depth of a window.

Positions of a text whose remainder modulo ``PERIOD`` is in a difference cover are sampled: any two positions have a shift below
``PERIOD`` that takes both to sampled ones. Equal windows thus hold an equal sampled string of ``window - PERIOD + 1`` bytes:

1. Each sampled position is named by its triple of 8-byte words. Names are sorted in buckets; one that a single document holds is
   discarded there, and with it every suffix that needs it.
2. Names are triples again one level up: those at the start, middle and end of a window name its whole length. The remaining
   suffixes, those within a period before a sampled name that was kept, merge with the sampled ones in one sort of these names.
3. Adjacent equal names are equal prefixes, and the smallest doc_id of each keeps its own.

Suffixes aren't ordered beyond a window, and names are hashes: those of step 1 only discard, and those of step 2 have twice as
many bits as number the input's bytes and 8 more (which 128 bits allow for 10 ** 18 bytes).

A chunk is about ``CHUNK`` bytes of whole texts. It sends each distinct name once for each bucket and gets bits back (see
``packets``); within a chunk the smallest doc_id is found on the spot. So a passage in a third of all documents is one name for each
chunk. Chunks are ranges of doc_id, so that a name needs no ids beside it. Of equal texts the smallest doc_id travels on; the others lose all bytes if they have a window. A long text is read in
slices; what a task holds is at most some forty bytes for each byte of its longest text.

Rows are told apart by doc_id and the hash of their text. Rows with one doc_id don't take bytes from each other; those without an id keep
all bytes and take none. Null texts are empty. Rows repeated whole are folded first and get the same result.
An empty table gives an empty one. Other columns pass through ``remove``; those named like a result or with a leading underscore are replaced.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.packets import ascending, bits, bits_for, dealt, held, marked, marks, packed, restored, runs, unbits, unpacked
from daybook.llm.staging import let_go, stage, tasks
from daybook.llm.workers import ready

# Production parameters.
WINDOW = 50
PERIOD = 27
CHUNK = 4_000_000
BUCKET = 2_000_000  # names
BANDS = 1 << 14
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")

_WORD = 8
_SLICE = 1 << 17
_ONE = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_TWO = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


@functools.cache
def cover(period: int) -> tuple[int, ...]:
    """The first smallest difference cover: residues whose differences are all residues."""
    for size in itertools.count(2):
        for rest in itertools.combinations(range(2, period), size - 2):
            found = (0, 1, *rest)
            if len({(a - b) % period for a in found for b in found}) == period:
                return found


def _mixed(x: np.ndarray, odd: tuple) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= odd[1]
    x ^= x >> np.uint64(29)
    x *= odd[2]
    x ^= x >> np.uint64(32)
    return x


def _joined(parts: list[np.ndarray], odd: tuple) -> np.ndarray:
    """One name for each row of names or words."""
    name = parts[0] * odd[0]
    for part in parts[1:]:
        name = _mixed(name, odd)
        name += part * odd[0]
    return _mixed(name, odd)


def _offsets(length: int, step: int) -> list[int]:
    """Where pieces of ``step`` bytes begin that cover ``length`` bytes."""
    return [*range(0, length - step, step), length - step]


def _words(body: bytes) -> np.ndarray:
    return np.ndarray((len(body) - _WORD + 1,), dtype="<u8", buffer=body, strides=(1,))


def sampled_length(window: int) -> int:
    if window < PERIOD + _WORD - 1:
        raise ValueError(f"a window has at least {PERIOD + _WORD - 1} bytes")
    return window - PERIOD + 1


class Slices:
    """Texts laid end to end, about ``_SLICE`` bytes at a time; a longer one in slices that overlap by a window less one byte."""

    def __init__(self, texts: list[bytes], window: int):
        self.texts, self.window = texts, window

    def __iter__(self) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
        """A body and its parts: (number of the text, where the part begins in it, in the body, its length)."""
        parts, size = [], 0
        for n, text in enumerate(self.texts):
            for first in range(0, max(0, len(text) - self.window) + 1, _SLICE) if len(text) >= self.window else ():
                length = min(len(text) - first, _SLICE + self.window - 1)
                parts.append((n, first, size, length))
                size += length
                if size >= _SLICE:
                    yield self._body(parts)
                    parts, size = [], 0
        if parts:
            yield self._body(parts)

    def _body(self, parts):
        return b"".join(self.texts[n][first:first + length] for n, first, _, length in parts), parts


def _sampled(body: bytes, parts: list, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of a body, and the number of the part of each."""
    length = sampled_length(window)
    longest = max(p[3] for p in parts)
    every = (np.arange(0, longest, PERIOD)[:, None] + np.asarray(cover(PERIOD))).ravel()
    counts = np.searchsorted(every, [p[3] - length + 1 for p in parts])
    positions = np.concatenate([every[:n] + p[2] for n, p in zip(counts, parts)])
    return positions, np.repeat(np.arange(len(parts)), counts)


def _words_at(body: bytes, positions: np.ndarray, length: int) -> list[np.ndarray]:
    words = _words(body)
    return [words[positions + o] for o in _offsets(length, _WORD)]


class Sampled:
    """The sampled names of a chunk's texts: ``names``, distinct and sorted, and ``several``, those that come in more than one text."""

    def __init__(self, texts: list[bytes], window: int, bits: int):
        self.window, self.slices = window, list(Slices(texts, window))
        length, names, owners, self._positions = sampled_length(window), [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], []
        for body, parts in self.slices:
            positions, part = _sampled(body, parts, window)
            names.append(_joined(_words_at(body, positions, length), _ONE) >> np.uint64(64 - bits))
            owners.append(np.asarray([p[0] for p in parts], np.int32)[part])
            self._positions.append(positions)
        every, owner = np.concatenate(names), np.concatenate(owners)
        order = np.argsort(every)
        every, owner = every[order], owner[order]
        first = runs(every)
        self.names, self.several = every[first], np.zeros(0, bool)
        if len(first):
            self.several = np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first)
        self._number = np.empty(len(every), dtype=np.int32)
        self._number[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(every)))

    def windows(self, kept: np.ndarray, living: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows within a period before a name that is kept, of living texts: number of the text, start, and both halves of the window's name."""
        window, length, done = self.window, sampled_length(self.window), 0
        for (body, parts), positions in zip(self.slices, self._positions):
            alive = positions[kept[self._number[done:done + len(positions)]]]
            done += len(positions)
            if not len(alive):
                continue
            flags = np.zeros(len(body) + PERIOD, dtype=np.int32)
            flags[alive + 1] = 1
            sums = np.cumsum(flags, out=flags)
            begins = sums[PERIOD:] > sums[:len(body)]
            for text, _, at, size in parts:
                begins[at + (size - window + 1) * int(living[text]):at + size] = False
            starts = np.flatnonzero(begins)
            if not len(starts):
                continue
            # The triples that make up these windows, each named once.
            pieces, needed = _offsets(window, length), begins.copy()
            for o in pieces:
                needed[o:] |= begins[:len(begins) - o]
            place = np.cumsum(needed, dtype=np.int32)
            words = _words_at(body, np.flatnonzero(needed), length)
            lower = _joined(words, _ONE)
            high = _joined([lower[place[starts + o] - 1] for o in pieces], _ONE)
            lower = sum(w * k for w, k in zip(words, itertools.cycle(_TWO)))
            low = sum(lower[place[starts + o] - 1] * k for o, k in zip(pieces, itertools.cycle(_ONE)))
            at = np.asarray([p[2] for p in parts])
            part = np.searchsorted(at, starts, side="right") - 1
            yield np.asarray([p[0] for p in parts], np.int32)[part], starts - at[part] + np.asarray([p[1] for p in parts])[part], high, low


class Chunk:
    """The rows of a chunk in a fixed order, and its texts, each in the row with the smallest id."""

    def __init__(self, rows: pa.Table):
        ids, shas = rows.column("doc_id").to_pylist(), rows.column("_sha").cast(pa.binary()).to_pylist()
        texts = rows.column("text").cast(pa.large_binary()).to_pylist()
        self.rows = sorted(((i, s, t or b"") for i, s, t in zip(ids, shas, texts) if i is not None), key=lambda r: r[:2])
        seen: set[bytes] = set()
        self.firsts = [r for r in self.rows if not (r[1] in seen or seen.add(r[1]))]
        self.ids = np.asarray([r[0] for r in self.firsts], dtype=np.int64)
        self.texts = [r[2] for r in self.firsts]


class Plan:
    """What all tasks must agree on: sizes of names and numbers of buckets, from the size of the input.

    ``apart``: chunks are ranges of doc_id in order, so that the number of a chunk stands for the ids of its documents.
    """

    def __init__(self, size: int, window: int, bucket: int = BUCKET, apart: bool = False):
        self.window, self.apart = window, apart
        self.names = bits_for(size, 10)
        self.spread = max(4, (size * len(cover(PERIOD)) // PERIOD // bucket).bit_length())
        self.low = min(64, max(1, 2 * max(1, size).bit_length() + 8 - 64))
        self.windows = max(4, (size // 4 // bucket).bit_length())

    def ask_names(self, key, rows):
        found = Sampled(Chunk(rows).texts, self.window, self.names)
        number = key[0].as_py()
        return _table([(b, number, ascending(found.names[s]), marked(found.several[s])) for b, s in dealt(found.names, self.names, self.spread)], NAMES)

    def settle_names(self, key, rows):
        """For each question, which of its names come in several documents."""
        asked = [(c, restored(n), s) for c, n, s in zip(*(rows.column(x).to_pylist() for x in ("chunk", "names", "several")))]
        every = np.sort(np.concatenate([n for _, n, _ in asked]))
        often = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(n[marks(s, len(n))] for _, n, s in asked)]))
        return _table([(c, key[0].as_py(), marked(held(often, n))) for c, n, _ in asked], ANSWERS)

    def _remaining(self, rows: pa.Table, answers: pa.Table):
        """The chunk, and its windows that remain, sorted by name: number of the text, start, halves of the name, first of each name; and the
        smallest ids of texts that other documents have."""
        answered, lowest = {}, {}
        for bucket, answer in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
            if bucket < 0:
                lowest[answer[:32]] = int(answer[32:])
            else:
                answered[bucket] = answer
        chunk = Chunk(rows)
        sampled = Sampled(chunk.texts, self.window, self.names)
        kept = np.zeros(len(sampled.names), dtype=bool)
        for b, s in dealt(sampled.names, self.names, self.spread):
            kept[s] = marks(answered[b], s.stop - s.start)
        living = np.asarray([i <= lowest.get(sha, i) for i, sha, _ in chunk.firsts], dtype=bool)
        found = list(sampled.windows(kept, living))
        del sampled
        kinds = (np.int32, np.int64, np.uint64, np.uint64)
        text, start, high, low = (np.concatenate([np.zeros(0, k), *(f[i] for f in found)]) for i, k in enumerate(kinds))
        del found
        low >>= np.uint64(64 - self.low)
        order, first = _grouped(high, low)
        return chunk, text[order], start[order], high[order], low[order], first, lowest

    def ask_windows(self, key, rows, answers):
        chunk, text, _, high, low, first, _ = self._remaining(rows, answers)
        if not len(first):
            return _table([], WINDOWS)
        least = chunk.ids[np.minimum.reduceat(text, first)]  # texts lie in the order of their ids
        high, low = high[first], low[first]
        number = key[0].as_py()
        found = []
        for b, s in dealt(high, 64, self.windows):
            ids = least[s]
            base = number if self.apart else int(ids.min())
            found.append((b, number, ascending(high[s]), bits(low[s], self.low), base, b"" if self.apart else packed((ids - base).astype(np.uint64))))
        return _table(found, WINDOWS)

    def settle_windows(self, key, rows):
        """For each question, which of its windows begin in a document with a smaller id elsewhere."""
        asked = []
        for chunk, high, low, base, ids in zip(*(rows.column(c).to_pylist() for c in ("chunk", "high", "low", "base", "ids"))):
            high = restored(high)
            own = unpacked(ids).astype(np.int64) + base if ids else np.full(len(high), base)
            asked.append((chunk, high, unbits(low, self.low, len(high)), own))
        high, low, ids = (np.concatenate([a[k] for a in asked]) for k in (1, 2, 3))
        order, first = _grouped(high, low)
        own = ids[order]
        least = np.repeat(np.minimum.reduceat(own, first), np.diff(first, append=len(high)))
        later = np.zeros(len(ids), dtype=bool)
        later[order] = own > least
        edges = np.cumsum([0, *(len(a[1]) for a in asked)])
        return _table([(a[0], key[0].as_py(), marked(later[i:j])) for a, i, j in zip(asked, edges, edges[1:])], ANSWERS)

    def cut(self, key, rows, answers):
        """The rows that lose bytes."""
        second = np.asarray(answers.column("bucket").to_pylist(), dtype=np.int64) >= self._second
        chunk, text, start, high, _, first, lowest = self._remaining(rows, answers.filter(pa.array(~second)))
        later = np.zeros(len(first), dtype=bool)
        replies = answers.filter(pa.array(second))
        replies = dict(zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()))
        for b, s in dealt(high[first], 64, self.windows):
            later[s] = marks(replies[b + self._second], s.stop - s.start)
        sizes = np.diff(first, append=len(high))
        least = np.repeat(np.minimum.reduceat(text, first), sizes) if len(first) else np.zeros(0, np.int32)
        gone = (chunk.ids[text] > chunk.ids[least]) | np.repeat(later, sizes)
        text, start = text[gone], start[gone]
        order = np.lexsort((start, text))
        text, start = text[order], start[order]
        found = []
        for n, i in zip(*np.unique(text, return_index=True)):
            doc_id, sha, whole = chunk.firsts[n]
            spans = _spans(start[i:np.searchsorted(text, n, side="right")], self.window)
            found.append((doc_id, sha, spans, _without(whole, spans)))
        seen = set()
        for doc_id, sha, whole in chunk.rows:  # those that a smaller id stands for
            lowest.setdefault(sha, doc_id)
            if doc_id > lowest[sha] and len(whole) >= self.window and (doc_id, sha) not in seen:
                found.append((doc_id, sha, [(0, len(whole))], b""))
                seen.add((doc_id, sha))
        return _table([(i, sha, [{"start": a, "length": n} for a, n in spans], kept) for i, sha, spans, kept in found], LOSSES)

    @property
    def _second(self) -> int:
        """Buckets of windows are numbered above those of names."""
        return 1 << self.spread


def _grouped(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of names by their halves, and where each begins in it."""
    order = np.argsort(high)
    sorted_, lower = high[order], low[order]
    if np.any((sorted_[1:] == sorted_[:-1]) & (lower[1:] != lower[:-1])):
        order = np.lexsort((low, high))
        sorted_, lower = high[order], low[order]
    if not len(order):
        return order, np.zeros(0, np.int64)
    return order, np.flatnonzero(np.concatenate([[True], (sorted_[1:] != sorted_[:-1]) | (lower[1:] != lower[:-1])]))


def _spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows at sorted ``starts`` cover: start, length."""
    apart = np.flatnonzero(np.diff(starts) > window) + 1
    first, last = starts[np.concatenate([[0], apart])], starts[np.concatenate([apart - 1, [len(starts) - 1]])]
    return list(zip(first.tolist(), (last + window - first).tolist()))


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for start, length in spans for x in (start, start + length)), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


NAMES = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("names", pa.binary()), ("several", pa.binary())])
WINDOWS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("base", pa.int64()), ("ids", pa.binary())])
ANSWERS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
LOSSES = pa.schema([("doc_id", pa.int64()), ("_sha", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                    ("kept", pa.binary())])
_TYPES = {
    "names": "bucket long, chunk long, names binary, several binary",
    "windows": "bucket long, chunk long, high binary, low binary, base long, ids binary",
    "answers": "chunk long, bucket long, bits binary",
    "losses": "doc_id long, _sha binary, spans array<struct<start:long,length:long>>, kept binary",
}


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def text_hash() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def bands(outline: DataFrame, count: int) -> Column:
    """The number of the range that a doc_id falls in, of about ``count`` at most ``BANDS`` ranges, in order.

    Edges come from a sample of some ``4 * BANDS`` ids by their hash; it decides on sizes alone.
    """
    count = min(count, BANDS)
    rows = outline.count()
    drawn = outline.filter(F.pmod(F.xxhash64("doc_id", "_sha"), F.lit(1 << 32)) <= (1 << 32) * min(1.0, 4 * BANDS / max(1, rows)))
    ids = sorted(row[0] for row in drawn.select("doc_id").collect())
    edges = sorted({ids[i * len(ids) // count] for i in range(1, count)}) if ids else []
    step = max(1, math.isqrt(len(edges)))
    groups = [edges[i:i + step] for i in range(0, len(edges), step)]
    heads, inner = (F.from_json(F.lit(json.dumps(x)), kind) for x, kind in (([g[0] for g in groups], "array<bigint>"), (groups, "array<array<bigint>>")))
    group = F.size(F.filter(heads, lambda e: e <= F.col("doc_id")))
    return F.when(group == 0, 0).otherwise(
        (group - 1) * step + F.size(F.filter(F.element_at(inner, F.greatest(group, F.lit(1))), lambda e: e <= F.col("doc_id"))))


def repeats(docs: DataFrame, window: int = WINDOW, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, ``_sha`` (the hash of the text), ``spans`` of (start, length) and ``kept`` (the other bytes) for the documents that lose bytes."""
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("_sha"), "text")
    outline = stage(docs.select("doc_id", "_sha", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")), "outline")
    named = outline.filter("doc_id is not null")
    docs = docs.filter("doc_id is not null")
    if not named.groupBy("doc_id", "_sha").count().filter("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "_sha"])
        named = named.dropDuplicates(["doc_id", "_sha"])
    size = int(named.agg(F.sum("n")).first()[0] or 0)
    band = bands(named, math.ceil(size / chunk))
    # A range that holds more, as all rows with one id do, is dealt out in parts.
    parts = math.ceil((named.groupBy(band.alias("band")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) / (4 * chunk)) or 1
    plan = Plan(size, window, bucket, apart=parts == 1)
    number = (band * parts + F.pmod(F.xxhash64("_sha"), F.lit(parts))).cast("long").alias("chunk")
    chunked = docs.select("*", number)
    # Equal texts: the smallest id of each, for the chunks that hold another one. They meet in parts, as they may be many.
    copies = named.select("doc_id", "_sha", number, F.pmod(F.xxhash64("doc_id"), F.lit(tasks(docs))).alias("salt"))
    parts = copies.groupBy("_sha", "salt").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    lowest = parts.groupBy("_sha").agg(F.min("a").alias("lowest"), F.max("b").alias("b")).filter("lowest < b")
    known = parts.select("_sha", "salt").join(lowest.select("_sha", "lowest"), "_sha")
    told = copies.join(known, ["_sha", "salt"]).filter("doc_id > lowest").select(
        "chunk", F.lit(-1).cast("long").alias("bucket"), F.concat("_sha", F.col("lowest").cast("string").cast("binary")).alias("bits")).distinct()
    names = chunked.groupBy("chunk").applyInArrow(lambda key, rows: plan.ask_names(key, rows), _TYPES["names"])
    answers = names.groupBy("bucket").applyInArrow(lambda key, rows: plan.settle_names(key, rows), _TYPES["answers"])
    first = stage(answers.unionByName(told), "answers")
    let_go(docs.sparkSession)  # the names have been answered
    windows = chunked.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(
        lambda key, rows, told: plan.ask_windows(key, rows, told), _TYPES["windows"])
    second = windows.groupBy("bucket").applyInArrow(lambda key, rows: plan.settle_windows(key, rows), _TYPES["answers"]).withColumn(
        "bucket", F.col("bucket") + (1 << plan.spread))
    return chunked.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(
        lambda key, rows, told: plan.cut(key, rows, told), _TYPES["losses"])


def remove(docs: DataFrame, window: int = WINDOW, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept``, the bytes that no repeated window covers (binary: a cut may fall inside a character)."""
    docs = docs.drop(*RESULTS, *[c for c in docs.columns if c.startswith("_")])
    found = repeats(docs, window, chunk, bucket).withColumnsRenamed({"doc_id": "_doc", "_sha": "_hash", "spans": "_spans", "kept": "_kept"})
    joined = docs.join(found, (F.col("doc_id").cast("long") == F.col("_doc")) & (text_hash() == F.col("_hash")), "left")
    return joined.select(*docs.columns, *counted(F.coalesce(F.octet_length("text"), F.lit(0))), F.coalesce(
        "_kept", F.coalesce("text", F.lit("")).cast("binary")).alias("kept"))


def counted(n_bytes: Column) -> list[Column]:
    """n_bytes, n_removed, n_spans of rows joined with ``_spans``."""
    gone = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return [n_bytes.cast("long").alias("n_bytes"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce(F.size("_spans"), F.lit(0)).cast("long").alias("n_spans")]
