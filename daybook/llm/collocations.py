"""Phrase collocations, by sorting suffix pointers by their leading words.

A text is cut into pieces and those into words; a suffix pointer is a place in a piece, read up to ``LONGEST`` words on. Equal
partitions of sorted pointers are phrases and their sizes are counts. A partition below ``LEAST`` is abandoned as soon as
that shows, so pointers are routed in rounds, each by more leading words and each with only those that can still matter:

1. by one word: frequent words get numbers, and pointers at other words stop;
2. by two words: pointers whose first two words are rare together stop;
3. the rest travel with four words to the bucket of their first two, where a multikey three-way quicksort goes on to full
   depth. If the first two words come more than ``HOT`` times, their pointers are dealt out by three words and by four instead, so
   that no partition has to meet in one place.

A chunk of about ``CHUNK`` bytes folds equal pointers into one with a count before it sends them and asks for words and pairs as packed
arrays (see ``packets``). Words are compared as bytes and then as numbers, never by hashes; scores are exact decimals.

A null lang is ``und``; null and empty texts have no words. Rows repeated whole count as often as they come. Ties in score and count go by phrase. Texts
of any length are read whole, a chunk has one at least. An empty table gives an empty one. Columns beside text and lang are not read, doc_id
only spreads the rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.packets import ascending, dealt, held, marked, marks, packed, restored, runs, unpacked
from daybook.llm.staging import let_go, stage
from daybook.llm.workers import ready

# Production parameters.
LEAST = 30
LONGEST = 4
BEST = 2000
SCALE = 2_000_000
COVERED = 80  # percent of a phrase's occurrences inside a longer one
CHUNK = 2_000_000
BUCKET = 64_000_000  # bytes of text
HOT = 1 << 20
SALTS = 16

# What ends a piece, what parts words.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b"\t"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes.maketrans(_UPPER + _ENDS + _BLANKS, _LOWER + b"\n" * len(_ENDS) + b" ")
# Bytes that UTF-8 never has: an end of a piece, a mark between words.
_STOP, _MARK = b"\xff", b"\xfe"
_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_EVEN = [np.uint64(pow(int(x), -1, 1 << 64)) for x in _ODD]
_SMALL = 1 << 14


def tokens(text: bytes) -> list[bytes]:
    """The words in order, with ``_STOP`` wherever a piece ends."""
    return (text.translate(_PLAIN) + b"\n").replace(b"\n", b" \xff ").split()


def scrambled(x: np.ndarray) -> np.ndarray:
    """Other 64-bit integers for ``x``, one for each, whose leading bits are even."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(32))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def unscrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _EVEN[1]
    x = (x ^ (x >> np.uint64(32))) * _EVEN[0]
    return x ^ (x >> np.uint64(32))


def multikey(columns: list[np.ndarray], weights: np.ndarray, least: int, depth: int = 0) -> Iterator[tuple[int, int, int]]:
    """Equal partitions of pointers by three-way quicksort, one column after the other: (a pointer in it, columns that agree, weight).

    Partitions lighter than ``least`` are abandoned, and pointers that have no word (0) at a depth go no deeper. Small partitions are
    sorted at once.
    """
    open_ = [(np.arange(len(weights)), depth)]
    while open_:
        pointers, at = open_.pop()
        if weights[pointers].sum() < least:
            continue
        if len(pointers) <= _SMALL:
            yield from _sorted_out(columns, weights, pointers, at, least)
            continue
        keys = columns[at][pointers]
        pivot = np.sort(keys[:: max(1, len(keys) // 31)])
        pivot = pivot[len(pivot) // 2]
        less, equal = keys < pivot, keys == pivot
        open_ += [(pointers[less], at), (pointers[~(less | equal)], at)]
        same = pointers[equal]
        weight = int(weights[same].sum())
        if pivot and weight >= least:
            yield int(same[0]), at + 1, weight
            if at + 1 < len(columns):
                open_.append((same, at + 1))


def _sorted_out(columns: list[np.ndarray], weights: np.ndarray, pointers: np.ndarray, at: int, least: int) -> Iterator[tuple[int, int, int]]:
    order = pointers[np.lexsort([c[pointers] for c in reversed(columns[at:])])]
    differ = np.zeros(len(order), dtype=bool)
    differ[0] = True
    word = np.ones(len(order), dtype=bool)
    for depth in range(at, len(columns)):
        keys = columns[depth][order]
        differ[1:] |= keys[1:] != keys[:-1]
        word &= keys > 0
        first = np.flatnonzero(differ)
        sums = np.add.reduceat(weights[order], first)
        for n in np.flatnonzero((sums >= least) & word[first]):
            yield int(order[first[n]]), depth + 1, int(sums[n])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_LONG, _BYTES = pa.int64(), pa.binary()
QUESTIONS = pa.schema([("bucket", _LONG), ("chunk", _LONG), ("names", _BYTES), ("more", _BYTES), ("counts", _BYTES)])
ASKED = "bucket long, chunk long, names binary, more binary, counts binary"
# Answers to chunks, and the frequent words and pairs themselves: one row is either.
WORDS = pa.schema([("chunk", _LONG), ("words", _BYTES), ("ids", _BYTES), ("lang", _BYTES), ("word", _BYTES), ("id", _LONG), ("f", _LONG), ("n", _LONG)])
WORDS_ROW = "chunk long, words binary, ids binary, lang binary, word binary, id long, f long, n long"
PAIRS = pa.schema([("chunk", _LONG), ("bucket", _LONG), ("often", _BYTES), ("hot", _BYTES), ("w1", _LONG), ("w2", _LONG), ("f", _LONG)])
PAIRS_ROW = "chunk long, bucket long, often binary, hot binary, w1 long, w2 long, f long"
PHRASES = pa.schema([("w1", _LONG), ("w2", _LONG), ("w3", _LONG), ("w4", _LONG), ("f", _LONG)])
PHRASES_ROW = "w1 long, w2 long, w3 long, w4 long, f long"


class Plan:
    """What all tasks must agree on."""

    def __init__(self, size: int, least: int, chunk: int, bucket: int, hot: int):
        self.least, self.hot = least, hot
        self.chunks = max(1, math.ceil(size / chunk))
        self.spread = max(4, (size // bucket).bit_length())

    # Words.

    def ask_words(self, key, rows):
        counts: dict[bytes, Counter] = defaultdict(Counter)
        for lang, text, times in _rows(rows):
            own = Counter(tokens(text))
            for word, n in own.items():
                counts[lang][word] += n * times
        dealt_out = defaultdict(list)
        for lang, own in counts.items():
            own.pop(_STOP, None)
            for word, n in own.items():
                dealt_out[zlib.crc32(word) & ((1 << self.spread) - 1)].append((lang + _STOP + word, n))
        number = key[0].as_py()
        found = []
        for bucket, own in dealt_out.items():
            own.sort()
            found.append((bucket, number, _MARK.join(w for w, _ in own), b"", packed(np.asarray([n for _, n in own], np.uint64))))
        return _table(found, QUESTIONS)

    def settle_words(self, key, rows):
        """Frequent words with their numbers, for the chunks that have them and as rows; all words of each lang."""
        asked = [(c, n.split(_MARK), unpacked(k).tolist()) for c, n, k in zip(*(rows.column(x).to_pylist() for x in ("chunk", "names", "counts")))]
        total: dict[bytes, int] = defaultdict(int)
        for _, words, counts in asked:
            for word, n in zip(words, counts):
                total[word] += n
        langs: Counter = Counter()
        for word, n in total.items():
            langs[word.partition(_STOP)[0]] += n
        often = sorted(w for w, n in total.items() if n >= self.least)
        ids = {w: (i << self.spread) + key[0].as_py() for i, w in enumerate(often, 1)}
        if len(ids) >> (32 - self.spread):
            raise OverflowError("more than 32 bits of frequent words")
        found = [(None, None, None, *w.partition(_STOP)[::2], i, total[w], None) for w, i in ids.items()]
        found += [(None, None, None, lang, None, None, None, n) for lang, n in langs.items()]
        for chunk, words, _ in asked:
            own = [w for w in words if w in ids]
            if own:
                found.append((chunk, _MARK.join(own), packed(np.asarray([ids[w] for w in own], np.uint64)), *[None] * 5))
        return _table(found, WORDS)

    # Pairs.

    def _numbered(self, rows: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's words as numbers, 0 for rare ones and ends of pieces, and how often each counts."""
        known: dict[bytes, dict[bytes, int]] = defaultdict(dict)
        for words, ids in zip(told.column("words").to_pylist(), told.column("ids").to_pylist()):
            if words is not None:
                for word, n in zip(words.split(_MARK), unpacked(ids).tolist()):
                    lang, _, word = word.partition(_STOP)
                    known[lang][word] = n
        numbers, weights = [], []
        for lang, text, times in _rows(rows):
            own = tokens(text)
            numbers.append(np.fromiter(map(known[lang].get, own, repeat(0)), dtype=np.uint64, count=len(own)))
            weights.append(np.full(len(own), times, dtype=np.int64))
        end = np.zeros(LONGEST, np.uint64)
        return np.concatenate([*numbers, end]), np.concatenate([*weights, end.astype(np.int64)])

    def _pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs of frequent words, and the pairs' names."""
        places = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
        return places, scrambled((numbers[places] << np.uint64(32)) | numbers[places + 1])

    def ask_pairs(self, key, rows, told):
        numbers, weights = self._numbered(rows, told)
        places, names = self._pairs(numbers)
        order = np.argsort(names)
        names = names[order]
        first = runs(names)
        if not len(first):
            return _table([], QUESTIONS)
        counts = np.add.reduceat(weights[places][order], first).astype(np.uint64)
        names, number = names[first], key[0].as_py()
        return _table([(b, number, ascending(names[s]), b"", packed(counts[s])) for b, s in dealt(names, 64, self.spread)], QUESTIONS)

    def settle_pairs(self, key, rows):
        asked = [(c, restored(n), unpacked(k)) for c, n, k in zip(*(rows.column(x).to_pylist() for x in ("chunk", "names", "counts")))]
        every, counts = (np.concatenate([a[i] for a in asked]) for i in (1, 2))
        order = np.argsort(every)
        every = every[order]
        first = runs(every)
        sums = np.add.reduceat(counts[order], first)
        often = sums >= self.least
        names, sums = every[first][often], sums[often]
        hot = names[sums > self.hot]
        pairs = unscrambled(names)
        found = [(c, key[0].as_py(), marked(held(names, n)), marked(held(hot, n)), None, None, None) for c, n, _ in asked]
        found += [(None, None, None, None, *row) for row in zip((pairs >> np.uint64(32)).tolist(), (pairs & np.uint64(0xFFFFFFFF)).tolist(), sums.tolist())]
        return _table(found, PAIRS)

    # Longer pointers.

    def ask_pointers(self, key, rows, told):
        numbers, weights = self._numbered(rows, told)
        places, names = self._pairs(numbers)
        distinct = np.unique(names)
        often, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        bits = {b: (o, h) for b, o, h in zip(*(told.column(x).to_pylist() for x in ("bucket", "often", "hot"))) if o is not None}
        for b, s in dealt(distinct, 64, self.spread):
            often[s], hot[s] = (marks(x, s.stop - s.start) for x in bits[b])
        at = np.searchsorted(distinct, names)
        alive = np.zeros(len(numbers), dtype=bool)
        alive[places] = often[at]
        go_on = alive[places] & alive[places + 1]
        places, names, at = places[go_on], names[go_on], at[go_on]
        third = numbers[places + 2]
        fourth = np.where(alive[places + 2], numbers[places + 3], np.uint64(0))
        names, rest, counts, crowded = _folded(names, (third << np.uint64(32)) | fourth, weights[places], hot[at])
        number, found = key[0].as_py(), []

        def send(kind: int, names: np.ndarray, rest: np.ndarray, counts: np.ndarray, route: np.ndarray) -> None:
            order = np.argsort(route, kind="stable")  # what has one route stays sorted
            names, rest, counts, route = names[order], rest[order], counts[order], route[order]
            for b, s in dealt(route, 64, self.spread):
                own = np.lexsort((rest[s], names[s]))
                found.append(((kind << 32) + b, number, ascending(names[s][own]), packed(rest[s][own]), packed(counts[s][own])))

        send(0, names[~crowded], rest[~crowded], counts[~crowded], names[~crowded])
        names, rest, counts = names[crowded], rest[crowded], counts[crowded]
        if len(names):
            low = np.uint64(0xFFFFFFFF)
            three = _folded(names, rest & ~low, counts.astype(np.int64), np.ones(len(names), bool))[:3]
            send(1, *three, scrambled(three[0] ^ scrambled(three[1])))
            four = (rest & low) > 0
            send(2, names[four], rest[four], counts[four], scrambled(names[four] ^ scrambled(rest[four])))
        return _table(found, QUESTIONS)

    def settle_pointers(self, key, rows):
        """Phrases of three and four words that are frequent; those that were dealt out by three or by four words have that length."""
        kind = key[0].as_py() >> 32
        asked = [(restored(n), unpacked(r), unpacked(k)) for n, r, k in zip(*(rows.column(x).to_pylist() for x in ("names", "more", "counts")))]
        names, rest, counts = (np.concatenate([a[i] for a in asked]) for i in range(3))
        columns = [names, rest >> np.uint64(32), rest & np.uint64(0xFFFFFFFF)]
        depths = {0: (2, 3), 1: (2,), 2: (3,)}[kind]
        found = []
        for pointer, depth, weight in multikey(columns, counts.astype(np.int64), self.least):
            if depth in depths:
                pair = int(unscrambled(names[pointer:pointer + 1])[0])
                found.append((pair >> 32, pair & 0xFFFFFFFF, int(columns[1][pointer]), int(columns[2][pointer]) if depth == 3 else 0, weight))
        return _table(found, PHRASES)


def _rows(rows: pa.Table) -> Iterator[tuple[bytes, bytes, int]]:
    langs, texts = (rows.column(c).cast(pa.large_binary()).to_pylist() for c in ("lang", "text"))
    return zip(langs, texts, rows.column("times").to_pylist())


def _folded(names: np.ndarray, rest: np.ndarray, counts: np.ndarray, flags: np.ndarray):
    """Equal pointers as one, sorted."""
    order = np.lexsort((rest, names))
    names, rest, counts, flags = names[order], rest[order], counts[order], flags[order]
    if not len(names):
        return names, rest, counts.astype(np.uint64), flags
    first = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (rest[1:] != rest[:-1])]))
    return names[first], rest[first], np.add.reduceat(counts, first).astype(np.uint64), flags[first]


def count(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK, bucket: int = BUCKET, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (id, lang, word, f), frequent phrases of two and more (ids, f), and all words of each lang (lang, n)."""
    ready(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    outline = stage(texts.select("doc_id", F.xxhash64("lang", "text").alias("h"), F.octet_length("text").alias("n")), "outline")
    plan = Plan(int(outline.agg(F.sum("n")).first()[0] or 0), least, chunk, bucket, hot)
    if outline.groupBy("doc_id", "h").count().filter("count > 1").isEmpty():
        texts = texts.withColumn("times", F.lit(1).cast("long"))
    else:  # rows repeated whole are folded, as they would meet in one chunk
        texts = texts.groupBy("doc_id", "lang", "text").agg(F.count(F.lit(1)).alias("times"))
    chunked = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.chunks)).cast("long").alias("chunk"), "lang", "text", "times").groupBy("chunk")

    words = stage(chunked.applyInArrow(lambda k, r: plan.ask_words(k, r), ASKED).groupBy("bucket").applyInArrow(
        lambda k, r: plan.settle_words(k, r), WORDS_ROW), "words")
    let_go(docs.sparkSession)
    told = words.filter("chunk is not null").select("chunk", "words", "ids")
    pairs = stage(chunked.cogroup(told.groupBy("chunk")).applyInArrow(lambda k, r, t: plan.ask_pairs(k, r, t), ASKED).groupBy("bucket").applyInArrow(
        lambda k, r: plan.settle_pairs(k, r), PAIRS_ROW), "pairs")
    let_go(docs.sparkSession)
    told = told.unionByName(pairs.filter("chunk is not null").select("chunk", "bucket", "often", "hot"), allowMissingColumns=True)
    longer = stage(chunked.cogroup(told.groupBy("chunk")).applyInArrow(lambda k, r, t: plan.ask_pointers(k, r, t), ASKED).groupBy("bucket").applyInArrow(
        lambda k, r: plan.settle_pointers(k, r), PHRASES_ROW), "phrases")
    let_go(docs.sparkSession)

    single = words.filter("id is not null").select("id", F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word"), "f")
    totals = words.filter("n is not null").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("n").alias("n"))
    phrases = pairs.filter("chunk is null").select(F.array("w1", "w2").alias("ids"), "f").unionByName(
        longer.select(F.filter(F.array("w1", "w2", "w3", "w4"), lambda w: w > 0).alias("ids"), "f"))
    return single, phrases, totals


def mine(docs: DataFrame, least: int = LEAST, best: int = BEST, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's ``best`` phrases."""
    single, phrases, totals = count(docs, least, **sizes)
    # The counts of both parts of every cut. A word begins or ends many phrases, so those lookups are salted.
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(ids, 1, k)").alias("first"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("rest"),
                       F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int").alias("salt"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    word_counts = single.select(F.array("id").alias("part"), "f", "lang", salts)

    def looked_up(rows: DataFrame, part: str, name: str) -> DataFrame:
        words = word_counts.select(F.col("part").alias(part), "salt", F.col("f").alias(name), *([F.col("lang")] if part == "first" else []))
        more = phrases.select(F.col("ids").alias(part), F.col("f").alias(name))
        one = rows.filter(F.size(part) == 1).join(words, [part, "salt"])
        return one.unionByName(rows.filter(F.size(part) > 1).join(more, part), allowMissingColumns=True)

    both = looked_up(looked_up(cuts, "first", "l"), "rest", "r")
    score = F.expr(f"(cast({SCALE} as decimal(20, 0)) * a) div (l + r)")
    scored = both.groupBy("ids").agg(
        F.first("a").alias("a"), F.max("lang").alias("lang"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # What a longer candidate holds whole: its parts of two words and more, with its count.
    spans = F.expr("flatten(transform(sequence(2, size(ids) - 1), w -> transform(sequence(1, size(ids) - w + 1), i -> slice(ids, i, w))))")
    inside = phrases.filter(F.size("ids") > 2).select(F.explode(F.array_distinct(spans)).alias("ids"), F.col("f").alias("longer"))
    inside = inside.groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, "ids", "left").filter(
        F.coalesce(F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(COVERED).cast("decimal(20,0)") * F.col("a"), F.lit(True)))
    kept = kept.select("ids", "lang", "a", "cut.l", "cut.r", "cut.score")
    # Phrases are spelled out for those in reach only; ties at the edge stay in.
    reach = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = stage(kept.withColumn("_rank", F.rank().over(reach)).filter(F.col("_rank") <= best).drop("_rank"), "near")
    spelled = near.select("ids", F.posexplode("ids").alias("at", "id")).join(single.select("id", "word"), "id").groupBy("ids").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.join(spelled, "ids").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
