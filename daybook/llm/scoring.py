"""Log-likelihood of whole documents under a gated recurrent model trained on the corpus.

Counting covers every training document. The most frequent words, ``HEAD`` at most, go to all tasks; the
counts of the others are joined to the documents they occur in, word by word. The model knows the first words of the head, as many as the
corpus has and ``gated.WEIGHT_BYTES`` hold.
A word it doesn't know has the probability of the rare class times its share of the corpus's counts in that class.

Words are numbered once, into a staged table that training and scoring read. Training reads every training document once, in ``ROUNDS``
rounds over equal shares of them drawn by a hash. In a round every task trains the common weights on its documents, and the changes are
averaged by tokens: blocks of weights are shuffled and added up, and the driver sees one set of weights. A round's weights
are kept only if they score a ``CHECKED``-th of another round's training documents better than those before it, so that at worst the
untrained model is left, which knows the words' shares.

Null and empty texts are an end token alone. Rows with a null id are trained on and scored. Repeated rows count and are
scored each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm import gated
from daybook.llm.staging import stage
from daybook.llm.workers import ready

# Production parameters.
HEAD = 200_000
# Bytes of the longest word in the head, which so has a bounded size.
LONGEST = 64
SMOOTH = 0.1
ROUNDS = 2
CHECKED = 16
# No word holds a line break, so it stands for the end of a document.
END = b"\n"
# Tokens that a task holds at a time, in training and in scoring, where a step takes one token of every document held; documents
# from a length up are held apart from shorter ones, so that lanes are about as long as each other. Bytes of words that it counts at a time, bytes of text that it splits at a
# time unless one text has more, and blocks of weights.
_TOKENS = 1_000_000
_SCORED = 4_000_000
_LONG = 4_000
_COUNTED = 48 << 20
_BYTES = 8 << 20
_BLOCKS = 32


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, about ``_BYTES`` of text at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // _BYTES, prepend=0)) if len(sizes) else []
        for at, end in zip([0, *edges], [*edges, len(sizes)]):
            if at < end:
                yield batch.slice(int(at), int(end - at))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as in ``tokens`` but for the ends, one text's after the other's, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, lengths = lists.flatten(), np.diff(lists.offsets.to_numpy())
    filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not filled.all():
        words, lengths = words.filter(pa.array(filled)), np.bincount(np.repeat(np.arange(len(lengths)), lengths)[filled], minlength=len(lengths))
    return words.cast(pa.binary()), lengths.astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every token of ``docs``."""
    ready(docs.sparkSession)
    return docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, ends = [], 0, 0
    for batch in _slices(batches):
        held.append(_words(batch.column("text"))[0])
        size, ends = size + held[-1].nbytes, ends + batch.num_rows
        if size >= _COUNTED:
            yield _counted(held, ends)
            held, size, ends = [], 0, 0
    if ends:
        yield _counted(held, ends)


def _counted(words: list[pa.Array], ends: int) -> pa.RecordBatch:
    own = pc.value_counts(pa.chunked_array(words, pa.binary()))
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([own.field(0), pa.array([END], pa.binary())]), pa.concat_arrays([own.field(1), pa.array([ends], pa.int64())])], ["word", "n"])


@dataclass(frozen=True)
class Corpus:
    """What all tasks know of the counts: totals, and the head with the end token first."""
    tokens: int
    words: int
    head: tuple[bytes, ...]
    counts: np.ndarray

    def logs(self) -> np.ndarray:
        """log10 of the smoothed shares of the head."""
        return np.log10((self.counts + SMOOTH) / self.total())

    def total(self) -> float:
        return self.tokens + SMOOTH * (self.words + 1)

    def shares(self) -> np.ndarray:
        """Of the words that the model knows."""
        return (self.counts[:gated.WORDS] + SMOOTH) / self.total()

    def rare(self) -> float:
        """The share of all that the model doesn't know."""
        return max(1e-12, 1 - float(self.shares().sum()))


def survey(counts: DataFrame, head: int = HEAD) -> tuple[Corpus, Column]:
    """The corpus's totals and head, and a condition for the words outside the head.

    The head is all words of a usual length from some level of frequency up, so finding it takes no sort.
    """
    level = F.when(F.octet_length("word") <= LONGEST, F.floor(F.log2("n") * 16).cast("int")).otherwise(-1)
    is_end = F.col("word") == F.lit(END)
    levels = counts.filter(~is_end).groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).orderBy(F.col("level").desc()).collect()
    ends = counts.filter(is_end).agg(F.sum("n")).first()[0] or 0
    least, room = 1 << 30, head - 1
    for row in levels:
        if row.words > room or row.level < 0:
            break
        least, room = row.level, room - row.words
    rows = counts.filter(~is_end & (level >= least)).collect()
    rows.sort(key=lambda row: (-row.n, bytes(row.word)))
    corpus = Corpus(
        sum(row.tokens for row in levels) + ends, sum(row.words for row in levels) + (ends > 0),
        (END, *(bytes(row.word) for row in rows)), np.array([ends, *(row.n for row in rows)], dtype=np.int64))
    return corpus, ~is_end & (level < least)


def numbered(docs: DataFrame, corpus: Corpus, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc_id, held_out, text) with the words replaced by the model's numbers, their counts and logs, and the words outside the head; staged."""
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, rounds) * CHECKED)).cast("int").alias("draw")
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "held_out", draw, "text")
    return stage(named.mapInArrow(_numberer(corpus), "row long, doc_id long, held_out boolean, draw int, known binary, n_tokens long, n_known long, "
                                  "base_score double, in_class double, words array<binary>, times array<int>"), "numbered")


NUMBERED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("draw", pa.int32()), ("known", pa.binary()), ("n_tokens", pa.int64()),
    ("n_known", pa.int64()), ("base_score", pa.float64()), ("in_class", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])


def _numberer(corpus: Corpus):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, logs, rare = pa.array(corpus.head, pa.binary()), corpus.logs(), float(np.log10(corpus.rare()))
        size, seen = len(corpus.shares()), corpus.counts > 0
        for batch in _slices(batches):
            words, lengths = _words(batch.column("text"))
            coded = words.dictionary_encode()
            of_code = pc.fill_null(pc.index_in(coded.dictionary, value_set=head), -1).to_numpy(zero_copy_only=False)
            codes, lengths = coded.indices.to_numpy(), lengths + 1
            edges = np.append(0, np.cumsum(lengths))
            firsts, inside = edges[:-1], np.ones(edges[-1], bool)
            inside[edges[1:] - 1] = False
            # The end token, after each text's words, is the first of the head.
            numbers = np.zeros(edges[-1], np.int32)
            numbers[inside] = of_code[codes]
            in_head = numbers >= 0
            known = np.where(in_head & (numbers < size), numbers, np.int32(size)).astype("<u2")
            log = np.where(in_head, logs[numbers], 0.0)
            # A word of the rare class has its share of the class.
            in_class = np.add.reduceat(np.where(numbers >= size, log, 0.0), firsts) - rare * np.add.reduceat(known == size, firsts, dtype=np.int64)
            texts = np.repeat(np.arange(len(lengths)), lengths)
            strange, times = np.unique(texts[~in_head] * len(coded.dictionary) + codes[of_code[codes] < 0], return_counts=True)
            begins = np.searchsorted(strange, np.arange(len(lengths) + 1) * len(coded.dictionary)).astype(np.int32)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(begins), values)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(name) for name in ("row", "doc_id", "held_out", "draw")),
                pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(known)]),
                pa.array(lengths), pa.array(np.add.reduceat(in_head & seen[numbers], firsts, dtype=np.int64)), pa.array(np.add.reduceat(log, firsts)),
                pa.array(in_class), lists(coded.dictionary.take(pa.array(strange % max(1, len(coded.dictionary))))), lists(pa.array(times.astype(np.int32)))],
                schema=NUMBERED)
    return run


def train(rows: DataFrame, corpus: Corpus, rounds: int = ROUNDS) -> gated.Weights:
    """Weights after ``rounds`` averaged passes, which share out all of ``rows`` (draw, known) between them."""
    weights = gated.begin(corpus.shares(), corpus.rare())
    round_ = F.col("draw") % rounds
    for n in range(rounds):
        part = rows.filter(round_ == n).select("known")
        part = part.coalesce(max(1, round(part.rdd.getNumPartitions() / rounds)))
        sums = part.mapInArrow(_trainer(weights), "block int, tokens long, change binary").repartition("block").mapInArrow(
            _added, "block int, tokens long, change binary")
        blocks = {row.block: (row.tokens, np.frombuffer(row.change, "<f8")) for row in sums.collect()}
        if blocks:
            change = np.concatenate([blocks[b][1] / blocks[b][0] for b in range(_BLOCKS)])
            new = gated.restore(gated.flatten(weights) + change, weights)
            checks = rows.filter((round_ == (n + 1) % rounds) & (F.col("draw") < rounds)).select("known")
            # Few documents a partition would make narrow windows.
            checks = checks.coalesce(max(1, checks.rdd.getNumPartitions() // 4))
            gain = checks.mapInArrow(_gains(weights, new), "gain double").agg(F.sum("gain")).first()[0]
            if gain is None or gain > 0:
                weights = new
    return weights


def _pools(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """(row, numbers) of documents, about ``_SCORED`` tokens at a time; long ones apart from short ones."""
    pools: dict[bool, list] = {False: [], True: []}
    sizes = {False: 0, True: 0}
    for batch in batches:
        names = batch.schema.names
        rows = batch.column("row").to_pylist() if "row" in names else [None] * batch.num_rows
        for row, known in zip(rows, batch.column("known").to_pylist()):
            own = np.frombuffer(known, "<u2").astype(np.int32)
            long = len(own) >= _LONG
            pools[long].append((row, own))
            sizes[long] += len(own)
            if sizes[long] >= _SCORED:
                yield pools[long]
                pools[long], sizes[long] = [], 0
    yield from (pool for pool in pools.values() if pool)


def _gains(old: gated.Weights, new: gated.Weights):
    """How much likelier the documents are under the new weights."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pool in _pools(batches):
            own = [known for _, known in pool]
            gain = float(gated.score(new, own, 0).sum() - gated.score(old, own, 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([gain], pa.float64())], ["gain"])
    return run


def _trainer(weights: gated.Weights):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, held, size, total = gated.Trainer(weights), [], 0, 0
        for batch in batches:
            for known in batch.column("known").to_pylist():
                held.append(np.frombuffer(known, "<u2").astype(np.int32))
                size += len(held[-1])
                if size >= _TOKENS:
                    trainer.learn(held, 0)
                    held, size, total = [], 0, total + size
        if held:
            trainer.learn(held, 0)
            total += size
        if total:
            change = (gated.flatten(trainer.w) - gated.flatten(weights)).astype("<f4")
            parts = [part.tobytes() for part in np.array_split(change, _BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_BLOCKS), pa.int32()), pa.array([total] * _BLOCKS, pa.int64()), pa.array(parts, pa.binary())],
                ["block", "tokens", "change"])
    return run


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token-weighted sum of each block's changes."""
    sums: dict[int, np.ndarray] = {}
    weight: Counter[int] = Counter()
    for batch in batches:
        for block, n, change in zip(*(column.to_pylist() for column in batch.columns)):
            own = np.frombuffer(change, "<f4") * float(n)
            sums[block] = sums[block] + own if block in sums else own
            weight[block] += n
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([weight[b] for b in sums], pa.int64()),
         pa.array([own.astype("<f8").tobytes() for own in sums.values()], pa.binary())], ["block", "tokens", "change"])


def _scorer(weights: gated.Weights):
    """The log10 likelihood of each row's numbers."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pool in _pools(batches):
            found = gated.score(weights, [known for _, known in pool], 0) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.array([row for row, _ in pool], pa.int64()), pa.array(found, pa.float64())], ["row", "modelled"])
    return run


def likelihoods(docs: DataFrame, held_out: Column, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10 under the corpus's words) and score (under the
    model) of every row; learns from the rows that are not ``held_out``."""
    ready(docs.sparkSession)
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    training = docs.filter(~F.col("held_out"))
    counts = stage(word_counts(training), "words")
    corpus, outside = survey(counts, head)
    rows = numbered(docs, corpus, rounds)
    weights = train(rows.filter(~F.col("held_out")), corpus, rounds)
    modelled = stage(rows.select("row", "known").mapInArrow(_scorer(weights), "row long, modelled double"), "scored")
    strange = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    log = F.log10((F.coalesce("n", F.lit(0)) + SMOOTH) / corpus.total())
    extra = strange.join(counts.filter(outside), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * log).alias("extra"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("extra_known"))
    whole = rows.drop("words", "times", "known").join(modelled, "row").join(extra, "row", "left")
    more = F.coalesce("extra", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("extra_known", F.lit(0))).alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"),
        (F.col("modelled") + F.col("in_class") + more).alias("score"))
