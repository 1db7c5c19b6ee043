"""Language identification by rank-order profiles.

A profile is a language's most frequent runs of one to three characters, within words with a blank at either end, by
rank. A document's own ranking is compared to each profile: each of its runs costs the distance between
the two ranks, or ``RANKS`` where the profile lacks it, and the language that costs least is named, ties to the smaller name.

Profiles come from a sample of the labelled rows: about the ``SAMPLE`` with the smallest hashes of each language, and no more
than twice that. This bound is a parameter of the classifier; every labelled language is learned, and predictions read whole texts.

Null texts and texts without a letter are ``und`` with score 0, as is everything where nothing was learned.
Null labels teach nothing. Repeated rows are scored alike. An empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.staging import stage
from daybook.llm.workers import ready

# Production parameters.
SAMPLE = 1000
RANKS = 400
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a whole text, as numbers that order like their texts, and how often each comes."""
    words = _WORDS.findall((text or "").lower())
    if not "".join(words).isalpha():  # signs of numbers, such as a raised two, count among words but are no letters
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # Words side by side share the blank between them, which no run may have in its middle.
    side_by_side = f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(side_by_side, "<u4").astype(np.int64)
    letter = codes != ord(" ")
    two = (codes[:-1] << 42) + (codes[1:] << 21)
    three = (two[:-1] + codes[2:])[letter[1:-1]]
    return np.unique(np.concatenate([codes[letter] << 42, two, three]), return_counts=True)


def ranking(runs: np.ndarray, times: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent runs, ties in the order of their text."""
    if len(runs) > ranks:  # only those that can be among them are sorted
        enough = times >= np.partition(times, len(times) - ranks)[len(times) - ranks]
        runs, times = runs[enough], times[enough]
    return runs[np.argsort(-times, kind="stable")][:ranks]


class Profiles:
    """Profiles of all languages as one sorted table of runs, each with the languages that have it and its rank there."""

    def __init__(self, profiles: dict[str, list[int]], ranks: int = RANKS):
        self.names, self.ranks = sorted(profiles), ranks
        sizes = [len(profiles[name]) for name in self.names]
        every = np.fromiter((run for name in self.names for run in profiles[name]), dtype=np.int64, count=sum(sizes))
        order = np.argsort(every, kind="stable")
        self.runs, times = np.unique(every, return_counts=True)
        # Where a run's languages begin; a last one for runs that are in no profile, with none.
        self.first = np.concatenate([[0], np.cumsum(times), [len(every)]])
        self.languages = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.places = (np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[order]

    def name(self, text: str | None) -> tuple[str, float]:
        """The language and how much closer it is than no match at all, from 0 to 1."""
        own = ranking(*counts(text), self.ranks)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.runs, own)
        at[at == len(self.runs)] = 0
        at = np.where(self.runs[at] == own, at, len(self.runs))
        first, times = self.first[at], self.first[at + 1] - self.first[at]
        place = np.repeat(np.arange(len(own)), times)
        entry = np.arange(len(place)) + np.repeat(first - (np.cumsum(times) - times), times)
        # How much less than a run that is lacking each costs, in whole numbers.
        saved = np.bincount(self.languages[entry], self.ranks - np.abs(self.places[entry] - place), len(self.names))
        best = int(saved.argmax())
        return self.names[best], 1 - (self.ranks * len(own) - float(saved[best])) / (self.ranks * len(own))


def learn(labelled: DataFrame, sample: int = SAMPLE, ranks: int = RANKS) -> dict[str, list[int]]:
    """Profiles by language, from ``labelled`` (doc_id, text, lang): ``ranks`` numbers for each."""
    ready(labelled.sparkSession)
    labelled = labelled.filter("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    # A row for each language is sent to the texts, which stay where they are; its profile on the driver is larger.
    # Hashes below a share of their range that about one and a half samples fall in, then exactly no more than two.
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    drawn = (
        labelled.select("lang", "text", draw.alias("_draw")).join(F.broadcast(sizes), "lang")
        .filter(F.col("_draw") * F.col("_n") < 1.5 * sample)
        .withColumn("_place", F.row_number().over(Window.partitionBy("lang").orderBy("_draw"))).filter(F.col("_place") <= 2 * sample)
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[str, dict[int, int]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = totals.setdefault(lang, {})
                for code, n in zip(*(x.tolist() for x in counts(text))):
                    own[code] = own.get(code, 0) + n
            rows = [(lang, code, n) for lang, own in totals.items() for code, n in own.items()]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["lang", "run", "times"])

    totals = drawn.select("lang", "text").mapInArrow(run, "lang string, run long, times long").groupBy("lang", "run").agg(
        F.sum("times").alias("times"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("times").desc(), "run"))
    profiles: dict[str, list[int]] = {}
    for row in totals.withColumn("place", place).filter(F.col("place") <= ranks).orderBy("lang", "place").collect():
        profiles.setdefault(row.lang, []).append(row.run)
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], ranks: int = RANKS) -> DataFrame:
    """``docs`` with lang_pred and score; only ``text`` is looked at."""
    ready(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "text")]
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")

    known = Profiles(profiles, ranks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [known.name(text) for text in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([n for n, _ in named], pa.string()), pa.array([s for _, s in named], pa.float64())],
                [*names, "lang_pred", "score"])

    return docs.select(*names, "text").mapInArrow(run, schema)
