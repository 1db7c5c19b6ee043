"""Collocations against counts in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import collocations


def brute(rows, least, best):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = tuple(re.findall(r"[^ \t]+", piece))
            totals[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(words[i:i + size] for i in range(len(words) - size + 1))
    found = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        ranked = []
        for p, a in candidates.items():
            score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            longer = [f for q, f in candidates.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * f >= 80 * a for f in longer):
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:best], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("sizes", [{}, {"chunk": 4_000, "bucket": 1_000, "hot": 8}])
def test_rows_of_every_kind(docs, rows, sizes):
    found = collocations.mine(docs.withColumns({"times": F.lit("x"), "chunk": F.lit(1), "n": F.lit(2)}), least=4, best=50, **sizes)
    assert got(found) == brute(rows, 4, 50)


def test_nothing(nothing):
    assert collocations.mine(nothing).collect() == []


def test_hot_words_and_ties(spark):
    draw = random.Random(8)
    words = ["a"] * 30 + ["b"] * 10 + ["Éa", "c", "d", "1", "x-y", "'"] * 2
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 60))) + draw.choice(["", ".", "! \t", "\r\n", " ,a"]) for _ in range(300)]
    texts += ["one two three"] * 12 + ["a " * 500]
    rows = [(n, t, draw.choice(["en", None, "und", ""])) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for sizes in ({}, {"chunk": 1_500, "bucket": 500, "hot": 40}):
        assert got(collocations.mine(df, least=10, best=30, **sizes)) == brute(rows, 10, 30)


def test_multikey_quicksort(monkeypatch):
    draw = np.random.default_rng(2)
    for small in (1, 50, 10_000):
        monkeypatch.setattr(collocations, "_SMALL", small)
        columns = [draw.integers(1, 6, 2_000, dtype=np.uint64), draw.integers(0, 5, 2_000, dtype=np.uint64), draw.integers(0, 30, 2_000, dtype=np.uint64)]
        weights = draw.integers(1, 4, 2_000)
        expected = Counter()
        for n in range(2_000):
            for depth in range(1, 4):
                prefix = tuple(int(c[n]) for c in columns[:depth])
                if 0 not in prefix:
                    expected[prefix] += int(weights[n])
        found = {tuple(int(c[p]) for c in columns[:d]): w for p, d, w in collocations.multikey(columns, weights, 25)}
        assert found == {k: v for k, v in expected.items() if v >= 25}


def test_scrambling_can_be_undone():
    values = np.random.default_rng(3).integers(0, 1 << 63, 1_000, dtype=np.uint64)
    assert np.array_equal(collocations.unscrambled(collocations.scrambled(values)), values)
    assert collocations.tokens("Né!  Od\tx\n".encode()) == ["né".encode(), b"\xff", b"od", b"x", b"\xff", b"\xff"]
