"""Repeated byte strings against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import packets, queries, suffixes


def brute(rows, window):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row."""
    lowest = {}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - window + 1):
                lowest[b[p:p + window]] = min(i, lowest.get(b[p:p + window], i))
    found = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - window + 1) if i is not None else ():
            if lowest[b[p:p + window]] < i:
                gone[p:p + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        found.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), kept))
    return Counter(found)


def got(found):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect())


@pytest.mark.parametrize("chunk", [suffixes.CHUNK, 5_000])
def test_rows_of_every_kind(docs, rows, chunk):
    found = suffixes.remove(docs.withColumns({"n_bytes": F.lit("x"), "_sha": F.lit(1), "chunk": F.lit(2)}), chunk=chunk, bucket=3_000)
    assert set(found.columns) == {*docs.columns, "chunk", *suffixes.RESULTS}
    assert got(found) == brute(rows, 50)


def test_nothing(nothing):
    assert suffixes.remove(nothing).collect() == []


def test_every_shift_and_overlap(spark):
    draw = random.Random(3)

    def noise(n):
        return "".join(draw.choices("abcé ", k=n))

    shared = [noise(50), noise(51), noise(90), noise(400)]
    texts = [noise(draw.randint(0, 80)) + draw.choice(shared) + noise(draw.randint(0, 60)) + draw.choice(shared) for _ in range(150)]
    texts += ["a" * 49, "a" * 50, "a" * 500, "ab" * 300, "a" * 20_000, *shared]
    ids = draw.sample(range(-100, 10_000), len(texts) - 3) + [7, 7, 8]
    rows = list(zip(ids, texts))
    for window in (50, 34):
        found = suffixes.remove(spark.createDataFrame(rows, "doc_id int, text string").repartition(6), window, chunk=9_000, bucket=2_000)
        assert got(found) == brute(rows, window)


def test_one_id_for_many_texts(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choices("abc ", k=300)) for _ in range(90)]
    rows = [(n if n % 3 else 50, t + texts[n // 2]) for n, t in enumerate(texts)]
    found = suffixes.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk=1_000, bucket=500)
    assert got(found) == brute(rows, 50)


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_SLICE", 700)
    draw = random.Random(4)
    noise = ["".join(draw.choices("abcdef", k=k)) for k in (3000, 5000, 900)]
    texts = [noise[0], noise[1] + noise[0][500:2500], noise[2] + noise[1], "x" + noise[2]]
    parts = [(n, text[first:first + length]) for body, parts in suffixes.Slices([t.encode() for t in texts], 50) for n, first, _, length in parts for text in [texts[n]]]
    assert {t[i:i + 50] for t in texts for i in range(len(t) - 49)} == {p[i:i + 50] for _, p in parts for i in range(len(p) - 49)}
    plan = suffixes.Plan(sum(map(len, texts)), 50)
    found = suffixes.Sampled([t.encode() for t in texts], 50, plan.names)
    assert len(found.names) == len(set(found.names.tolist())) and found.several.any()


def test_difference_cover():
    for period in (7, 13, 21, 27):
        found = suffixes.cover(period)
        assert {(a - b) % period for a in found for b in found} == set(range(period))
    assert [len(suffixes.cover(p)) for p in (7, 13, 21)] == [3, 4, 5]


def test_packets():
    draw = np.random.default_rng(1)
    for top in (1, 200, 1 << 40, (1 << 64) - 1):
        values = np.sort(draw.integers(0, top, 300, dtype=np.uint64, endpoint=True))
        assert np.array_equal(packets.restored(packets.ascending(values)), values)
        assert np.array_equal(packets.unpacked(packets.packed(values)), values)
    values = draw.integers(0, 32, 77, dtype=np.uint64)
    assert np.array_equal(packets.unbits(packets.bits(values, 5), 5, 77), values)
    flags = draw.random(77) < 0.3
    assert np.array_equal(packets.marks(packets.marked(flags), 77), flags)
    names = np.sort(draw.integers(0, 1 << 20, 500, dtype=np.uint64))
    assert np.array_equal(np.concatenate([names[s] for _, s in packets.dealt(names, 20, 4)]), names)
    assert all((names[s] >> np.uint64(16) == b).all() for b, s in packets.dealt(names, 20, 4))


def test_query(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_suffixes(spark, str(tmp_path)).collect()
    expected = Counter()
    for (i, n, gone, spans, kept), times in brute(rows, 50).items():
        expected[i, n, gone, spans, hashlib.sha256(kept).hexdigest()] += times
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == expected
