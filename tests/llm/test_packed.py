"""Token ids, packing, token files, top-k search, the pipeline: against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from daybook.llm import export, packing, tokens, topk
from test_rows import measured, split
from test_texts import fingerprint, grouped, removed

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    own = Tokenizer.from_file(VOCABULARY)
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


ODD = st.text(st.sampled_from(list("aAbé ßİſǅΣς'’s.t,<|>\n\t\x0b\x1c\x1f\x85\xa0 ​́ŉ12%&#！你ﬁ\U0001f600")) | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_chunks_give_the_ids_of_the_whole_text(text):
    own = Tokenizer.from_file(VOCABULARY) if not hasattr(test_chunks_give_the_ids_of_the_whole_text, "own") else test_chunks_give_the_ids_of_the_whole_text.own
    test_chunks_give_the_ids_of_the_whole_text.own = own
    got = np.frombuffer(tokens.encoder(VOCABULARY).ids(text), "<u4").tolist()
    assert got == own.encode(text, add_special_tokens=False).ids


def test_memory_of_chunks_is_bounded(monkeypatch, whole):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    own = tokens.Encoder(VOCABULARY)
    text = "some words, that don't fit Into Five places. at all !!"
    assert np.frombuffer(own.ids(text) + own.ids(text), "<u4").tolist() == whole(text) * 2 and len(own) <= 6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_fills_the_fullest_that_takes_it(sizes):
    bins = packing.best_fit(sizes, 20)
    assert sorted(i for own in bins for i in own) == list(range(len(sizes)))
    rooms = []
    for size in sorted(sizes, reverse=True):  # the plain rule
        fitting = [i for i, room in enumerate(rooms) if room >= size]
        at = min(fitting, key=lambda i: rooms[i]) if fitting else len(rooms)
        rooms += [20] * (at == len(rooms))
        rooms[at] -= size
    assert sorted(20 - sum(sizes[i] for i in own) for own in bins) == sorted(rooms)


@pytest.mark.parametrize("chunk", [packing.CHUNK, 7])
def test_packing(docs, rows, whole, monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    found = packing.pack(packing.pieces(docs, VOCABULARY, capacity=256), capacity=256).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*whole(text), 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 256)):
            part = ids[at:at + 256]
            want[doc_id, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 256
    least = -(-sum(r.length for r in found) // 256)
    assert len(sequences) <= least * (1.05 if chunk > 7 else 1.2) + 1


def test_packing_what_never_pairs_ends(spark):
    cut = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                  F.lit(11).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    assert packing.pack(cut.repartition(6), capacity=20).select("sequence_id").distinct().count() == 300
    assert packing.pack(cut.limit(0), capacity=20).count() == 0


def test_packing_goes_on_to_one_partition(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    # One short piece in each of 16 places, all of which fit into one sequence and into none of the others.
    length = F.when(F.col("id") % 201 == 0, 6).otherwise(95).cast("long")
    cut = spark.range(0, 16 * 201, numPartitions=16).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), length.alias("length"),
        F.lit(1).cast("long").alias("ids_crc32"))
    assert packing.pack(cut, capacity=100).select("sequence_id").distinct().count() == 16 * 200 + 1


def test_token_files(spark, docs, rows, whole, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "SHARD_DOCS", 9)
    path = str(tmp_path / "tokens")
    export.write(docs.withColumn("part", F.lit(1)).withColumn("_tie", F.lit(1)), path, VOCABULARY)
    found = export.read(spark, path).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((r[0], (*whole(r[1]), 2)) for r in rows)
    at, before = 0, (False, 0)
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert before <= (r.doc_id is not None, r.doc_id or 0)
        at, before = at + r.n_tokens, (r.doc_id is not None, r.doc_id or 0)
    assert sorted(map(tuple, export.read_document(spark, path, 5))) == sorted((*whole(r[1]), 2) for r in rows if r[0] == 5)
    assert export.read_document(spark, path, 10_000) == []


def test_token_files_of_nothing(spark, nothing, tmp_path):
    export.write(nothing, str(tmp_path / "none"), VOCABULARY)
    assert export.read(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), min_size=1, max_size=30), max_size=8), st.sampled_from([2, 4]))
def test_shard_round_trip(documents, width):
    parts = [np.array(d, "<u4").tobytes() for d in documents]
    blob = export.build_shard(parts, width, b"")
    shard = export.Shard(blob, b"")
    assert shard.documents == len(documents) and [shard[i].tolist() for i in range(len(documents))] == documents
    with pytest.raises(ValueError):
        export.Shard(blob, b"another")


def brute(vectors, is_query, k=10):
    whole = []
    for vec_id, x in vectors:
        if vec_id is not None and x is not None and None not in x and np.isfinite(x).all():
            whole.append((vec_id, [int(v) for v in np.floor(1024 * np.array(x, dtype=np.float64))]))
    asked = {}
    for vec_id, x in vectors:
        if vec_id is not None and is_query(vec_id) and x is not None and None not in x and np.isfinite(x).all():
            asked[vec_id] = min(asked.get(vec_id, x), x)
    found = []
    for q, x in asked.items():
        x = [int(v) for v in np.floor(1024 * np.array(x, dtype=np.float64))]
        scores = sorted(((-min(max(sum(a * b for a, b in zip(x, y)), -2**63), 2**63 - 1), vec_id) for vec_id, y in whole if vec_id != q and len(y) == len(x)))[:k]
        found += [(q, n, vec_id, -s) for n, (s, vec_id) in enumerate(scores, 1)]
    return sorted(found)


@pytest.mark.parametrize("shard,leaf", [(4096, 64), (50, 4)])
def test_top_k(spark, monkeypatch, shard, leaf):
    draw = np.random.default_rng(3)
    vectors = [(int(i), draw.normal(0, 0.3, 6).astype(np.float32).tolist()) for i in range(400)]
    vectors += [(i, [0.5] * 6) for i in range(400, 700)]  # ties
    vectors += [(701, None), (None, [1.0] * 6), (702, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (703, [float("nan")] * 6), (720, [float("inf")] * 6),
                (704, [1.0, 2.0]), (740, [3.0, -2.0]), (760, []), (780, []), (20, [9.0] * 6), (20, vectors[20][1]), (33, vectors[33][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3).withColumn("shard", F.lit(1))
    monkeypatch.setattr(topk, "LEAF", leaf)
    got = topk.search(df, F.col("vec_id") % 20 == 0, shard=shard, block=16).collect()
    assert sorted(map(tuple, got)) == brute(vectors, lambda i: i % 20 == 0)


def test_top_k_of_huge_numbers_and_of_nothing(spark):
    vectors = [(i, [(-1.0) ** i * 10.0 ** (i * 3), 1.0]) for i in range(10)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    vectors = [tuple(r) for r in df.collect()]
    got = topk.search(df, F.col("vec_id") % 3 == 0, k=3).collect()
    assert sorted(map(tuple, got)) == brute(vectors, lambda i: i % 3 == 0, 3)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0
    assert topk.search(df.limit(1), F.lit(True)).count() == 0


def test_pipeline(spark, docs, rows):
    """Each stage against plain Python, on what the one before kept."""
    kept = docs.withColumn("failures", F.lit(0)).withColumn("copies", F.lit(0)).withColumn("doc", F.lit("d")).withColumn(
        "n_words", F.lit("w")).withColumn("_x", F.lit(1)).withColumn("spans", F.lit(2))
    columns, stages = kept.columns, dict(corpus_pipeline.STAGES)

    def run(name):
        nonlocal kept
        before, after = [tuple(r) for r in kept.collect()], stages[name](spark, kept, "")
        rows_after = [tuple(r) for r in after.collect()]
        if name != "best-fit packing":
            assert after.columns == columns
            kept = spark.createDataFrame(rows_after, kept.schema)
        return before, rows_after

    def good(text):
        n, chars, symbols, lines, repeats, covered, stutters, shouts = measured(text)
        return not (n < 20 or 100 * covered > 30 * n or 100 * symbols > 20 * n or 100 * repeats > 50 * lines or 100 * stutters > 30 * n
                    or 100 * shouts > 30 * n or chars > 40 * n)

    before, after = run("quality rules")
    assert Counter(after) == Counter(r for r in before if good(r[1])) and len(after) < len(before)
    before, after = run("SimHash near-dedup")
    roots = grouped({fingerprint(r[1]) for r in before}, 2)
    assert len(after) == len(set(roots.values())) < len(before) and not Counter(after) - Counter(before)
    before, after = run("substring dedup")
    want = removed(before)
    assert Counter((r[0], r[1]) for r in after) == Counter((r[0], want[r[:2]][3]) for r in before)
    assert all(r[4] == len(r[1]) for r in after if r[:2] not in {b[:2] for b in before})
    before, after = run("mixing")
    copies = Counter(after)
    assert set(copies) <= set(before) and all(n <= 2 * Counter(before)[r] for r, n in copies.items())
    taken = sum(len(split(r[1])) for r in after)
    assert abs(taken - 1.5 * sum(len(split(r[1])) for r in before)) <= 6 * max(len(split(r[1])) for r in before) / 2
    before, after = run("best-fit packing")
    assert Counter(r[0] for r in after if r[1] == 0) == Counter(r[0] for r in before)


def test_pipeline_runs_whole(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0 < found.count()


def test_rounds_take_on_only_what_can_still_be_joined(spark, monkeypatch):
    sizes = [1100] * 3000 + [1500] * 2000 + [700] * 40 + [900] * 3
    rows = [(n, 0, 0, size, n) for n, size in enumerate(sizes)]
    real, moved = packing.stage, []

    def noted(df, label):
        found = real(df, label)
        moved.append((label, found.count()))
        return found

    monkeypatch.setattr(packing, "stage", noted)
    monkeypatch.setattr(packing, "CHUNK", 500)
    found = packing.pack(spark.createDataFrame(rows, packing.PIECES).repartition(40)).collect()
    fills = Counter()
    for r in found:
        fills[r.sequence_id] += r.length
    assert sorted(r.length for r in found) == sorted(sizes) and max(fills.values()) <= 2048
    assert len(fills) == len(packing.best_fit(sizes, 2048)) == 5000
    assert all(n < 3100 for label, n in moved if label not in ("pack", "pack-0")) and len(moved) < 8
