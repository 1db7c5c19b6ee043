"""Sharding, quality, mixing: against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from daybook.llm import mixing, quality, sharding
from daybook.llm.words import n_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(text or "")


def sharded(df, shards=8, load=1.0):
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.shard(df, F.col("doc_id"), [F.col("doc_id"), F.crc32(text).alias("crc")], shards, load_factor=load).collect()


def test_shards_take_every_row_once(docs, rows):
    found = sharded(docs)
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.crc) for r in found) == Counter((r[0], crc(r[1])) for r in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_rows_stay_home_until_a_shard_is_full(spark):
    ids = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    exact, loose = sharded(ids), sharded(ids, load=1.25)
    moved = lambda found: sum(r.shard != r.home_shard for r in found)
    assert moved(loose) < moved(exact) < 2000
    assert max(Counter(r.shard for r in loose).values()) <= 782
    full = {s for s, n in Counter(r.shard for r in loose).items() if n == 782}
    assert all(r.home_shard in full for r in loose if r.shard != r.home_shard)


def test_one_more_shard_moves_few_rows(spark):
    ids = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    eight, nine = ({r.doc_id: r.shard for r in sharded(ids, n, load=1.25)} for n in (8, 9))
    assert sum(eight[i] != nine[i] for i in eight) < 2500


def test_a_hot_key_is_spread(spark):
    ids = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("").alias("text"))
    sizes = Counter(r.shard for r in sharded(ids))
    assert set(sizes.values()) == {375}


def test_settle_is_the_walk_of_single_rows():
    nodes, room, cells, salts = [(1, 0), (3, 1), (6, 2), (9, 0)], [9, 7, 8], 12, 2
    counts = {(cell, salt): (cell * 7 + salt) % 3 for cell in range(cells) for salt in range(salts)}
    assert sum(counts.values()) <= sum(room)
    left, want = list(room), Counter()
    for salt in range(salts):
        for cell in range(cells):
            for _ in range(counts[cell, salt]):
                after = [s for c, s in nodes if c >= cell] + [s for _, s in nodes]
                shard = next(s for s in after if left[s])
                left[shard] -= 1
                want[cell, salt, shard] += 1
    got = Counter()
    for cell, salt, _, taken, shard, _ in sharding.settle(counts, nodes, room, cells, salts):
        got[cell, salt, shard] += taken
    assert got == want


def test_empty_table_has_no_shards(nothing):
    assert sharded(nothing) == []


def measured(text):
    words, lines = split(text), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered),
            sum(a == b for a, b in zip(words, words[1:])), (text or "").count("!!"))


def test_measures(docs, rows):
    found = quality.ledger(docs).select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), *quality.MEASURES).collect()
    assert Counter(map(tuple, found)) == Counter((r[0], zlib.crc32((r[1] or "").encode()), *measured(r[1])) for r in rows)


def test_policies_and_ablation(docs):
    ledger = quality.ledger(docs)
    rows = ledger.select("failures", quality.passes(quality.POLICY).alias("kept"), quality.passes(quality.BASE).alias("base")).collect()
    for row in rows:
        assert row.kept == (row.failures == 0)
        assert row.base == (row.failures & 3 == 0)
    for row in quality.ablation(ledger, quality.POLICY).collect():
        bit = 1 << quality.BITS[row.rule]
        assert row.failed == sum(bool(r.failures & bit) for r in rows)
        assert row.failed_alone == sum(r.failures == bit for r in rows)
        assert row.kept == sum(r.failures == 0 for r in rows)
        assert row.kept_without == sum(r.failures & ~bit == 0 for r in rows)


def test_ledger_replaces_clashing_columns(docs, nothing):
    clashing = docs.withColumn("n_words", F.lit("x")).withColumn("failures", F.lit(1)).withColumn("_words", F.lit(1)).withColumn("label", F.lit(2))
    found = quality.ledger(clashing)
    assert found.filter(quality.passes(quality.POLICY)).count() == quality.ledger(docs).filter("failures = 0").count()
    assert dict(found.dtypes)["n_words"] == "bigint" and "label" in found.columns
    assert quality.ledger(nothing).count() == 0


def test_a_filter_does_not_repeat_the_rules(docs):
    plan = quality.ledger(docs).filter(quality.passes(quality.POLICY))._jdf.queryExecution().optimizedPlan().toString()
    assert all("split(" not in line for line in plan.splitlines() if line.lstrip("+- :").startswith("Filter"))


def mixed(df):
    return mixing.mix(df.select("doc_id", "source", "text"), F.col("doc_id"), n_words(F.col("text"))).collect()


def water(sizes, share=1.5, most=2.0):
    """Targets by resharing step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        above = {s for s in free if unit * weight[s] >= most * sizes[s]}
        if not above:
            return target | {s: unit * weight[s] for s in free}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= above
    return target


def test_mix_comes_near_its_targets(docs, rows):
    found = mixed(docs)
    assert len(found) == len(rows)
    sizes, longest, taken = Counter(), Counter(), Counter()
    for r in found:
        sizes[r.source] += r.size
        longest[r.source] = max(longest[r.source], r.size)
        taken[r.source] += r.copies * r.size
        assert r.size == len(split(r.text)) and 0 <= r.copies <= 2 and (r.size or not r.copies)
    want = water(sizes)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for source, target in want.items():
        assert abs(taken[source] - target) <= longest[source] / 2 + 1e-6
    again = mixed(docs.repartition(3))
    key = lambda r: (r.doc_id, r.text, r.copies)
    once = {r[0] for r in rows if [x[0] for x in rows].count(r[0]) == 1}
    assert {key(r) for r in found if r.doc_id in once} == {key(r) for r in again if r.doc_id in once}


def test_each_document_keeps_its_probability(spark):
    ids = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "a").otherwise("b").alias("source"), F.lit(10).alias("size"))
    copies = Counter()
    for seed in range(6):
        rows = mixing.mix(ids, F.col("doc_id"), F.col("size"), weights=(1, 1), share=0.5, seed=seed).collect()
        assert sum(r.copies for r in rows) == 200
        copies.update({r.doc_id: r.copies for r in rows})
    # Half of 6 draws on average: nobody is always in or out by place.
    assert 1.2 < sum(copies[i] for i in range(20)) / 20 < 4.8 and len(set(copies.values())) > 3


def test_mix_of_nothing_and_clashing_names(docs, nothing):
    assert mixed(nothing) == []
    clashing = docs.select("doc_id", "source", *[F.lit(9).alias(c) for c in ("target", "taken", "_id", "blocks", "size")], "text")
    found = mixing.mix(clashing, F.col("doc_id"), n_words(F.col("text")))
    assert found.filter("taken = 9 and blocks = 9").count() == docs.count()
    wordless = docs.withColumn("text", F.lit(" "))
    assert {r.copies for r in mixed(wordless)} == {0}
