"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is to be taken the same number of times on average: the target of
its source over the source's words. The whole part of that number is certain. The fractions are rounded so
that a source's words hardly change: two documents meet, words of probability pass from one to the other
until one of the two is in or out for certain, and the other goes on with what is left. The direction is
drawn so that each keeps its probability. Words taken from a source so differ from its target by half of one
document's words at most: the one that is left alone in the end is not drawn but goes to the nearer side.

Documents meet in blocks of about ``BLOCK``, and each block sends on the one that is left, so the
tree has few levels, a block is bounded, and a hot source is many blocks. In a block the longest meet first,
so that the one left over is short. Draws are hashes of the
seed and the two documents' numbers, which are staged: reruns over the same rows in the same order agree,
and so does every retry.

A null text has no words; documents without words are never taken. A null source is a source, the
last. Repeated rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.staging import running, stage

# Production parameters of the mix.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 48
SEED = 17


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Of ``sizes`` (source, size) one row for each source: source, source_size, target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all
    words. A target stops at ``most`` times its source; what it leaves is shared
    among the rest by weight, until none is above. Sources need not be few: each pass is one
    aggregate over a row for each source, and there are as many passes as sets of sources that stop.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    numbered = running(by_source, order, F.lit(1).cast("long"), "_rank", "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    staged = stage(numbered.select("source", "source_size", weight.alias("_weight")), "sources")
    cap = F.lit(most) * F.col("source_size")
    total = staged.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        stops = F.lit(level) * F.col("_weight") >= cap
        row = staged.agg(F.count_if(stops), F.sum(F.when(stops, cap)), F.sum(F.when(~stops, F.col("_weight")))).first()
        if row[0] == stopped or not row[2]:
            break
        stopped, level = row[0], max(0.0, share * total - (row[1] or 0.0)) / row[2]
    return staged.select("source", "source_size", F.least(cap, F.lit(level) * F.col("_weight")).alias("target"))


def mix(docs: DataFrame, key: Column, size: Column, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        most: float = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` (with a column ``source``) with size, source_size, target and ``copies``, all but the
    last two long; columns of ``docs`` with these names or a leading underscore are replaced.

    ``key`` names a document for the draws. All columns are staged and shuffled once.
    """
    docs = docs.drop("source_size", "target", "copies", *[c for c in docs.columns if c.startswith("_")])
    numbered = stage(docs.withColumns({
        "size": size.cast("long"), "_key": F.xxhash64(key), "_id": F.monotonically_increasing_id()}), "mix")
    goals = stage(targets(numbered.select("source", "size"), weights, share, most), "targets")
    open_sizes = numbered.filter("size > 0").select("source", "size", "_key", "_id")
    # Rows with a key of their own meet by the key, whatever the partitions; others are told apart by number.
    again = open_sizes.groupBy("_key").count().filter("count > 1").select("_key", F.lit(True).alias("_again"))
    counts = open_sizes.groupBy(F.col("source").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    rates = goals.join(counts, F.col("source").eqNullSafe(F.col("_of"))).select(
        "_of", _rate().alias("_rate"), F.ceil(F.col("_n") / BLOCK).cast("long").alias("blocks"))
    fraction = F.col("_rate") - F.floor("_rate")
    level = (
        open_sizes.join(rates, F.col("source").eqNullSafe(F.col("_of"))).filter(fraction > 0)
        .join(again, "_key", "left")
        .select("source", "blocks", F.struct(
            (-F.col("size")).alias("order"), F.col("_key").alias("key"), F.when(F.col("_again"), F.col("_id")).otherwise(0).alias("twin"),
            F.col("_id").alias("id"), F.col("size").cast("double").alias("size"), fraction.alias("p")).alias("item")))
    blocks = rates.agg(F.max("blocks")).first()[0] or 0
    decided, depth = [], 0
    while blocks:
        block = F.pmod(F.xxhash64(F.lit(seed), F.lit(depth), "item.key", "item.twin"), F.col("blocks"))
        folded = stage(
            level.groupBy("source", block.alias("block"))
            .agg(F.max("blocks").alias("blocks"), _fold(F.sort_array(F.collect_list("item")), seed).alias("end")),
            f"mix-{depth}")
        decided.append(folded.select(F.explode("end.decided").alias("d")).select("d.*"))
        level = folded.select("source", F.ceil(F.col("blocks") / BLOCK).cast("long").alias("blocks"), F.col("end.rest").alias("item"))
        depth, blocks = depth + 1, 0 if blocks == 1 else -(-blocks // BLOCK)
    # One document of each source is left with a fraction: it goes to the nearer side.
    decided.append(level.select(F.col("item.id").alias("id"), (F.col("item.p") > 0.5).cast("int").alias("taken")))
    taken = reduce(DataFrame.unionByName, decided).withColumnsRenamed({"id": "_id", "taken": "_taken"})
    goals = goals.withColumnRenamed("source", "_of")
    whole = F.floor(_rate())
    return (
        numbered.join(goals, F.col("source").eqNullSafe(F.col("_of"))).join(taken, "_id", "left")
        .withColumn("copies", F.when(F.col("size") > 0, whole + F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long"))
        .drop("_id", "_key", "_of", "_taken")
    )


def _rate() -> Column:
    """How often a source's documents are taken on average."""
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def _draw(seed: int, *of: Column) -> Column:
    """A number from 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / F.lit(float(1 << 53))


def _fold(items: Column, seed: int) -> Column:
    """``items`` met in order: those ``decided`` as (id, taken), and the ``rest``."""
    start = F.struct(
        F.lit(None).cast("struct<order:bigint,key:bigint,twin:bigint,id:bigint,size:double,p:double>").alias("rest"),
        F.array().cast("array<struct<id:bigint,taken:int>>").alias("decided"))

    def meet(state: Column, b: Column) -> Column:
        a = state["rest"]
        mass = lambda x: x["p"] * x["size"]
        room = lambda x: (1 - x["p"]) * x["size"]
        up, down = F.least(room(a), mass(b)), F.least(mass(a), room(b))
        rises = _draw(seed, a["key"], b["key"], a["twin"], b["twin"]) * (up + down) < down
        moved = F.when(rises, up).otherwise(-down)
        # What a gains b loses. The one that reaches 0 or 1 is decided.
        a_ends = F.when(rises, room(a) <= mass(b)).otherwise(mass(a) <= room(b))
        ended = F.when(a_ends, F.struct(a["id"].alias("id"), rises.cast("int").alias("taken"))).otherwise(
            F.struct(b["id"].alias("id"), (~rises).cast("int").alias("taken")))
        goes_on = F.when(a_ends, _with_p(b, b["p"] - moved / b["size"])).otherwise(_with_p(a, a["p"] + moved / a["size"]))
        return F.when(a.isNull(), F.struct(b.alias("rest"), state["decided"].alias("decided"))).otherwise(
            F.struct(goes_on.alias("rest"), F.concat(state["decided"], F.array(ended)).alias("decided")))

    return F.aggregate(items, start, meet)


def _with_p(item: Column, p: Column) -> Column:
    return F.struct(item["order"].alias("order"), item["key"].alias("key"), item["twin"].alias("twin"), item["id"].alias("id"), item["size"].alias("size"),
                    F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))
