"""A Merkle manifest of a dataset, built as a log in postorder.

Every row is a leaf of its tree (its source); the roots of all trees are the leaves of the tree above them. ``FAN`` consecutive
nodes of a level become one node of the next, the last run with what is left of it, until one node remains.

Builders are aligned: each takes ``BLOCK`` nodes that form whole subtrees and writes them and the nodes above them, in the
order in which they are completed, to its segment of the log. Where a node lies follows from sizes alone: before it come its
own subtree and those that ended earlier (``position``). So a proof is read from a segment by the places of the siblings,
without looking for any. Segments are rounds of their own, each 256 times smaller than the one before, and paths are handed
down them again; no task holds more than a segment, whatever a tree's size.

A null column is hashed as ``-``. Rows without a tree form the first one. Leaves ascend by key, those without one first; rows with one
key ascend by leaf, so that repeated rows are equal leaves side by side. Empty and very long texts are hashed whole.
An empty table has no rows in its manifest. ``proofs`` reads named columns alone; others may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.staging import stage, tasks

FAN = 16
#: Nodes that a builder begins with: two levels of the tree above them.
BLOCK = FAN * FAN
PATH = "array<struct<left:string,right:string>>"


def digest(*columns: Column) -> Column:
    """The hash of one row: each value as ``bytes:value``, ``-`` if null."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(field, columns)), 256)


def position(level: int, index: Column | int, leaves: Column | int, height: int) -> Column:
    """Where a node lies in the postorder of a tree with ``leaves`` leaves and ``height`` levels above them, from 0.

    Of each level up to its own, what its leaves and those before them reach has been written; of those above, what was full before them.
    """
    index, leaves = (c if isinstance(c, Column) else F.lit(c) for c in (index, leaves))
    before = index * FAN**level
    through = F.least(before + FAN**level, leaves)
    whole = [F.floor((through + (FAN**k - 1)) / FAN**k) for k in range(level + 1)]
    return (sum(whole[1:], whole[0]) + sum((F.floor(before / FAN**k) for k in range(level + 1, height + 1)), F.lit(0)) - 1).cast("long")


def indexed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` (tree, ...) with ``index``, their place in the tree by ``order``, and ``size``, the leaves of the tree.

    Rows are dealt out by range and numbered in each; what crosses ranges is one number for each tree in each.
    """
    spread = leaves.repartitionByRange(tasks(leaves), "tree", *order).sortWithinPartitions("tree", *order)
    staged = stage(spread.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "leaves")
    parts = staged.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size"))
    return staged.join(shifts, ["tree", "_part"]).withColumn("index", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def segments(nodes: DataFrame) -> DataFrame:
    """The log of one round of builders over ``nodes`` (tree, index, size, hash, item): tree, size, block, members, log, top."""
    blocks = nodes.groupBy("tree", F.floor(F.col("index") / BLOCK).alias("block")).agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("index", "hash", "item"))).alias("members"))

    def runs(level: str) -> Column:
        return F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))

    def above(level: str) -> Column:
        return F.transform(runs(level), lambda j: F.sha2(F.array_join(F.slice(level, j * FAN + 1, FAN), ""), 256))

    none = F.array().cast("array<string>")
    levels = (
        blocks.withColumn("l0", F.transform("members", lambda m: m["hash"]))
        .withColumn("l1", F.when(F.col("size") > 1, above("l0")).otherwise(none))
        .withColumn("l2", F.when(F.col("size") > FAN, above("l1")).otherwise(none))
    )
    log = F.concat(F.flatten(F.transform(runs("l0"), lambda j: F.concat(
        F.slice("l0", j * FAN + 1, FAN), F.slice("l1", j + 1, 1)))), "l2")
    return levels.select("tree", "size", "block", "members", log.alias("log")).withColumn("top", F.element_at("log", -1))


def rounds(leaves: DataFrame) -> list[DataFrame]:
    """The log's segments, staged, from the leaves (tree, index, size, hash, item) up; as many rounds as the largest tree needs."""
    found = []
    while True:
        found.append(stage(segments(leaves), "segments"))
        if (found[-1].agg(F.max("size")).first()[0] or 0) <= BLOCK:
            return found
        leaves = found[-1].filter(F.col("size") > BLOCK).select(
            "tree", F.col("block").alias("index"), F.ceil(F.col("size") / BLOCK).alias("size"), F.col("top").alias("hash"),
            F.lit(None).cast("string").alias("item"))


def roots(found: Sequence[DataFrame]) -> DataFrame:
    """(tree, root)."""
    tops = [s.filter(F.col("size") <= BLOCK).select("tree", F.col("top").alias("root")) for s in found]
    return tops[0] if len(tops) == 1 else tops[0].unionByName(roots(found[1:]))


def log(found: Sequence[DataFrame]) -> DataFrame:
    """The log's nodes: tree, level, index, position in the postorder of the whole tree, hash."""
    sizes = found[0].groupBy("tree").agg(F.first("size").alias("leaves"))
    nodes = None
    for n, segment in enumerate(found):
        at = F.posexplode("log").alias("at", "hash")
        flat = segment.select("tree", "block", F.size("members").alias("m"), "size", at)
        run, inner = F.floor(F.col("at") / (FAN + 1)), F.col("at") % (FAN + 1)
        last = F.col("at") == F.col("m") + F.ceil(F.col("m") / FAN)
        parent = (F.col("size") > 1) & ((inner == FAN) | (F.col("at") == F.col("m") + F.ceil(F.col("m") / FAN) - 1))
        level = F.when((F.col("size") > FAN) & last, 2).when(parent, 1).otherwise(0)
        index = F.when(level == 2, F.col("block")).when(level == 1, F.col("block") * FAN + run).otherwise(
            F.col("block") * BLOCK + run * FAN + inner)
        own = flat.select("tree", (level + 2 * n).alias("level"), index.cast("long").alias("index"), "hash")
        own = own if n == 0 else own.filter(F.col("level") > 2 * n)  # its lowest level ended the round before
        nodes = own if nodes is None else nodes.unionByName(own)
    nodes = nodes.join(sizes, "tree")
    height = 2 * len(found)
    place = F.coalesce(*[F.when(F.col("level") == k, position(k, F.col("index"), F.col("leaves"), height)) for k in range(height + 1)])
    return nodes.select("tree", "level", "index", place.alias("position"), "hash")


def paths(found: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """Every leaf (tree, index, hash, item) with its ``path``: what lies left and right of it in each run up to the
    root and on. ``above`` has the path of each tree's root (tree, path, ...)."""
    def siblings(level: int, j: Column, count: Column) -> Column:
        first = F.floor(j / FAN) * FAN
        run = F.sequence(first, F.least(first + FAN, F.ceil(count / FAN**level)) - 1)

        def joined(part: Column) -> Column:
            return F.array_join(F.transform(part, lambda x: F.element_at("log", (position(level, x, count, 2) + 1).cast("int"))), "")

        return F.struct(joined(F.filter(run, lambda x: x < j)).alias("left"), joined(F.filter(run, lambda x: x > j)).alias("right"))

    extra = [c for c in above.columns if c not in ("tree", "path")]
    lower = None
    for segment in reversed(found):
        parents = segment.filter(F.col("size") <= BLOCK).join(above, "tree")
        if lower is not None:
            inner = lower.select("tree", F.col("index").alias("block"), "path", *extra)
            parents = parents.unionByName(segment.filter(F.col("size") > BLOCK).join(inner, ["tree", "block"]))
        count, none = F.size("members"), F.array().cast(PATH)

        def member(i: Column) -> Column:
            low = F.when(F.col("size") > 1, F.array(siblings(0, i, count))).otherwise(none)
            high = F.when(F.col("size") > FAN, F.array(siblings(1, F.floor(i / FAN), count))).otherwise(none)
            at = F.element_at("members", (i + 1).cast("int"))
            return F.struct(at["index"].alias("index"), at["hash"].alias("hash"), at["item"].alias("item"),
                            F.concat(low, high, F.col("path")).cast(PATH).alias("path"))

        each = F.explode(F.transform(F.sequence(F.lit(0), count - 1).cast("array<bigint>"), member)).alias("m")
        lower = parents.select("tree", *extra, each).select("tree", *extra, "m.*")
    return lower


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """The hash of a proof: the siblings level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def proofs(rows: DataFrame, source: Column, key: Column, leaf: Column, *beside: Column) -> DataFrame:
    """Every row as key, ``beside``, leaf, subroot, root and path (see :func:`paths`)."""
    tree = F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))  # no source comes first
    leaves = stage(rows.select(tree.alias("tree"), key.alias("_key"), leaf.alias("hash"), F.struct(key.alias("key"), *beside).alias("item")), "leaves")
    trees = rounds(indexed(leaves, ["_key", "hash"]).drop("_key"))
    subroots = roots(trees)
    crown = rounds(indexed(subroots.select(F.lit("").alias("tree"), F.col("root").alias("hash"), F.col("tree").alias("item")), ["item"]))
    top = roots(crown).select("tree", F.array().cast(PATH).alias("path"), "root")
    above = paths(crown, top).select(F.col("item").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    return paths(trees, above).select("item.*", F.col("hash").alias("leaf"), "subroot", "root", "path")
