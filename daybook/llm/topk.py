"""Exact top-k search by inner product, with a KD-tree for each shard.

Every task builds trees over what it reads, ``SHARD`` vectors at most in each: median splits along the widest side
of a node's tight box. A query opens nodes best first, by the largest product that a box allows, and stops at the
first box that can't reach its k-th score. That score is carried from shard to shard in a task; a first
wave over few shards gives every query a k-th score before the other wave begins.

Queries are asked in blocks of about ``BLOCK`` against all shards, which are stored and read again, not shuffled. A block is
what the driver and every task hold of them.

Vectors that are null, hold null or non-finite components, or have no id take no part; nor do candidates of another length
than the query's. Of several query rows with one id the smallest vector is asked, and no row with the
query's id is its candidate. Repeated candidates are found each. Fewer rows than k give fewer answers, an empty table none.
Scores beyond 64 bits count as the largest or smallest long. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.staging import stage
from daybook.llm.workers import ready

# Production parameters.
K = 10
SCALE = 1024
SHARD = 4096
LEAF = 64
BLOCK = 4096
# One shard in so many belongs to the first wave.
WAVE = 8
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


class Tree:
    """Points (whole numbers as doubles) in the order of the leaves, their ids, and the nodes' boxes."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.points, self.ids, self.nodes, self.low, self.high = points, ids, nodes, low, high

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
        order, nodes, low, high = np.arange(len(points)), [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            start, stop, parent = todo.pop()
            own = points[order[start:stop]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            at = len(nodes)
            nodes.append([start, stop, -1, -1])
            if parent >= 0:
                nodes[parent][2 if nodes[parent][2] < 0 else 3] = at
            widths = high[at] - low[at]
            if stop - start > leaf and widths.size and widths.max() > 0:
                half = (stop - start) // 2
                by = np.argpartition(own[:, widths.argmax()], half)
                order[start:stop] = order[start:stop][by]
                todo += [(start, start + half, at), (start + half, stop, at)]
        return cls(points[order], ids[order], np.array(nodes), np.array(low), np.array(high))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points, ids=self.ids, nodes=self.nodes, low=self.low, high=self.high)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Tree:
        with np.load(io.BytesIO(blob)) as parts:
            return cls(**{name: parts[name] for name in ("points", "ids", "nodes", "low", "high")})

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest product of each query (row) with a point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, best: Best) -> None:
        """Puts the candidates that can be among the best into ``best``; nodes come best first."""
        todo = [(-bounds[0], 0)]
        while todo and -todo[0][0] >= best.least():
            _, node = heapq.heappop(todo)
            start, stop, left, right = self.nodes[node]
            if left < 0:
                best.take(self.points[start:stop] @ query, self.ids[start:stop], own)
            else:
                for child in (left, right):
                    if bounds[child] >= best.least():
                        heapq.heappush(todo, (-bounds[child], int(child)))

    def scan(self, query: np.ndarray, own: int, best: Best) -> None:
        """All points, in whole numbers of any size."""
        whole = [int(x) for x in query]
        for point, vec_id in zip(self.points, self.ids):
            score = sum(a * int(b) for a, b in zip(whole, point))
            best.offer(min(max(score, -_LONG - 1), _LONG), int(vec_id), own)


class Best:
    """The k best (score, smaller ids first) so far, and the k-th score that is known from elsewhere."""

    def __init__(self, k: int, known: float = -np.inf):
        self.k, self.known, self.heap = k, known, []

    def least(self) -> float:
        return max(self.known, self.heap[0][0]) if len(self.heap) == self.k else self.known

    def take(self, scores: np.ndarray, ids: np.ndarray, own: int) -> None:
        for i in np.flatnonzero(scores >= self.least()):
            self.offer(int(scores[i]), int(ids[i]), own)

    def offer(self, score: int, vec_id: int, own: int) -> None:
        if vec_id == own or score < self.known:
            return
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -vec_id))
        elif (score, -vec_id) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -vec_id))


def _numbers(vectors: pa.Array, scale: int) -> list[np.ndarray | None]:
    """Whole vectors as floor(scale * x); None for those that take no part."""
    found = []
    for vector in vectors:
        if not vector.is_valid or vector.values.null_count:
            found.append(None)
            continue
        x = np.floor(scale * vector.values.to_numpy(zero_copy_only=False).astype(np.float64))
        found.append(x if np.isfinite(x).all() else None)
    return found


def trees(vectors: DataFrame, scale: int = SCALE, shard: int = SHARD) -> DataFrame:
    """(dim, n, tree): shards of ``vectors`` (vec_id, embedding), each of one length of vectors."""
    ready(vectors.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def built(dim: int) -> pa.RecordBatch:
            ids, points = zip(*held.pop(dim))
            tree = Tree.build(np.array(points).reshape(len(ids), dim), np.array(ids, dtype=np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([tree.to_bytes()], pa.binary())], ["dim", "n", "tree"])

        for batch in batches:
            for vec_id, x in zip(batch.column(0).to_pylist(), _numbers(batch.column(1), scale)):
                if vec_id is None or x is None:
                    continue
                held.setdefault(len(x), []).append((vec_id, x))
                if len(held[len(x)]) >= shard:
                    yield built(len(x))
        for dim in sorted(held):
            yield built(dim)

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "dim int, n int, tree binary")


def _ask(shards: DataFrame, asked: list[tuple[int, np.ndarray, float]], k: int) -> DataFrame:
    """(query_id, vec_id, score): of each task the best of its shards, queries given as (id, vector, known k-th score)."""
    by_dim: dict[int, list] = {}
    for query in asked:
        by_dim.setdefault(len(query[1]), []).append(query)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {(q, dim): Best(k, known) for dim, own in by_dim.items() for q, _, known in own}
        for batch in batches:
            for dim, blob in zip(batch.column("dim").to_pylist(), batch.column("tree").to_pylist()):
                own = by_dim.get(dim)
                if not own:
                    continue
                tree, queries = Tree.from_bytes(blob), np.array([x for _, x, _ in own]).reshape(len(own), dim)
                reach = np.abs(queries).max(initial=0) * max(np.abs(tree.low).max(initial=0), np.abs(tree.high).max(initial=0)) * dim
                bounds = tree.bounds(queries) if reach < _EXACT else None
                for i, (q, x, _) in enumerate(own):
                    if bounds is not None:
                        tree.search(x, q, bounds[i], best[q, dim])
                    else:
                        tree.scan(x, q, best[q, dim])
        rows = [(q, -vec_id, score) for (q, _), own in best.items() for score, vec_id in own.heap]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return shards.mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k highest products of each query, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    number = F.monotonically_increasing_id()
    shards = stage(trees(vectors, scale, shard).withColumn("shard", number), "trees")
    queries = stage(
        vectors.filter(is_query & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .groupBy(F.col("vec_id").cast("long").alias("query_id")).agg(F.min("embedding").alias("vector")), "queries")
    blocks = -(-queries.count() // block)
    first = F.pmod(F.xxhash64("shard"), F.lit(WAVE)) == 0
    found = []
    for n in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect()
        asked = [(row.query_id, np.floor(scale * np.array(row.vector, dtype=np.float64)), -np.inf) for row in mine]
        early = stage(_ask(shards.filter(first), asked, k), "wave")
        known = {row.query_id: row.score for row in _ranked(early, k).filter(F.col("rank") == k).select("query_id", "score").collect()}
        late = stage(_ask(shards.filter(~first), [(q, x, known.get(q, -np.inf)) for q, x, _ in asked], k), "wave")
        found += [early, late]
    empty = spark.createDataFrame([], "query_id long, vec_id long, score long")
    return _ranked(reduce(DataFrame.unionByName, found, empty), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
