"""The manifest against a tree in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from daybook.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(leaves):
    found = [leaves]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([h("".join(below[i:i + 16])) for i in range(0, len(below), 16)])
    return found


def siblings(tree, i):
    found = []
    for level in tree[:-1]:
        first = i // 16 * 16
        found += [x for at, x in enumerate(level[first:first + 16], first) if at != i]
        i //= 16
    return found


def postorder(tree):
    """(level, index, hash) in the order of a walk that names nodes after their children."""
    def walk(level, i):
        if level:
            for child in range(16 * i, min(16 * i + 16, len(tree[level - 1]))):
                yield from walk(level - 1, child)
        yield level, i, tree[level][i]
    return list(walk(len(tree) - 1, 0))


SIZES = {"a": 1, "b": 16, "c": 17, "d": 256, "e": 257, None: 40, "é": 4100}


@pytest.fixture(scope="module")
def leaves():
    return [(source, i, h(f"{source}{i}")) for source, n in SIZES.items() for i in range(n)]


def test_proofs(spark, leaves):
    rows = leaves
    docs = spark.createDataFrame(rows, "source string, doc_id long, path string").repartition(7)
    found = merkle.proofs(docs, F.col("source"), F.col("doc_id"), F.col("path"), F.col("source"))
    found = found.withColumns({"proof": merkle.siblings_digest(F.col("path")), "folded": merkle.fold(F.col("path"), F.col("leaf"))})
    names = sorted(SIZES, key=lambda x: (x is not None, (x or "").encode()))
    trees = {s: levels([r[2] for r in rows if r[0] == s]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    expected = {(s, i, leaf, trees[s][-1][0], top[-1][0], h("".join(siblings(trees[s], i) + siblings(top, names.index(s))))) for s, i, leaf in rows}
    got = found.collect()
    assert len(got) == len(rows) and {(r.source, r.key, r.leaf, r.subroot, r.root, r.proof) for r in got} == expected
    assert all(r.folded == r.root for r in got)


def test_log_positions(spark, leaves):
    rows = leaves
    docs = spark.createDataFrame(rows, "tree string, key long, hash string").filter("tree is not null").withColumn("item", F.lit("x"))
    found = merkle.log(merkle.rounds(merkle.indexed(docs, ["key"]))).collect()
    for name in SIZES:
        if name is not None:
            own = sorted((r["position"], r["level"], r["index"], r["hash"]) for r in found if r.tree == name)
            walked = postorder(levels([r[2] for r in rows if r[0] == name]))
            assert own == [(at, *node) for at, node in enumerate(walked)]


def test_rows_of_every_kind(docs, nothing, rows):
    def run(df):
        named = df.withColumns({"tree": F.lit(1), "index": F.lit("x"), "_part": F.lit(2), "leaf": F.lit(3)})
        leaf = merkle.digest(*map(F.col, df.columns))
        return merkle.proofs(named, F.col("source"), F.col("doc_id"), leaf).withColumn("folded", merkle.fold(F.col("path"), F.col("leaf"))).collect()

    got = run(docs)
    leaves = [h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)) for r in rows]
    assert sorted(r.leaf for r in got) == sorted(leaves)
    assert len({r.root for r in got}) == 1 and all(r.folded == r.root for r in got)
    assert run(docs.repartition(2)) and {(r.key is None, r.leaf, r.root) for r in run(docs.repartition(2))} == {(r.key is None, r.leaf, r.root) for r in got}
    assert run(nothing) == []
    assert len({r.root for r in run(docs.filter("doc_id < 9"))} - {got[0].root}) == 1
