"""Connected components by alternating large-star and small-star rounds.

Before the first round each task folds its own edges into stars with a union-find over bounded chunks.
A round is two aggregations over the edge table: both stars only ever point a node at the smallest
neighbour it knows, so the number of rounds grows with the logarithm of a component's diameter and no
node's neighbourhood is collected anywhere.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.materialize import written

#: Edges that one task folds at once: a few tens of megabytes.
CHUNK = 250_000


def _folded(batches):
    parent: dict[int, int] = {}
    seen = 0

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def stars():
        rows = [(x, root(x)) for x in list(parent)]
        rows = [(x, r) for x, r in rows if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= CHUNK:
            yield stars()
            parent, seen = {}, 0
    if parent:
        yield stars()


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of an edge to another node; component is the smallest node of its component.

    Node ids are integers. Loops and repeated edges are harmless, edges with a null end are ignored,
    an empty edge table gives an empty result. Raises RuntimeError if max_rounds do not suffice,
    never a partial answer.
    """
    e = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = written(e.distinct(), "cc-edges")
    n = e.count()
    if n <= CHUNK:  # one chunk: the fold is the answer
        stars = written(e.coalesce(1).mapInArrow(_folded, "a long, b long"), "cc-stars")
        return _with_roots(stars)
    e = written(e.coalesce(-(-n // CHUNK)).mapInArrow(_folded, "a long, b long").distinct(), "cc-folded")
    for _ in range(max_rounds):
        # a forest of stars: every node points at one root, and no root points anywhere
        roots = e.select("b").distinct()
        loose = e.groupBy("a").agg(F.count("*").alias("n")).join(roots.select(F.col("b").alias("a"), F.lit(1).alias("is_root")), "a", "left")
        if loose.where("n > 1 OR is_root = 1").isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a is linked to the smallest node a knows
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of a, and a itself, are linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m")
        e = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = written(e, "cc-round")
    else:
        raise RuntimeError("connected components did not settle")
    return _with_roots(e)


def _with_roots(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
