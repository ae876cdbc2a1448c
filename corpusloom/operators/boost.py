"""Boosted ranking trees (LambdaMART) over candidate tables, fitted by one pass over the rows for each level of a tree.

Rows are packed once into blocks of whole questions: the bin of every feature as a byte, labels, where questions begin, and the scores, which are written anew after each KEPT trees. A pass adds the trees
since then, takes the gradients of each question's pairs, and sends the sums of gradients, curvatures and rows for every open node, feature and bin, arrays whose size depends on the recipe alone.
The driver sees these sums only. Gradients are rounded to multiples of 2**-32 before they are added, so sums do not depend on their order, and
neither partitions nor lost executors change the model.

Of two candidates of a question with different labels the pair's gradient is (1 - p) times the change of nDCG if they swapped places, p the logistic of their scores' difference; gains are
2**label - 1, places are those by score, then by id, and a pair counts if one of its places is among the first CUT. Trees grow level by level, the best splits first
where leaves run out. Bins come from the SAMPLE rows with the smallest hashes, a documented bound; all rows enter every tree.

Questions with one label for all candidates have no pairs. Nulls and numbers that are not finite are an error. An empty table gives a model without trees, which scores 0.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.plans.materialize import forget, written

#: Rows that bins come from, bins of a feature, rows of a block at most beside a last question, places that pairs need one of, bits of a gradient behind the point, trees between written scores, blocks whose sums meet at the driver at most.
SAMPLE, BINS, ROWS, CUT, BITS, KEPT, FEW = 100_000, 64, 1 << 16, 30, 32, 16, 64


#: The columns of a block.
BLOCK = ("bins", "labels", "starts", "scores")


@dataclass(frozen=True)
class Recipe:
    """fixed values: the recipe of the learned fusion."""

    trees: int = 200
    rate: float = 0.05
    leaves: int = 31
    least_rows: int = 20
    penalty: float = 1.0

    def __post_init__(self):
        if self.trees < 1 or not 0 < self.rate <= 1 or self.leaves < 2 or self.least_rows < 1 or self.penalty < 0:
            raise ValueError("the recipe is invalid")


@dataclass(frozen=True)
class Model:
    """Trees as lists of nodes [feature, bin, left, right, value, gain]; feature -1 marks a leaf. A row goes left if its bin is at most the node's."""

    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    trees: tuple[tuple[tuple, ...], ...]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Model:
        m = json.loads(text)
        return Model(tuple(m["features"]), tuple(map(tuple, m["edges"])), tuple(tuple(map(tuple, t)) for t in m["trees"]))

    def audit(self) -> dict:
        """Counts of trees, splits and leaves, and each feature's splits and gain."""
        splits = [n for t in self.trees for n in t if n[0] >= 0]
        return {
            "tree_count": len(self.trees), "split_count": len(splits), "leaf_count": sum(len(t) for t in self.trees) - len(splits),
            "feature_splits": {f: sum(n[0] == i for n in splits) for i, f in enumerate(self.features)}, "feature_gains": {f: sum(n[5] for n in splits if n[0] == i) for i, f in enumerate(self.features)},
        }


def _leaf_of(bins: np.ndarray, tree) -> np.ndarray:
    """The node of a tree that each row comes to."""
    kind = np.array([n[:4] for n in tree], np.int64)
    at = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(len(tree)):
        f = kind[at, 0]
        inner = f >= 0
        if not inner.any():
            break
        left = bins[rows, np.maximum(f, 0)] <= kind[at, 1]
        at = np.where(inner, np.where(left, kind[at, 2], kind[at, 3]), at)
    return at


def _scored(bins: np.ndarray, trees, before: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros(len(bins)) if before is None else before.copy()
    for t in trees:
        out += np.array([n[4] for n in t])[_leaf_of(bins, t)]
    return out


def gradients(labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradients and curvatures of one question's candidates, which stand in the order of their ids."""
    n = len(labels)
    g, h = np.zeros(n), np.zeros(n)
    gain = 2.0**labels - 1
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(n) + 2.0)).sum()
    if ideal == 0 or (labels == labels[0]).all():
        return g, h
    place = np.empty(n, np.int64)
    place[np.argsort(-scores, kind="stable")] = np.arange(n)
    discount = 1 / np.log2(place + 2.0)
    for i in np.flatnonzero(labels > labels.min()):
        j = np.flatnonzero((labels < labels[i]) & ((place[i] < CUT) | (place < CUT)))
        swap = (gain[i] - gain[j]) * np.abs(discount[i] - discount[j]) / ideal
        p = 1 / (1 + np.exp(-np.clip(scores[i] - scores[j], -500, 500)))
        push, bend = swap * (1 - p), swap * p * (1 - p)
        g[i] += push.sum()
        g[j] -= push
        h[i] += bend.sum()
        h[j] += bend
    return g, h


def _packed(names: list[str], edges: tuple):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys = list(zip(group.column("question_id").to_pylist(), group.column("chunk_id").to_pylist()))
        order = sorted(range(len(keys)), key=lambda i: tuple(x.encode() for x in keys[i]))
        bins = np.stack([np.searchsorted(np.array(e), group.column(f).to_numpy(), side="left") for f, e in zip(names, edges)], axis=1).astype(np.uint8)[order]
        starts = [i for i, o in enumerate(order) if i == 0 or keys[o][0] != keys[order[i - 1]][0]]
        columns = [bins.tobytes(), group.column("label").to_numpy()[order].astype("<i4").tobytes(), np.array([*starts, len(order)], "<i8").tobytes(), np.zeros(len(order)).tobytes()]
        return pa.table({c: pa.array([x], pa.binary()) for c, x in zip(BLOCK, columns)})

    return run


def _advanced(width: int, trees):
    """Blocks with the scores that trees bring added."""

    def run(batches):
        for b in batches:
            scores = [_scored(np.frombuffer(raw, np.uint8).reshape(-1, width), trees, np.frombuffer(had)).tobytes() for raw, had in zip(b.column("bins").to_pylist(), b.column("scores").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in BLOCK[:-1]], pa.array(scores, pa.binary())], names=list(BLOCK))

    return run


def _summed(width: int, trees, growing, open_: list[int]):
    """Sums of a task's blocks: for each open node an array of (gradient, curvature, rows) times (feature, bin), as bytes."""
    size = width * BINS

    def run(batches):
        total = np.zeros((len(open_), 3, size), np.int64)
        for b in batches:
            for raw, labels, starts, had in zip(*[b.column(c).to_pylist() for c in BLOCK]):
                bins = np.frombuffer(raw, np.uint8).reshape(-1, width)
                labels, starts = np.frombuffer(labels, "<i4"), np.frombuffer(starts, "<i8")
                scores = _scored(bins, trees, np.frombuffer(had))
                g, h = np.zeros(len(bins)), np.zeros(len(bins))
                for s, e in zip(starts[:-1], starts[1:]):
                    g[s:e], h[s:e] = gradients(labels[s:e], scores[s:e])
                whole = [np.rint(x * 2.0**BITS).astype(np.int64) for x in (g, h)]
                node = _leaf_of(bins, growing)
                for sums, at in zip(total, open_):
                    mine = node == at
                    cell = (np.arange(width) * BINS + bins[mine]).ravel()
                    for to, x in zip(sums, [x[mine] for x in whole]):
                        np.add.at(to, cell, np.repeat(x, width))
                    sums[2] += np.bincount(cell, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(open_, pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], names=["node", "sums"])

    return run


def _together(group: pa.Table) -> pa.Table:
    """The sums of all tasks for one node."""
    total = sum(np.frombuffer(x, np.int64) for x in group.column("sums").to_pylist())
    return pa.table({"node": group.column("node").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _best(sums: np.ndarray, width: int, recipe: Recipe):
    """The best split of a node as (gain, feature, bin), and its value; ties go to the first feature and bin."""
    g, h, n = sums.reshape(3, width, BINS)
    scale = 2.0**-BITS
    tg, th, tn = int(g[0].sum()), int(h[0].sum()), int(n[0].sum())
    lg, lh, ln = (np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n))
    worth = lambda a, b: (a * scale) ** 2 / (b * scale + recipe.penalty + 1e-12)
    gain = worth(lg, lh) + worth(tg - lg, th - lh) - worth(tg, th)
    gain = np.where((ln >= recipe.least_rows) & (tn - ln >= recipe.least_rows), gain, -np.inf)
    at = int(gain.argmax())
    value = recipe.rate * tg * scale / (th * scale + recipe.penalty + 1e-12)
    return (float(gain.flat[at]), at // (BINS - 1), at % (BINS - 1)), value


def fit(rows: DataFrame, features: list[str], recipe: Recipe = Recipe()) -> Model:
    """The model of candidate rows (question_id, chunk_id, label, features); labels are whole numbers from 0, a candidate stands once in a question."""
    told = rows.select(F.col("question_id").cast("string").alias("question_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("label").cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features])
    finite = [F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) < math.inf) for f in features]
    bad = F.col("question_id").isNull() | F.col("chunk_id").isNull() | F.col("label").isNull() | (F.col("label") < 0)
    for ok in finite:
        bad = bad | ~ok
    if told.where(bad).take(1) or told.groupBy("question_id", "chunk_id").count().where("count > 1").take(1):
        raise ValueError("candidates must be unique, labels and features finite numbers")
    n = told.count()
    if not n:
        return Model(tuple(features), ((),) * len(features), ())
    sample = np.array([tuple(r)[1:] for r in told.select(F.xxhash64("question_id", "chunk_id").alias("x"), *features).orderBy("x", *features).limit(SAMPLE).collect()])
    edges = []
    for column in sample.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="lower"))
        edges.append(tuple(values[: BINS - 1].tolist()))
    parts, kind = -(-n // ROWS), ", ".join(f"{c} binary" for c in BLOCK)
    part = F.pmod(F.xxhash64("question_id"), F.lit(parts))
    blocks = written(told.groupBy(part.alias("part")).applyInArrow(_packed(features, tuple(edges)), kind), "boost-blocks")
    width, trees = len(features), []
    for _ in range(recipe.trees):
        tree: list[list] = [[-1, 0, 0, 0, 0.0, 0.0]]
        open_ = [0]
        while open_:
            # arrays of a size that the recipe fixes, one for each open node and task; those of many tasks are added up before the driver sees them
            found = blocks.mapInArrow(_summed(width, tuple(trees[len(trees) // KEPT * KEPT :]), tuple(map(tuple, tree)), open_), "node int, sums binary")
            sums = {at: np.zeros(3 * width * BINS, np.int64) for at in open_}
            for r in (found if parts <= FEW else found.groupBy("node").applyInArrow(_together, "node int, sums binary")).collect():
                sums[r["node"]] += np.frombuffer(r["sums"], np.int64)
            splits = []
            for at in open_:
                best, tree[at][4] = _best(sums[at], width, recipe)
                if best[0] > 1e-12:
                    splits.append((-best[0], at, best))
            open_ = []
            for _, at, (gain, feature, edge) in sorted(splits):
                if sum(x[0] < 0 for x in tree) < recipe.leaves:
                    tree[at][:4], tree[at][5] = [feature, edge, len(tree), len(tree) + 1], gain
                    open_ += [len(tree), len(tree) + 1]
                    tree += [[-1, 0, 0, 0, 0.0, 0.0], [-1, 0, 0, 0, 0.0, 0.0]]
        trees.append(tuple(map(tuple, tree)))
        if len(trees) % KEPT == 0 and len(trees) < recipe.trees:
            had, blocks = blocks, written(blocks.mapInArrow(_advanced(width, tuple(trees[-KEPT:])), kind), "boost-blocks")
            forget(had)
    return Model(tuple(features), tuple(edges), tuple(trees))


def predict(model: Model, rows: DataFrame, k: int | None = None) -> DataFrame:
    """Rows (question_id, rank, chunk_id, score) of candidate rows (question_id, chunk_id, features), the best first, ties by id; the first k, or all."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            columns = [b.column(f).to_numpy(zero_copy_only=False) for f in m.features]
            if any(not np.isfinite(c).all() for c in columns):
                raise ValueError("features must be finite numbers")
            bins = np.stack([np.searchsorted(np.array(e), c, side="left") for c, e in zip(columns, m.edges)], axis=1) if b.num_rows else np.empty((0, len(columns)), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("question_id"), b.column("chunk_id"), pa.array(_scored(bins, m.trees), pa.float64())], names=["question_id", "chunk_id", "score"])

    told = rows.select(F.col("question_id").cast("string").alias("question_id"), F.col("chunk_id").cast("string").alias("chunk_id"), *[F.col(f).cast("double").alias(f) for f in model.features])
    scored = told.mapInArrow(run, "question_id string, chunk_id string, score double")
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "chunk_id")
    out = scored.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= k) if k else out).select("question_id", "rank", "chunk_id", "score")


def gate(deltas: dict[str, float]) -> bool:
    """Whether a learned ranking may stand: nothing lost among the first 50, and something won among the first 10 or in the mean reciprocal rank."""
    return deltas["recall_at_50"] >= 0 and deltas["set_recall_at_50"] >= 0 and (deltas["recall_at_10"] > 0 or deltas["mrr_at_50"] > 0)
