"""Ranking trees against a plain version without blocks or histograms, and their independence of partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import boost

FEATURES = ["a", "b", "c"]


def candidates(questions=25, each=14, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(questions):
        for i in range(each):
            a, b, c = rng.integers(0, 6), round(float(rng.normal()), 1), float(rng.integers(0, 3))
            rows.append((f"q{q:02d}", f"c{i:02d}", int(a + b > 4) + int(c == 2 and a > 3), float(a), b, c))
    return rows


def plain_gradients(labels, scores):
    order = sorted(range(len(labels)), key=lambda i: -scores[i])
    place = {x: p for p, x in enumerate(order)}
    ideal = sum((2**y - 1) / math.log2(p + 2) for p, y in enumerate(sorted(labels, reverse=True)))
    g, h = [0.0] * len(labels), [0.0] * len(labels)
    for i in range(len(labels)):
        for j in range(len(labels)):
            if labels[i] > labels[j] and (place[i] < 30 or place[j] < 30):
                d = (2 ** labels[i] - 2 ** labels[j]) * abs(1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2)) / ideal
                p = 1 / (1 + math.exp(scores[j] - scores[i]))
                g[i], g[j], h[i], h[j] = g[i] + d * (1 - p), g[j] - d * (1 - p), h[i] + d * p * (1 - p), h[j] + d * p * (1 - p)
    return g, h


def plain_fit(rows, recipe):
    """Splits looked for among all values, level by level."""
    rows = sorted(rows)
    scores = [0.0] * len(rows)
    for _ in range(recipe.trees):
        g, h = [0.0] * len(rows), [0.0] * len(rows)
        for q in sorted({r[0] for r in rows}):
            at = [i for i, r in enumerate(rows) if r[0] == q]
            for i, x, y in zip(at, *plain_gradients([rows[i][2] for i in at], [scores[i] for i in at])):
                g[i], h[i] = x, y
        worth = lambda s: sum(g[i] for i in s) ** 2 / (sum(h[i] for i in s) + recipe.penalty)  # noqa: E731, B023
        leaves, open_ = [], [list(range(len(rows)))]
        while open_:
            splits = []
            for s in open_:
                best = (1e-12, None)
                for f in (3, 4, 5):
                    for v in sorted({rows[i][f] for i in s}):
                        left = [i for i in s if rows[i][f] <= v]
                        right = [i for i in s if rows[i][f] > v]
                        if min(len(left), len(right)) >= recipe.least_rows and (gain := worth(left) + worth(right) - worth(s)) > best[0] + 1e-9:
                            best = (gain, (left, right))
                (splits if best[1] else leaves).append((best, s) if best[1] else s)
            open_, room = [], recipe.leaves - len(leaves) - len(splits)
            for (_, halves), s in sorted(splits, key=lambda x: -x[0][0]):
                if room > 0:
                    open_ += halves
                    room -= 1
                else:
                    leaves.append(s)
        for s in leaves:
            for i in s:
                scores[i] += recipe.rate * sum(g[j] for j in s) / (sum(h[j] for j in s) + recipe.penalty)
    return {(r[0], r[1]): x for r, x in zip(rows, scores)}


def table(spark, rows):
    return spark.createDataFrame(rows, "question_id string, chunk_id string, label int, a double, b double, c double")


def test_equals_the_plain_version_and_ignores_partitions(spark, monkeypatch):
    rows = candidates()
    recipe = boost.Recipe(trees=3, rate=0.3, leaves=5, least_rows=8, penalty=1.0)
    model = boost.fit(table(spark, rows), FEATURES, recipe)
    got = {(r["question_id"], r["chunk_id"]): r["score"] for r in boost.predict(model, table(spark, rows)).collect()}
    want = plain_fit(rows, recipe)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6 and len(got) == len(want)
    monkeypatch.setattr(boost, "ROWS", 40)
    again = boost.fit(table(spark, rows[::-1]).repartition(5), FEATURES, recipe)
    assert again == model and boost.Model.from_json(model.to_json()) == model
    audit = model.audit()
    assert audit["tree_count"] == 3 and audit["leaf_count"] == audit["split_count"] + 3 and sum(audit["feature_splits"].values()) == audit["split_count"]


def ndcg(rows, rank):
    out = []
    for q in {r[0] for r in rows}:
        label = {r[1]: r[2] for r in rows if r[0] == q}
        dcg = sum((2 ** label[c] - 1) / math.log2(p + 1) for (x, c), p in rank.items() if x == q)
        ideal = sum((2**y - 1) / math.log2(p + 2) for p, y in enumerate(sorted(label.values(), reverse=True)))
        out.append(dcg / ideal if ideal else 1.0)
    return np.mean(out)


def test_learning_orders_candidates(spark):
    rows = candidates()
    model = boost.fit(table(spark, rows), FEATURES, boost.Recipe(trees=8, rate=0.3, leaves=6, least_rows=5))
    rank = {(r["question_id"], r["chunk_id"]): r["rank"] for r in boost.predict(model, table(spark, rows)).collect()}
    by_id = {(r[0], r[1]): int(r[1][1:]) + 1 for r in rows}
    assert ndcg(rows, rank) > 0.95 > ndcg(rows, by_id)
    assert boost.predict(model, table(spark, rows), 3).groupBy("question_id").count().where("count <> 3").count() == 0


def test_odd_tables(spark):
    none = boost.fit(table(spark, []), FEATURES)
    assert none.trees == () and boost.predict(none, table(spark, candidates(1))).agg(F.max(F.abs("score"))).first()[0] == 0
    flat = [("q", f"c{i}", 1, 1.0, 1.0, 1.0) for i in range(50)]
    assert boost.fit(table(spark, flat), FEATURES, boost.Recipe(trees=2)).audit()["split_count"] == 0
    for bad in ([("q", "c", 1, float("nan"), 0.0, 0.0)], [("q", "c", -1, 0.0, 0.0, 0.0)], [("q", "c", 1, 0.0, 0.0, 0.0)] * 2):
        with pytest.raises(ValueError, match="finite"):
            boost.fit(table(spark, bad), FEATURES)
    with pytest.raises(ValueError, match="recipe"):
        boost.Recipe(leaves=1)
    assert boost.gate({"recall_at_50": 0.0, "set_recall_at_50": 0.0, "recall_at_10": 0.1, "mrr_at_50": -0.1}) and not boost.gate({"recall_at_50": -0.1, "set_recall_at_50": 0.0, "recall_at_10": 0.1, "mrr_at_50": 0.1})
