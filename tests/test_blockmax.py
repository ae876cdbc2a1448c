"""Block-max ranking against scores of all pairs, by hand-made cases and on the driver's tables."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import queries_retrieval as queries
from corpusloom.operators import blockmax, fuse, index, retrieve


def plain(chunks, questions, k):
    """BM25 by nested loops."""
    tok = lambda t: re.findall(r"\w+|[^\w\s]", (t or "").lower())
    docs = {c: tok(t) for c, t in chunks}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for q, text in questions:
        scores = []
        for c, words in docs.items():
            s = 0.0
            for t in sorted(set(tok(text))):
                if tf := words.count(t):
                    df = sum(t in w for w in docs.values())
                    s += math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
            if s > 0:
                scores.append((-round(s, 6), c, s))
        out |= {(q, i + 1): (c, s) for i, (_, c, s) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_nested_loops(spark, parts):
    rng = random.Random(parts)
    words = [f"w{i}" for i in range(60)] + [".", ","] * 10
    text = lambda n: " ".join(rng.choices(words, weights=[1 + i % 13 for i in range(len(words))], k=n))
    chunks = [(f"c{i}", text(rng.randint(1, 40))) for i in range(150)] + [("null", None), ("empty", ""), ("twin1", "w1 w2 w3"), ("twin2", "w1 w2 w3"), ("é", "w1 w2 w3"), ("long", text(3000))]
    asked = [(f"q{i}", text(rng.randint(1, 12))) for i in range(20)] + [("ties", "w1 w2 w3"), ("none", "nowhere"), ("void", ""), ("null", None)]
    built = blockmax.build(spark.createDataFrame(chunks, "chunk_id string, text string").repartition(parts))
    questions = spark.createDataFrame(asked, "question_id string, question string")
    for k, built in [(k, b) for k in (1, 5, 500) for b in (built, blockmax.build(spark.createDataFrame(chunks, "chunk_id string, text string").repartition(parts), questions))][:4]:
        got = {(r["question_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in blockmax.bm25(built, questions, k).collect()}
        want = plain(chunks, asked, k)
        assert {x: c for x, (c, _) in got.items()} == {x: c for x, (c, _) in want.items()}
        assert all(abs(s - want[x][1]) <= 1e-12 * max(1, s) for x, (_, s) in got.items())


def test_empty_tables(spark):
    none = blockmax.build(spark.createDataFrame([], "chunk_id string, text string"))
    asked = spark.createDataFrame([("q", "a b")], "question_id string, question string")
    assert blockmax.bm25(none, asked).count() == 0 and blockmax.lexical(none, asked).count() == 0
    some = blockmax.build(spark.createDataFrame([("c", "a b")], "chunk_id string, text string"))
    assert blockmax.bm25(some, asked.limit(0)).count() == 0 and blockmax.work(some, asked).first()["pairs"] == 1


def test_parity_and_work_on_documents(spark):
    d = "/root/testdata/sf0.01"
    chunks, questions = queries.chunks(spark, d), queries.questions(spark, d)
    built = blockmax.build(chunks)
    ranking = blockmax.bm25(built, questions, 12)
    row = fuse.parity(ranking, retrieve.ranked(retrieve.bm25_scores(chunks, questions), 12)).first()
    assert row["same_order"] and row["max_delta"] <= 1e-12 * 1e3 and row["rows"] == 480
    done = blockmax.work(built, questions, 12).first()
    assert done["pairs"] > 30_000 and done["scored"] < done["pairs"] / 10


def test_few_and_many_terms_read_the_same_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame([(str(i), f"a{i} b{i % 3} c") for i in range(30)], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "a1 b2 c"), ("p", "b0 a7")], "question_id string, question string")
    built = blockmax.build(chunks)
    few = blockmax.bm25(built, asked, 5).collect()
    monkeypatch.setattr(blockmax, "FEW", 1)
    assert sorted(map(tuple, blockmax.bm25(built, asked, 5).collect())) == sorted(map(tuple, few))
    monkeypatch.setattr(blockmax, "SLICE", 2)
    assert sorted(map(tuple, blockmax.bm25(built, asked, 5).collect())) == sorted(map(tuple, few))


def test_postings_of_a_written_index(spark, tmp_path):
    null = F.lit(None).cast("string")
    chunks = spark.createDataFrame([(str(i), f"a{i} b{i % 3} c") for i in range(30)], "chunk_id string, text string").select("chunk_id", "text", null.alias("context_id"), F.array().cast("array<string>").alias("hierarchy_path"), null.alias("hierarchy_kind"), null.alias("hierarchy_ordinal"))
    asked = spark.createDataFrame([("q", "a1 b2 c")], "question_id string, question string")
    path = str(tmp_path / "i")
    index.build_index(chunks, path)
    opened = index.open_postings(spark, path)
    assert [tuple(r) for r in blockmax.bm25(opened, asked, 5).collect()] == [tuple(r) for r in blockmax.bm25(blockmax.build(chunks), asked, 5).collect()]
    bad = str(tmp_path / "bad")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{bad}/manifest")
    spark.read.parquet(f"{path}/postings").where("term <> 'c' OR term IS NULL").write.parquet(f"{bad}/postings")
    with pytest.raises(ValueError, match="damaged"):
        index.open_postings(spark, bad)
