"""The vector store: resumed builds, refusals, and searches against nested loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dense

SCHEMA = "chunk_id string, embedding array<float>"
IDENTITY = {"model": "m", "revision": "1"}


def vectors(spark, n=300, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"é{i}" if i % 7 == 0 else f"c{i}", rng.normal(size=dim).astype(np.float32).tolist()) for i in range(n)]
    rows += [("twin1", rows[3][1]), ("twin2", rows[3][1]), ("near", [x * 1.0002 for x in rows[3][1]])]
    return rows, spark.createDataFrame(rows, SCHEMA)


def best(rows, asked, k, own):
    m = np.array([r[1] for r in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q, v in asked:
        v = np.array(v, np.float32).astype(float)
        s = m @ (v / np.linalg.norm(v))
        order = sorted((i for i in range(len(rows)) if own or rows[i][0] != q), key=lambda i: (-round(s[i], 6), rows[i][0].encode()))[:k]
        out |= {(q, j + 1): rows[i][0] for j, i in enumerate(order)}
    return out


def table(df):
    return sorted((r["part"], r["block"], tuple(r["ids"]), bytes(r["vectors"])) for r in df.collect())


def test_a_build_that_was_broken_off(spark, tmp_path):
    rows, v = vectors(spark)
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    assert dense.build_store(v, whole, IDENTITY, parts=7, wave=2) == "COMPLETE"
    assert dense.build_store(v.repartition(5), broken, IDENTITY, parts=7, wave=2, most_waves=1) == "INCOMPLETE"
    with pytest.raises(ValueError, match="not complete"):
        dense.open_store(spark, broken)
    # a wave that was written, but has no ledger rows: the build had died in between
    spark.createDataFrame(rows[:9], SCHEMA).write.parquet(f"{broken}/blocks/2")
    assert dense.build_store(v, broken, IDENTITY, parts=7, wave=2, most_waves=1) == "INCOMPLETE"
    assert dense.build_store(v, broken, IDENTITY, parts=7, wave=2) == "COMPLETE"
    assert table(dense.open_store(spark, broken, IDENTITY)) == table(dense.open_store(spark, whole))
    assert dense.build_store(v, broken, IDENTITY, parts=7, wave=2) == "COMPLETE"


def test_other_builds_and_damage_are_refused(spark, tmp_path):
    rows, v = vectors(spark, 60)
    path = str(tmp_path / "s")
    dense.build_store(v, path, IDENTITY, parts=4, wave=2, most_waves=1)
    for other, identity in ((v, {**IDENTITY, "revision": "2"}), (v.where("chunk_id <> 'c1'"), IDENTITY), (v.withColumn("embedding", F.transform("embedding", lambda x: -x)), IDENTITY)):
        with pytest.raises(ValueError, match="another build"):
            dense.build_store(other, path, identity, parts=4, wave=2)
    kept = spark.read.parquet(f"{path}/blocks/0").collect()
    bad = [(r["part"], r["block"], r["ids"], bytes(r["vectors"][:-1]) + b"\x7f", r["rows"], r["error"]) for r in kept]
    spark.createDataFrame(bad, dense._BLOCK).write.mode("overwrite").parquet(f"{path}/blocks/0")
    with pytest.raises(ValueError, match="damaged"):
        dense.build_store(v, path, IDENTITY, parts=4, wave=2)
    spark.createDataFrame(kept, dense._BLOCK).write.mode("overwrite").parquet(f"{path}/blocks/0")
    assert dense.build_store(v, path, IDENTITY, parts=4, wave=2) == "COMPLETE"
    with pytest.raises(ValueError, match="revision"):
        dense.open_store(spark, path, {"revision": "9"})
    spark.read.parquet(f"{path}/ledger/2").withColumn("digest", F.lit("0" * 64)).coalesce(1).write.parquet(f"{path}/ledger/x")
    spark.read.parquet(f"{path}/ledger/x").coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/2")
    with pytest.raises(ValueError, match="ledger"):
        dense.open_store(spark, path)


def test_bad_vectors_are_refused(spark, tmp_path):
    for bad in ([("a", [1.0, 2.0]), ("a", [1.0, 2.0])], [(None, [1.0, 2.0])], [("a", [0.0, 0.0])], [("a", [float("nan"), 1.0])], [("a", [1.0]), ("b", [1.0, 2.0])]):
        with pytest.raises(Exception, match="unique|not zero|dimension"):
            dense.build_store(spark.createDataFrame(bad, SCHEMA), str(tmp_path / "bad"), IDENTITY, parts=1)


@pytest.mark.parametrize("own", [True, False])
def test_searches_equal_nested_loops(spark, tmp_path, own):
    rows, v = vectors(spark)
    asked = [*rows[:40], ("new", [1.0] * 12), ("twin1", rows[3][1])]
    q = spark.createDataFrame(asked, "question_id string, embedding array<float>")
    path = str(tmp_path / "s")
    dense.build_store(v, path, IDENTITY, parts=5)
    stored = dense.open_store(spark, path)
    for k in (1, 5, 1000):
        want = best(rows, asked, k, own)
        for found in (dense.search(stored, q, k, own, exact=v), dense.cosine(v.repartition(3), q, k, own)):
            assert {(r["question_id"], r["rank"]): r["chunk_id"] for r in found.collect()} == want
    rounded = dense.search(stored, q, 5, own)
    report = dense.drift(rounded, dense.cosine(v, q, 5, own), 2e-3).first()
    assert report["rows"] == 42 * 5 and report["within"] and 0 < report["max_delta"] < 2e-3
    assert not dense.drift(rounded, dense.cosine(v, q, 5, own), 1e-9).first()["within"]


def test_empty_tables(spark, tmp_path):
    _, v = vectors(spark, 10)
    q = v.withColumnRenamed("chunk_id", "question_id")
    assert dense.cosine(v.limit(0), q).count() == 0 and dense.cosine(v, q.limit(0)).count() == 0
    path = str(tmp_path / "none")
    assert dense.build_store(v.limit(0), path, IDENTITY, parts=2) == "COMPLETE"
    assert dense.search(dense.open_store(spark, path), q, exact=v).count() == 0
