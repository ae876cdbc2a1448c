"""Frozen aliases: what is written, what is refused, and questions that resolve by them."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import freeze, index

CONTEXTS = [("10", "Nghị định số 90/2017/NĐ-CP về thú y"), ("9", "  45/2019/QH14 và lại 45/2019/QH14"), ("2", "45/2019/QH14 khác"), ("3", "1/2020/AB rồi 2/2020/AB"), ("4", None), ("5", ""), ("6", "không có số")]


@pytest.fixture(scope="module")
def contexts(spark):
    return spark.createDataFrame([(*c, "clash", -1) for c in CONTEXTS], "context_id string, passage string, place string, document_number int")


@pytest.fixture(scope="module")
def frozen(spark, contexts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("aliases") / "one")
    rows = freeze.proposed(contexts)
    return path, freeze.freeze(rows, contexts, path, freeze.approval(rows)), rows


def test_order_offsets_and_resolution(spark, contexts, frozen):
    path, manifest, _ = frozen
    rows = freeze.open_frozen(spark, path, contexts).orderBy("place").collect()
    assert [(r["document_key"], r["context_id"], r["canonical_start"], r["canonical_end"], r["review_state"]) for r in rows] == [
        ("45/2019/qh14", "2", 0, 12, "approved"), ("45/2019/qh14", "9", 2, 14, "approved"), ("90/2017/nd-cp", "10", 13, 26, "approved"),
    ]
    assert manifest["rows"] == 3
    chunk = "chunk_id string, context_id string, hierarchy_path array<string>, hierarchy_kind string, hierarchy_ordinal string"
    chunks = spark.createDataFrame([("c", "10", ["Điều 1"], "article", "1")], chunk)
    asked = spark.createDataFrame([("q", "Điều 1 Nghị định 90/2017/NĐ-CP quy định gì?")], "question_id string, question string")
    found = index.resolved(asked, freeze.open_frozen(spark, path, contexts).select("document_key", "context_id"), chunks).collect()
    assert [(r["question_id"], r["chunk_id"], r["diagnostic"]) for r in found] == [("q", "c", None)]


def test_freezes_are_equal_whatever_the_partitions(spark, contexts, frozen, tmp_path):
    again = freeze.freeze(frozen[2].repartition(3), contexts.repartition(4), str(tmp_path / "b"), freeze.approval(frozen[2]))
    assert again == frozen[1]
    none = frozen[2].limit(0)
    assert freeze.freeze(none, contexts, str(tmp_path / "none"), freeze.approval(none))["rows"] == 0
    assert freeze.open_frozen(spark, str(tmp_path / "none"), contexts).count() == 0


@pytest.mark.parametrize(
    "change, code",
    [
        (lambda d: d.withColumn("canonical_start", F.when(F.col("context_id") == "9", 3).otherwise(F.col("canonical_start"))), "PROVENANCE"),
        (lambda d: d.withColumn("canonical_end", F.lit(999)), "PROVENANCE"),
        (lambda d: d.withColumn("context_id", F.when(F.col("context_id") == "9", "77").otherwise(F.col("context_id"))), "CONTEXT_INVALID"),
        (lambda d: d.withColumn("document_number_key", F.lit("x")), "KEY"),
        (lambda d: d.unionByName(d), "DUPLICATE"),
    ],
)
def test_bad_proposals_are_refused(contexts, frozen, tmp_path, change, code):
    bad = change(frozen[2])
    with pytest.raises(ValueError, match=code):
        freeze.freeze(bad, contexts, str(tmp_path / "x"), freeze.approval(bad))
    with pytest.raises(ValueError, match="APPROVAL"):
        freeze.freeze(bad, contexts, str(tmp_path / "y"), freeze.approval(frozen[2]))


@pytest.mark.parametrize(
    "change, code",
    [
        (lambda d: d.withColumn("canonical_start", F.col("canonical_start") + 0 * F.col("place") + F.when(F.col("place") == 1, 1).otherwise(0)), "CHECKSUM"),
        (lambda d: d.withColumn("place", F.lit(2) - F.col("place")), "ORDER"),
        (lambda d: d.where("place < 2"), "MANIFEST"),
        (lambda d: d.withColumn("place", F.col("place") + 1), "MANIFEST"),
    ],
)
def test_altered_artifacts_are_refused(spark, contexts, frozen, tmp_path, change, code):
    path = str(tmp_path / "z")
    change(spark.read.parquet(f"{frozen[0]}/aliases")).write.parquet(f"{path}/aliases")
    for name in ("links", "manifest"):
        spark.read.parquet(f"{frozen[0]}/{name}").write.parquet(f"{path}/{name}")
    with pytest.raises(ValueError, match=code):
        freeze.open_frozen(spark, path, contexts)


def test_another_corpus_is_refused(spark, contexts, frozen):
    with pytest.raises(ValueError, match="MANIFEST"):
        freeze.open_frozen(spark, frozen[0], contexts.withColumn("passage", F.concat("passage", F.lit("."))))
