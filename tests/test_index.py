"""The persistent index, its lookups, and retrieval of questions over it."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index, retrieve

CHUNK = "chunk_id string, context_id string, hierarchy_path array<string>, hierarchy_kind string, hierarchy_ordinal string, text string"
CHUNKS = [
    ("1/d1", "1", ["Điều 1"], "article", "1", "phạm vi của đất đai"),
    ("1/d2/k1", "1", ["Điều 2", "Khoản 1"], "clause", "1", "người dùng đất có quyền"),
    ("2/d1", "2", ["Điều 1"], "article", "1", "mức phạt tiền"),
    ("2/d7", "2", ["Điều 7"], "article", "7", "phạt đất"),
    ("2/d7b", "2", ["Điều 8"], "article", "8", ""),
    ("3", "3", None, None, None, None),
]
ALIASES = [("45/2013/qh13", "1"), ("9/2020/nd-cp", "2"), ("9/2020/nd-cp", "3"), ("1/2001/cv-a", "2")]
QUESTIONS = [
    ("numbered", "Điều 1 số 45/2013/QH13 về phạt"),
    ("alone", "Điều 7 quy định đất gì?"),
    ("many", "Điều 1 là gì?"),
    ("absent", "Điều 99 là gì?"),
    ("unknown", "Điều 1 số 77/1999/QH10"),
    ("twice", "Điều 1 số 9/2020/NĐ-CP"),
    ("elsewhere", "Điều 7 số 45/2013/QH13"),
    ("none", "phạt bao nhiêu tiền"),
    ("null", None),
]


@pytest.fixture(scope="module")
def opened(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "one")
    extra = spark.createDataFrame(CHUNKS, CHUNK).withColumn("t", F.lit("clash")).withColumn("dl", F.lit(-1))
    index.build_index(extra, path)
    return path, index.open_index(spark, path)


def test_rankings_over_an_opened_index(spark, opened):
    asked = spark.createDataFrame(QUESTIONS, "question_id string, question string")
    plain = spark.createDataFrame(CHUNKS, CHUNK).select("chunk_id", "text")
    for search in (retrieve.bm25, retrieve.lexical):
        want = [tuple(r) for r in search(plain, asked, 3).orderBy("question_id", "rank").collect()]
        assert [tuple(r) for r in search(opened[1], asked, 3).orderBy("question_id", "rank").collect()] == want and want


def test_lookups(opened):
    ids = lambda df: [r.chunk_id for r in df.collect()]
    assert sorted(ids(index.chunks_of_context(opened[1], "2"))) == ["2/d1", "2/d7", "2/d7b"]
    assert ids(index.chunks_of_context(opened[1], "x")) == []
    assert sorted(ids(index.chunks_at(opened[1], "article", "1"))) == ["1/d1", "2/d1"]
    assert ids(index.chunks_at(opened[1], None, None)) == ["3"]
    assert ids(index.chunks_by_ids(opened[1], ["3", "1/d1", "2/d7"])) == ["3", "1/d1", "2/d7"]
    for wrong in (["3", "3"], ["3", "nowhere"]):
        with pytest.raises(ValueError):
            index.chunks_by_ids(opened[1], wrong)


def test_only_whole_indexes_open(spark, opened, tmp_path):
    df = spark.createDataFrame(CHUNKS, CHUNK)
    with pytest.raises(Exception, match="(?i)exist"):
        index.build_index(df, opened[0])
    for bad in (df.unionByName(df.limit(1)), df.withColumn("chunk_id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            index.build_index(bad, str(tmp_path / "bad"))
    for name, change in (("rows", {"rows": F.lit(5).cast("long")}), ("k1", {"k1": F.lit(2.0)})):
        path = str(tmp_path / name)
        spark.read.parquet(f"{opened[0]}/chunks").write.parquet(f"{path}/chunks")
        spark.read.parquet(f"{opened[0]}/manifest").withColumns(change).write.parquet(f"{path}/manifest")
        with pytest.raises(ValueError, match=name):
            index.open_index(spark, path)
    path = str(tmp_path / "other")
    spark.read.parquet(f"{opened[0]}/chunks").withColumn("context_id", F.lit("9")).write.parquet(f"{path}/chunks")
    spark.read.parquet(f"{opened[0]}/manifest").write.parquet(f"{path}/manifest")
    with pytest.raises(ValueError, match="checksum"):
        index.open_index(spark, path)
    index.build_index(spark.createDataFrame([], CHUNK), str(tmp_path / "empty"))
    assert index.open_index(spark, str(tmp_path / "empty")).count() == 0


def test_questions_are_resolved_then_searched(spark, opened):
    asked = spark.createDataFrame(QUESTIONS, "question_id string, question string")
    aliases = spark.createDataFrame(ALIASES, "document_key string, context_id string")
    ranking, states = index.retrieve_questions(opened[1], asked, aliases, 2)
    assert {r.question_id: r.diagnostic for r in states.collect()} == {
        "numbered": None, "alone": None, "many": "EXACT_COORDINATE_MULTI_CHUNK", "absent": "EXACT_COORDINATE_UNRESOLVED", "unknown": "EXACT_DOCUMENT_UNRESOLVED",
        "twice": "EXACT_DOCUMENT_AMBIGUOUS", "elsewhere": "EXACT_COORDINATE_UNRESOLVED", "none": "EXACT_COORDINATE_ABSENT", "null": "EXACT_COORDINATE_ABSENT",
    }
    rows = ranking.orderBy("question_id", "rank").collect()
    exact = {r.question_id: (r.rank, r.chunk_id) for r in rows if r.exact}
    assert exact == {"numbered": (1, "1/d1"), "alone": (1, "2/d7")}
    assert max(r.rank for r in rows) == 2 and not [r for r in rows if r.question_id == "null"]
    sparse = {(r.question_id, r.chunk_id): r.score for r in retrieve.bm25(opened[1], asked, 2).collect()}
    assert all(r.score == pytest.approx(sparse[r.question_id, r.chunk_id]) for r in rows if not r.exact)


def test_empty_tables(spark):
    none = spark.createDataFrame([], CHUNK)
    asked = spark.createDataFrame(QUESTIONS, "question_id string, question string")
    aliases = spark.createDataFrame([], "document_key string, context_id string")
    found = index.resolved(asked, aliases, none)
    assert found.count() == len(QUESTIONS) and found.where("chunk_id IS NOT NULL").count() == 0
    assert index.resolved(asked.limit(0), aliases, none).count() == 0
