"""The 16 fusion features on a hand-made case and as a query over legal documents."""

import pytest

from corpusloom import queries_corpus, registry
from corpusloom.operators import fuse

NAMES = ["exact_reference_flag", "document_id_match", "law_title_match", "article_number_match", "clause_match", "point_match", "legal_term_overlap", "hierarchy_distance", "source_retriever_flags"]


def test_features_by_hand(spark):
    q = spark.createDataFrame([("q", "Điểm a khoản 1 Điều 2 số 45/2013/QH13"), ("l", "Điều 9 Luật Đất đai 2013"), ("n", "bao nhiêu"), ("z", None)], "question_id string, question string")
    chunks = spark.createDataFrame([("x", "1", ["Chương I", "Điều 2", "Khoản 1", "Điểm a"], "điều 2"), ("y", "2", ["Điều 2", "Khoản 3"], "khác"), ("r", "3", ["root"], None)], "chunk_id string, context_id string, path array<string>, text string")
    pairs = [(a, i + 1, c, 1.0) for a in "qlnz" for i, c in enumerate("xyr")]
    ranking = spark.createDataFrame(pairs, "question_id string, rank int, chunk_id string, score double")
    labels = spark.createDataFrame([("q", "x")], "question_id string, chunk_id string")
    aliases = spark.createDataFrame([("45/2013/qh13", "1")], "document_key string, context_id string")
    laws = spark.createDataFrame([("1", "luat dat dai 2013")], "context_id string, law_key string")
    exact = spark.createDataFrame([("q", "x"), ("n", None)], "question_id string, chunk_id string")
    out = fuse.fusion_features(ranking, ranking.where("rank = 1"), q, chunks, labels, exact, aliases, laws)
    assert len(out.columns) == 3 + 16
    got = {(r.question_id, r.chunk_id): [r[n] for n in NAMES] for r in out.collect()}
    assert len(got) == 12
    third = pytest.approx(1 / 3)
    assert got["q", "x"] == [1.0, 1.0, 0.0, 1.0, 1.0, 1.0, third, 0.0, 7.0]
    assert got["q", "y"] == [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 2.0, 1.0]
    assert got["l", "x"] == [0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.5, 1.0, 3.0]
    assert got["l", "r"][-2:] == [1.0, 1.0] and got["n", "x"][-2:] == [3.0, 3.0] and got["z", "r"][-2:] == [3.0, 1.0]


def test_query_reads_legal_documents(spark, tmp_path):
    docs = [(int(i), f"{name}\n{passage}") for i, name, passage in queries_corpus.CONTEXTS] + [(4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(n, question) for n, (_, question, _) in enumerate(queries_corpus.QUESTIONS)] + [(9, "Khoản 2 Điều 2 số 45/2013/QH13")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = registry.queries()["fusion_features"](spark, str(tmp_path)).where("question_id = '9'").collect()
    assert [(r.clause_match, r.article_number_match, r.document_id_match, r.hierarchy_distance) for r in found if r.exact_reference_flag == 1.0] == [(1.0, 1.0, 1.0, 0.0)]
    assert any(r.document_id_match == 0.0 and r.hierarchy_distance > 0 for r in found)
