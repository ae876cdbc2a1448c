"""Queries over legal text read the tables of sf_dir whole: the fixture written as tables, with other rows around it."""

import pytest
from pyspark.sql import functions as F

from corpusloom import queries_corpus, registry
from corpusloom.functions import legal
from corpusloom.operators import corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("legal"))
    docs = [(int(i), f"{name}\n{passage}") for i, name, passage in queries_corpus.CONTEXTS] + [(4, None), (5, ""), (6, "x " * 600), (7, "lời " * 40_000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    turns = []
    for n, (_, q, a) in enumerate(queries_corpus.QUESTIONS):
        turns += [(n, 0, "user", q), (n, 1, "assistant", a)]
    turns += [(9, 0, "user", None), (9, 1, "assistant", None), (9, 2, "system", "Điều 1 khoản 2 trừ 5%")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    items = [(1, "được cấp giấy chứng nhận"), (2, "Phạt 10 triệu đồng trong 30 ngày"), (3, None), (4, "không ở đâu cả")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows(spark, name, d):
    return [tuple(r) for r in (registry.queries() | queries_corpus.ON_FIXTURE)[name](spark, d).collect()]


def renamed(found, turn):
    """Fixture rows with the conversation's id for the question's."""
    ids = {q[0]: f"{n}:{turn}" for n, q in enumerate(queries_corpus.QUESTIONS)}
    return [(ids[r[0]], *r[1:]) for r in found]


def test_documents_are_chunked_whole(spark, tables):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    want = {(str(i), len(c), sum(x["tokens"] for x in c)) for i, t in texts.items() if (c := legal.chunks(t))}
    assert set(rows(spark, "hierarchy_chunks", tables)) == want and len(want) == 5
    assert {r[0] for r in rows(spark, "document_aliases", tables)} == {str(i) for i in texts}
    got = {r[0]: r[1:] for r in rows(spark, "document_aliases", tables)}
    assert {r[0]: r[1:] for r in rows(spark, "alias_headers", tables)}.items() <= got.items()
    assert set(rows(spark, "document_warnings", tables)) == set(rows(spark, "hierarchy_warnings", tables))


def test_answers_and_questions_are_read_whole(spark, tables):
    assert sorted(rows(spark, "answer_citations", tables), key=repr) == sorted(renamed(rows(spark, "citations", tables), 1), key=repr)
    got = set(rows(spark, "answer_supervision", tables))
    assert got == {*renamed(rows(spark, "supervision_classes", tables), 1), ("9:1", "UNRESOLVED", 0, 0.0)}
    fixture = renamed(rows(spark, "exact_resolve", tables), 0)
    found = rows(spark, "question_resolution", tables)
    assert {*fixture, ("9:0", None, "EXACT_COORDINATE_ABSENT")} <= set(found) and len(found) == len(queries_corpus.QUESTIONS) + 1 + 4
    assert set(renamed(rows(spark, "question_taxonomy", tables), 0)) <= set(rows(spark, "question_types", tables))
    signals = {r[0]: r[1:] for r in rows(spark, "semantic_signals", tables)}
    assert len(signals) == 6 and signals["1:1"] == (True, True, False, False, True, False) and signals["9:1"][0] is False
    assert registry.queries()["legal_patterns"](spark, tables).first().asDict().items() >= {"n": 13, "percentage": 1}.items()


def test_negatives_come_from_the_documents(spark, tables):
    found = registry.queries()["hard_negatives"](spark, tables)
    assert {r.question_id for r in found.collect()} <= {"1", "2"}
    contexts = queries_corpus._passages(spark, tables)
    chunks = corpus.chunked(contexts).select("chunk_id", "context_id", F.concat_ws("/", "path").alias("path"))
    got = {(r.question_id, r.context_id) for r in found.join(chunks, "chunk_id").collect()}
    assert got == {("1", "1")}  # the clauses of context 2 are short, so they are one chunk


def test_every_copy_has_a_row(spark, tmp_path):
    near = "abcdefghij" * 20
    docs = [(8, near), (3, near + "k"), (5, near.upper() + "!"), (1, "copies only"), (2, "Copies, only"), (9, "copies only"), (4, "alone"), (6, None), (7, None), (10, ""), (11, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["char_5gram_neardup"](spark, str(tmp_path)).collect()
    assert [(r.a, r.b, r.inter, r.total) for r in found if r.kind == "near"] == [(3, 5, 10, 11)]
    assert {r.b: r.a for r in found if r.kind == "member"} == {8: 5, 5: 5, 3: 3, 1: 1, 2: 1, 9: 1, 4: 4, 6: 6, 7: 7, 10: 10, 11: 10}
    assert len(found) == len(docs) + 1
