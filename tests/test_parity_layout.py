"""ranking_parity scores all pairs over the documents as they lie: texts are not dealt to a fixed number of tasks first."""

from corpusloom import queries_retrieval as queries


def test_texts_of_the_ground_truth_are_not_dealt_out(spark, monkeypatch):
    given, score = [], queries.retrieve.bm25_scores
    monkeypatch.setattr(queries.retrieve, "bm25_scores", lambda chunks, questions: given.append(chunks) or score(chunks, questions))
    row = queries.ranking_parity(spark, "/root/testdata/sf0.001").first()
    assert row.rows > 0
    assert row.same_order and row.equal
    assert "Exchange" not in given[0]._jdf.queryExecution().executedPlan().toString()
