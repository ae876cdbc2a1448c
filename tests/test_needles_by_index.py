"""Needles are looked up in an index instead of all texts."""

from corpusloom.operators import blockmax, metrics

TEXTS = ["a b c d", "c d a", "x a b c", "A b, c", None, "", "b c d e", "a b c d e"]
NEEDLES = [("1", "b c"), ("2", "c d"), ("3", "zz"), ("4", ""), ("5", None), ("6", "d e")]


def test_needles_by_the_index(spark, monkeypatch):
    labels, write = [], metrics.written
    monkeypatch.setattr(metrics, "written", lambda df, label: labels.append(label) or write(df, label))
    hay = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "chunk_id string, text string").repartition(3)
    needles = spark.createDataFrame(NEEDLES, "needle_id string, text string")
    rows = lambda df: sorted((r.needle_id, r.chunk_id) for r in df.collect())
    want = rows(metrics.containment_join(hay, needles))
    assert ("1", "0") in want and ("6", "7") in want
    labels.clear()
    for postings in (blockmax.build(hay), blockmax.build(hay, needles.selectExpr("needle_id AS question_id", "text AS question"))):
        assert rows(metrics.containment_join(hay, needles, postings)) == want
    monkeypatch.setattr(blockmax, "FEW", 1)
    assert rows(metrics.containment_join(hay, needles, postings)) == want
    assert "needle-terms" not in labels
    assert rows(metrics.containment_join(hay, spark.createDataFrame([], needles.schema), postings)) == []
