"""Proximity matches of windows that repeat a word."""

from pyspark.sql import functions as F

from corpusloom.llm import decontaminate


def test_repeated_words_must_repeat(spark):
    d = spark.createDataFrame([(1, "b x a"), (2, "a z b a"), (3, "a b"), (4, "a a a")], "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    tokens = decontaminate.item_terms(spark.createDataFrame([(1, "a b a")], "item_id long, text string"))
    terms = tokens.select("term").distinct().withColumn("tid", F.xxhash64("term"))
    postings = decontaminate.build_index(d, terms)
    known = tokens.join(terms, "term").join(postings.groupBy("tid").agg(F.count("*").alias("freq")), "tid")
    assert {r.doc_id for r in decontaminate.proximity_matches(postings, known, reach=5).collect()} == {2}
