"""Parsers of legal text and the index of blocks get batches that are limited by bytes, whatever the rows are."""

import random
import unicodedata

import pandas as pd
from corpusloom.functions import legal
from corpusloom.operators import blockmax, fuse, metrics
from corpusloom.plans import arrow
from pyspark.sql import functions as F

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_parsers_get_bounded_batches(spark):
    @F.pandas_udf("long")
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    spark.conf.unset(LIMIT)
    long = spark.range(48).coalesce(1).select(F.repeat(F.lit("a"), 500_000).alias("text"))  # half a megabyte each
    for parser in (legal.chunks_of, legal.hierarchy_of, legal.citations_of, legal.reference_of):
        seen = long.select(F.size(F.array(parser(F.col("text")))).alias("n"), rows("text").alias("rows")).agg(F.sum("n"), F.max("rows")).first()
        assert seen[0] == 48 and seen[1] <= arrow.BATCH / 480_000 + 1


def test_spans_are_those_of_each_character():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(chr(rng.choice([rng.randrange(0x110000), rng.randrange(128), rng.randrange(128), 32, 0x1EA5, 0x301])) for _ in range(rng.randrange(50)))
        kinds = [unicodedata.category(c)[0] for c in text]
        want, begin = [], None
        for i, k in enumerate([*kinds, "Z"]):
            if k in "LMN":
                begin = i if begin is None else begin
                continue
            if begin is not None:
                want.append((begin, i))
                begin = None
            if k in "PS":
                want.append((i, i + 1))
        assert legal._token_spans(text) == want


def test_the_index_gets_bounded_batches(spark, monkeypatch, tmp_path):
    whole = blockmax._blocked

    def noted(batches, asked=None):
        def told():
            for b in batches:
                (tmp_path / str(b.num_rows)).touch()
                yield b

        yield from whole(told(), asked)

    monkeypatch.setattr(blockmax, "_blocked", noted)
    spark.conf.unset(LIMIT)
    chunks = spark.range(48).coalesce(1).select(F.col("id").cast("string").alias("chunk_id"), F.repeat(F.lit("abcdefghi "), 50_000).alias("text"))
    assert blockmax.build(chunks).n == 48
    assert max(int(p.name) for p in tmp_path.iterdir()) <= arrow.BATCH / 450_000 + 1


def test_texts_that_no_ranking_or_needle_fetches_are_not_tokenised_again(spark):
    def texts(df):
        return df.select("chunk_id", F.when(F.col("chunk_id") == "no", F.raise_error(F.lit("tokenised")).cast("string")).otherwise(F.col("text")).alias("text"))

    chunks = spark.createDataFrame([("a", "x y z"), ("b", "y z"), ("no", "w")], "chunk_id string, text string")
    ranking = spark.createDataFrame([("q", 1, "a", 1.0), ("q", 51, "no", 0.5)], "question_id string, rank int, chunk_id string, score double")
    asked, none = spark.createDataFrame([("q", "y x")], "question_id string, question string"), spark.createDataFrame([], "question_id string, chunk_id string")
    assert fuse.ltr_features(ranking, ranking.limit(0), asked, texts(chunks), none).select("chunk_id", "candidate_length").collect() == [("a", 3.0)]
    spans = texts(chunks).select("chunk_id", F.lit("d").alias("context_id"), F.array(F.lit("p")).alias("path"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.length("text").alias("cost"))
    assert metrics.set_metrics(ranking.where("rank = 1"), none.withColumn("grade", F.lit(1)), spans, asked).count() == 1
    needles = spark.createDataFrame([("n", "Y z"), ("m", "z y"), ("o", "q"), ("e", "")], "needle_id string, text string")
    assert sorted(map(tuple, metrics.containment_join(chunks, needles).collect())) == [("n", "a"), ("n", "b")]
