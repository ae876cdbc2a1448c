"""Inverted index, BM25, hierarchy-aware sparse ranking, exact vectors and exact references.

Rankings are rows (question_id, chunk_id, score, rank). Scores are compared after rounding to SCALE digits,
ties go to the smaller id in UTF-8 order, so an order never depends on the order of summation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as tx
from corpusloom.operators import blockmax
from corpusloom.operators.blockmax import B, K1, SCALE, Postings
from corpusloom.operators.dense import cosine  # noqa: F401  one of the rankings
from corpusloom.plans.materialize import bucketed

#: Query terms up to which the query side is broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 100_000


def ranked(scores: DataFrame, k: int, by: str = "question_id", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The first k rows of each group by rounded score, then id; a limit is applied before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.round(score, SCALE).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tokenised(chunks: DataFrame) -> DataFrame:
    """The index table (chunk_id, dl, t) of chunks (chunk_id, text): each chunk's terms in order, written once and bucketed by chunk.

    All that a ranking needs of the corpus is read from it: statistics from dl, document frequencies from t, and scores, which are
    summed per question and chunk without a shuffle, as a chunk's terms are in one bucket.
    """
    return bucketed(chunks.select("chunk_id", tx.terms(F.col("text")).alias("t")).withColumn("dl", F.size("t")), "index", "chunk_id")


def _indexed(chunks: DataFrame) -> DataFrame:
    return chunks if {"t", "dl"} <= set(chunks.columns) else tokenised(chunks)


def postings(index: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Rows (term, chunk_id, tf, dl) of an index; of the terms in vocabulary (term) only, if given."""
    tokens = index.select("chunk_id", "dl", F.explode("t").alias("term"))
    if vocabulary is not None:
        tokens = tokens.join(vocabulary, "term", "left_semi")
    return tokens.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf")).select("term", "chunk_id", "tf", "dl")


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row (n, avgdl)."""
    return index.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(questions: DataFrame) -> DataFrame:
    """Rows (question_id, term) of questions (question_id, question)."""
    return questions.select("question_id", F.explode(F.array_distinct(tx.terms(F.col("question")))).alias("term"))


def small(table: DataFrame) -> DataFrame:
    """table, with the hint to broadcast it where it has few rows of short values."""
    return F.broadcast(table) if table.count() <= BROADCAST_TERMS else table


def bm25_scores(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """All scores: rows (question_id, chunk_id, score) with a score over 0; unique query terms, idf = log1p((n - df + .5) / (df + .5)). Rankings take `bm25`, which has no row of each pair.

    chunks is an index, or (chunk_id, text), which is tokenised then.
    """
    index, asked = _indexed(chunks), query_terms(questions)
    vocabulary = small(asked.select("term").distinct())
    stats = corpus_stats(index).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    df = index.select(F.explode(F.array_distinct("t")).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    weighted = small(asked.join(df.select("term", idf.alias("idf")), "term"))
    hits = postings(index, vocabulary).withColumn("weight", weight).join(weighted, "term")
    return hits.groupBy("question_id", "chunk_id").agg(F.sum(F.col("idf") * F.col("weight")).alias("score")).where("score > 0")


def _postings(chunks: DataFrame | Postings, questions: DataFrame) -> Postings:
    return chunks if isinstance(chunks, Postings) else blockmax.build(chunks, questions)


def bm25(chunks: DataFrame | Postings, questions: DataFrame, k: int = 12) -> DataFrame:
    """BM25 ranking. chunks is (chunk_id, text), (chunk_id, t) with terms in order, or postings that blockmax has built of them; ids must be unique."""
    return blockmax.bm25(_postings(chunks, questions), questions, k)


def lexical(chunks: DataFrame | Postings, questions: DataFrame, k: int = 50) -> DataFrame:
    """Ranking by the Jaccard similarity of term sets: the deterministic stand-in for a model's scores. chunks as for bm25."""
    return blockmax.lexical(_postings(chunks, questions), questions, k)


def legal_sparse(discovered: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = 50, body: float = 0.75) -> DataFrame:
    """Reranks discovered (question_id, chunk_id, score) by body * score / max + (1 - body) * the share of query terms in the path.

    chunks has (chunk_id, path), path an array of strings.
    """
    most = Window.partitionBy("question_id")
    q = questions.select("question_id", F.array_distinct(tx.terms(F.col("question"))).alias("q"))
    path = F.array_distinct(tx.terms(F.concat_ws(" ", "path")))
    joined = discovered.join(q, "question_id").join(chunks.select("chunk_id", path.alias("p")), "chunk_id")
    share = F.size(F.array_intersect("q", "p")) / F.size("q")
    score = F.lit(body) * F.col("score") / F.max("score").over(most) + F.lit(1 - body) * share
    return ranked(joined.withColumn("score", score), k).select("question_id", "rank", "chunk_id", "score")


def audit_vectors(vectors: DataFrame, expected: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """One row of counts: missing, extra, duplicate, non-finite, zero and non-unit vectors against expected (chunk_id)."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bad = F.exists("embedding", lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    v = vectors.select("chunk_id", norm.alias("norm"), bad.alias("bad"))
    counts = v.agg(
        F.count("*").alias("rows"), (F.count("*") - F.count_distinct("chunk_id")).alias("duplicate_ids"), F.count_if("bad").alias("non_finite"),
        F.count_if(F.col("norm") == 0).alias("zero"), F.count_if(F.abs(F.col("norm") - 1) > tolerance).alias("non_unit"),
    )
    missing = expected.join(v, "chunk_id", "left_anti").agg(F.count("*").alias("missing"))
    extra = v.join(expected, "chunk_id", "left_anti").agg(F.count("*").alias("extra"))
    return counts.crossJoin(missing).crossJoin(extra)  # three tables of one row


def normalized_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors of length 1."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn("n", norm).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") / F.col("n"))).drop("n")


def alias_proposals(contexts: DataFrame, head: int = 256) -> DataFrame:
    """Rows (context_id, keys, proposal, state) from the document numbers in the first code points of each passage."""
    keys = F.array_sort(F.array_distinct(F.transform(tx.document_numbers(F.substring("passage", 1, head)), tx.document_number_key)))
    found = contexts.select("context_id", keys.alias("keys"))
    state = F.when(F.size("keys") == 0, "NO_CANDIDATE").when(F.size("keys") == 1, "PROPOSED").otherwise("AMBIGUOUS")
    return found.select("context_id", "keys", F.when(F.size("keys") == 1, F.col("keys")[0]).alias("proposal"), state.alias("state"))


def resolve_exact(references: DataFrame, aliases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (question_id, chunk_id, diagnostic): the one chunk of each parsed reference, or why there is none.

    references (question_id, document_key, article, clause, point), aliases (document_key, context_id), chunks
    (chunk_id, context_id, hierarchy_path, hierarchy_kind, hierarchy_ordinal). A reference with a document_key is looked for in the one context of
    that key, one without in all contexts. Groups give their smallest and largest id only, so a key of many contexts and a
    coordinate of many chunks cost no more than others; all joins are on keys, and equal coordinates are looked for once.
    """

    def member(label: str, value: Column) -> Column:
        return value.isNull() | F.exists("hierarchy_path", lambda p: F.lower(p) == F.concat(F.lit(label), value))

    kind = F.when(F.col("point").isNotNull(), "point").when(F.col("clause").isNotNull(), "clause").otherwise("article")
    leaf = F.coalesce("point", "clause", "article")
    fits = (F.col("hierarchy_kind") == kind) & (F.col("hierarchy_ordinal") == leaf) & member("điều ", F.col("article")) & member("khoản ", F.col("clause"))
    ends = [F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last")]
    place = chunks.select("chunk_id", F.col("context_id").alias("place"), "hierarchy_path", "hierarchy_kind", "hierarchy_ordinal")
    coordinate = ["article", "clause", "point"]

    numbered = references.where("document_key IS NOT NULL").join(aliases.distinct(), "document_key", "left")
    numbered = numbered.groupBy("question_id", *coordinate).agg(F.min("context_id").alias("lo"), F.max("context_id").alias("hi"))
    numbered = numbered.join(place, (F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("place")) & fits, "left").groupBy("question_id", "lo", "hi").agg(*ends)
    state = F.when(F.col("lo").isNull(), "EXACT_DOCUMENT_UNRESOLVED").when(F.col("lo") < F.col("hi"), "EXACT_DOCUMENT_AMBIGUOUS")

    free = references.where("document_key IS NULL").select("question_id", *coordinate)
    hits = place.join(small(free.select(*coordinate).distinct()), fits).groupBy(*coordinate).agg(*ends)
    hits = hits.select(*[F.col(c).alias(f"at_{c}") for c in coordinate], "first", "last")
    free = free.join(hits, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in coordinate]), "left")

    matched = numbered.select("question_id", "first", "last", state.alias("state")).unionByName(free.select("question_id", "first", "last", F.lit(None).cast("string").alias("state")))
    diagnostic = F.coalesce("state", F.when(F.col("first").isNull(), "EXACT_COORDINATE_UNRESOLVED").when(F.col("first") < F.col("last"), "EXACT_COORDINATE_MULTI_CHUNK"))
    return matched.select("question_id", F.when(diagnostic.isNull(), F.col("first")).alias("chunk_id"), diagnostic.alias("diagnostic"))
