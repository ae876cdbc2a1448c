"""Rank fusion, sparse/dense diagnosis and learning-to-rank features over rankings (question_id, rank, chunk_id, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import legal
from corpusloom.functions import text as tx
from corpusloom.operators.retrieve import ranked, small

MISSING_RANK = 51
# fixed values: words that mark legal questions, and labels of coordinates in a path
LEGAL_TERMS = ("bộ", "chương", "điều", "điểm", "khoản", "luật", "mục", "nghị", "phần", "pháp", "quyết", "thông", "tư", "định")
_LABELS = (("article", "điều"), ("clause", "khoản"), ("point", "điểm"))


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 50, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over any number of rankings."""
    parts = [r.select("question_id", "chunk_id", (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("part")) for r in rankings]
    scores = reduce(DataFrame.unionByName, parts).groupBy("question_id", "chunk_id").agg(F.sum("part").alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.round("score", 12).desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "rank", "chunk_id", "score")


def union_rank(exact: DataFrame, sparse: DataFrame, limit: int = 12) -> DataFrame:
    """Exact hits first, then by sparse score, nulls last; one row per chunk, conflicting scores of a chunk are an error."""
    both = exact.select("question_id", "chunk_id", F.lit(True).alias("exact"), F.lit(None).cast("double").alias("score")).unionByName(sparse.select("question_id", "chunk_id", F.lit(False).alias("exact"), "score"))
    one = both.groupBy("question_id", "chunk_id").agg(F.bool_or("exact").alias("exact"), F.max("score").alias("score"), F.count_distinct("score").alias("n"))
    one = one.withColumn("score", F.when(F.col("n") <= 1, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("conflicting scores of "), F.col("chunk_id"))).cast("double")))
    order = Window.partitionBy("question_id").orderBy(F.col("exact").desc(), F.round("score", 6).desc_nulls_last(), "chunk_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("question_id", "rank", "chunk_id", "exact", "score")


def best_ranks(ranking: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Rows (question_id, name): the best rank of a labelled chunk, for questions that have one."""
    return ranking.join(labels.select("question_id", "chunk_id").distinct(), ["question_id", "chunk_id"]).groupBy("question_id").agg(F.min("rank").alias(name))


def diagnose(sparse: DataFrame, dense: DataFrame, labels: DataFrame, depth: int = 50) -> DataFrame:
    """Rows (question_id, sparse_rank, dense_rank, outcome, rank_delta) for every labelled question."""
    s, d = (best_ranks(r.where(F.col("rank") <= depth), labels, n) for r, n in ((sparse, "sparse_rank"), (dense, "dense_rank")))
    q = labels.select("question_id").distinct().join(s, "question_id", "left").join(d, "question_id", "left")
    outcome = F.when(F.col("sparse_rank").isNotNull() & F.col("dense_rank").isNotNull(), "BOTH").when(F.col("sparse_rank").isNotNull(), "SPARSE_ONLY").when(F.col("dense_rank").isNotNull(), "DENSE_ONLY").otherwise("NEITHER")
    return q.select("question_id", "sparse_rank", "dense_rank", outcome.alias("outcome"), (F.col("dense_rank") - F.col("sparse_rank")).alias("rank_delta"))


def union_coverage(rankings: list[DataFrame], labels: DataFrame, cutoffs=(5, 10, 20, 50)) -> DataFrame:
    """Rows (cutoff, recall, set_recall, assignment_recall, mean_pool) of the union of rankings up to each cutoff."""
    both = reduce(DataFrame.unionByName, [r.select("question_id", "chunk_id", "rank") for r in rankings])
    best = both.groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank"))
    lab = labels.select("question_id", "chunk_id").distinct()
    asked = lab.groupBy("question_id").agg(F.count("*").alias("positives"))
    cuts = F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("cutoff")
    pool = best.join(asked, "question_id", "left_semi").select("question_id", "chunk_id", "rank", cuts).where("rank <= cutoff")
    per = pool.join(lab.withColumn("hit", F.lit(1)), ["question_id", "chunk_id"], "left").groupBy("question_id", "cutoff").agg(F.count("*").alias("pool"), F.count("hit").alias("hits"))
    grid = asked.select("question_id", "positives", cuts).join(per, ["question_id", "cutoff"], "left").fillna(0, ["pool", "hits"])
    return grid.groupBy("cutoff").agg(
        F.avg((F.col("hits") > 0).cast("double")).alias("recall"), F.avg((F.col("hits") == F.col("positives")).cast("double")).alias("set_recall"),
        (F.sum("hits") / F.sum("positives")).alias("assignment_recall"), F.avg("pool").alias("mean_pool"),
    )


def _of_candidates(chunks: DataFrame, rankings: list[DataFrame], depth: int) -> DataFrame:
    """The chunks that one of the rankings has among its first; they are few, so what is computed of a chunk should be computed of them alone."""
    ids = reduce(DataFrame.unionByName, [r.where(F.col("rank") <= depth).select("chunk_id") for r in rankings])
    return chunks.join(small(ids.distinct()), "chunk_id", "left_semi")


def ltr_features(sparse: DataFrame, dense: DataFrame, questions: DataFrame, chunks: DataFrame, labels: DataFrame, depth: int = 50, legal_terms: tuple[str, ...] = ()) -> DataFrame:
    """The candidate table of two rankings with scores, ranks, lengths, overlaps and source flags; label 1 for positives. fusion_features adds the features of citations."""
    s = sparse.where(F.col("rank") <= depth).select("question_id", "chunk_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    d = dense.where(F.col("rank") <= depth).select("question_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    both = s.join(d, ["question_id", "chunk_id"], "full_outer")
    q = questions.select("question_id", tx.terms(F.col("question")).alias("qt"))
    c = _of_candidates(chunks, [sparse, dense], depth).select("chunk_id", tx.terms(F.col("text")).alias("ct"))
    lab = labels.select("question_id", "chunk_id").distinct().withColumn("label", F.lit(1))
    rows = both.join(q, "question_id").join(c, "chunk_id").join(lab, ["question_id", "chunk_id"], "left")
    qs, cs = F.array_distinct("qt"), F.array_distinct("ct")
    union, named = F.size(F.array_union(qs, cs)), F.array_intersect(qs, F.array(*[F.lit(t) for t in legal_terms]).cast("array<string>"))
    return rows.select(
        "question_id", "chunk_id", F.coalesce("label", F.lit(0)).alias("label"),
        F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), F.coalesce("bm25_rank", F.lit(MISSING_RANK)).cast("double").alias("bm25_rank"),
        F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("dense_rank", F.lit(MISSING_RANK)).cast("double").alias("dense_rank"),
        F.size("qt").cast("double").alias("query_length"), F.size("ct").cast("double").alias("candidate_length"),
        F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(qs, cs)) / union).alias("lexical_overlap"),
        F.when(F.size(named) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(named, cs)) / F.greatest(F.size(named), F.lit(1))).alias("legal_term_overlap"),
        (F.col("bm25_rank").isNotNull().cast("int") + 2 * F.col("dense_rank").isNotNull().cast("int")).cast("double").alias("source_retriever_flags"),
    )


def _part(path, label: str):
    """The last ordinal under one label of a path, as its members are read in order; null without."""
    member = F.transform(path, tx.collapsed)
    return F.try_element_at(F.filter(F.transform(member, lambda p: F.when(p.startswith(label + " "), F.substring(p, len(label) + 2, 1000))), lambda p: p.isNotNull()), F.lit(-1))


def fusion_features(sparse: DataFrame, dense: DataFrame, questions: DataFrame, chunks: DataFrame, labels: DataFrame, exact: DataFrame, aliases: DataFrame, laws: DataFrame, depth: int = 50) -> DataFrame:
    """The candidate table with all 16 features: those of ltr_features with LEGAL_TERMS, and seven of the question's citations.

    chunks also has context_id and path; exact (question_id, chunk_id) are resolved references, aliases (document_key, context_id), laws (context_id, law_key).
    Exact hits are marked and flagged (4) among the candidates of the two rankings. A citation counts its coordinates that the path lacks; without any the distance is 3.
    """
    rows = ltr_features(sparse, dense, questions, chunks, labels, depth, LEGAL_TERMS)
    c = questions.select("question_id", legal.citations_of(F.col("question")).alias("citations"))
    numbers = c.select("question_id", F.explode("citations").alias("c")).select("question_id", tx.document_number_key(F.col("c.document_number")).alias("document_key"))
    named = numbers.join(aliases, "document_key").select("question_id", "context_id").distinct().withColumn("by_number", F.lit(1.0))
    law = laws.groupBy("context_id").agg(F.collect_set("law_key").alias("law_keys"))
    hit = exact.select("question_id", "chunk_id").where("chunk_id IS NOT NULL").distinct().withColumn("hit", F.lit(1.0))
    place = _of_candidates(chunks, [sparse, dense], depth).select("chunk_id", "context_id", *[_part(F.col("path"), label).alias(kind) for kind, label in _LABELS])
    j = rows.join(place, "chunk_id").join(c, "question_id").join(hit, ["question_id", "chunk_id"], "left").join(named, ["question_id", "context_id"], "left").join(law, "context_id", "left")
    one = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    same = lambda kind: lambda x: F.coalesce(x[kind] == F.col(kind), F.lit(False))
    match = {kind: one(F.exists("citations", same(kind))) for kind, _ in _LABELS}
    asked = F.filter("citations", lambda x: x["article"].isNotNull() | x["clause"].isNotNull() | x["point"].isNotNull())
    missed = lambda x, kind: (x[kind].isNotNull() & ~x[kind].eqNullSafe(F.col(kind))).cast("double")
    distance = F.coalesce(F.array_min(F.transform(asked, lambda x: missed(x, "article") + missed(x, "clause") + missed(x, "point"))), F.lit(3.0))
    flag = F.coalesce("hit", F.lit(0.0))
    return j.select(
        "question_id", "chunk_id", "label", "bm25_score", "bm25_rank", "dense_score", "dense_rank", flag.alias("exact_reference_flag"), F.coalesce("by_number", F.lit(0.0)).alias("document_id_match"),
        one(F.arrays_overlap(F.transform("citations", lambda x: x["law_identity"]), F.col("law_keys"))).alias("law_title_match"), match["article"].alias("article_number_match"),
        match["clause"].alias("clause_match"), match["point"].alias("point_match"), "query_length", "candidate_length", "lexical_overlap", "legal_term_overlap",
        distance.alias("hierarchy_distance"), (F.col("source_retriever_flags") + 4 * flag).alias("source_retriever_flags"),
    )


def parity(left: DataFrame, right: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row (rows, same_order, max_delta, equal) comparing two rankings."""
    both = left.select("question_id", "rank", F.col("chunk_id").alias("l"), F.col("score").alias("ls")).join(right.select("question_id", "rank", F.col("chunk_id").alias("r"), F.col("score").alias("rs")), ["question_id", "rank"], "full_outer")
    out = both.agg(F.count("*").alias("rows"), F.coalesce(F.bool_and(F.col("l").eqNullSafe(F.col("r"))), F.lit(True)).alias("same_order"), F.max(F.abs(F.col("ls") - F.col("rs"))).alias("max_delta"))
    return out.withColumn("equal", F.col("same_order") & (F.coalesce("max_delta", F.lit(0.0)) <= tolerance))


def reranked(pool: DataFrame, k: int | None = None) -> DataFrame:
    """Orders a bounded pool (question_id, chunk_id, score) by a model's score; scores must be finite."""
    ok = pool.withColumn("score", F.when(F.isnan("score") | F.col("score").isNull(), F.raise_error(F.lit("scores must be finite")).cast("double")).otherwise(F.col("score")))
    return ranked(ok, k or 2**31 - 1).select("question_id", "rank", "chunk_id", "score")
