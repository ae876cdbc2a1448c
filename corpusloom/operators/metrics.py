"""Retrieval and answer metrics over rankings (question_id, rank, chunk_id) and labels (question_id, chunk_id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as tx
from corpusloom.operators import blockmax
from corpusloom.operators.retrieve import small
from corpusloom.plans.materialize import written


def per_question(ranking: DataFrame, labels: DataFrame, questions: DataFrame | None = None, depth: int = 10) -> DataFrame:
    """Rows (question_id, relevant, recall_at_1/5/10, mrr_at_10, set_recall_at_10); questions without labels have relevant 0 and null metrics."""
    lab = labels.where(F.col("grade") > 0).select("question_id", "chunk_id").distinct()
    counts = lab.groupBy("question_id").agg(F.count("*").alias("relevant"))
    hits = ranking.where(F.col("rank") <= depth).join(lab, ["question_id", "chunk_id"])
    hits = hits.groupBy("question_id").agg(*[F.count_if(F.col("rank") <= c).alias(f"h{c}") for c in (1, 5, depth)], F.min("rank").alias("first"))
    base = (questions if questions is not None else counts).select("question_id").distinct()
    out = base.join(counts, "question_id", "left").join(hits, "question_id", "left").fillna(0, ["relevant", "h1", "h5", f"h{depth}"])
    share = lambda n: F.when(F.col("relevant") > 0, F.col(n) / F.greatest(F.col("relevant"), F.lit(1)))
    return out.select(
        "question_id", "relevant", share("h1").alias("recall_at_1"), share("h5").alias("recall_at_5"), share(f"h{depth}").alias("recall_at_10"),
        F.when(F.col("relevant") > 0, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr_at_10"),
        F.when(F.col("relevant") > 0, (F.col(f"h{depth}") == F.col("relevant")).cast("double")).alias("set_recall_at_10"),
    )


def retrieval_report(per: DataFrame) -> DataFrame:
    """Macro means over evaluable questions, with the counts of both kinds."""
    names = ["recall_at_1", "recall_at_5", "recall_at_10", "mrr_at_10", "set_recall_at_10"]
    return per.agg(F.count_if(F.col("relevant") > 0).alias("evaluable"), F.count_if(F.col("relevant") == 0).alias("unevaluable"), *[F.avg(n).alias(n) for n in names])


def ndcg(ranking: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """Rows (question_id, ndcg): gain grade / log2(rank + 1) against the ideal order of all graded labels; 0 without gain."""
    gain = F.col("grade") / F.log2(F.col("rank") + F.lit(1.0))
    got = ranking.where(F.col("rank") <= k).join(labels, ["question_id", "chunk_id"]).groupBy("question_id").agg(F.sum(gain).alias("dcg"))
    order = Window.partitionBy("question_id").orderBy(F.col("grade").desc(), "chunk_id")
    ideal = labels.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("question_id").agg(F.sum(gain).alias("idcg"))
    out = ideal.join(got, "question_id", "left")
    return out.select("question_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def containment(ranking: DataFrame, chunks: DataFrame, answers: DataFrame, cutoffs=(1, 5, 10)) -> DataFrame:
    """One row: evaluable answers and the share of questions whose answer stands in a chunk up to each cutoff, case and spaces apart."""
    gold = answers.select("question_id", tx.collapsed(F.col("answer")).alias("answer")).where("answer <> ''")
    shown = ranking.where(F.col("rank") <= max(cutoffs)).join(gold, "question_id").join(chunks.select("chunk_id", tx.collapsed(F.col("text")).alias("text")), "chunk_id")
    first = shown.where(F.contains("text", "answer")).groupBy("question_id").agg(F.min("rank").alias("first"))
    return gold.join(first, "question_id", "left").agg(F.count("*").alias("evaluable"), *[F.avg(F.coalesce((F.col("first") <= c), F.lit(False)).cast("double")).alias(f"containment_at_{c}") for c in cutoffs])


def pair_redundancy(ranking: DataFrame, spans: DataFrame, k: int = 3) -> DataFrame:
    """Rows (question_id, pairs, duplicate_rate, overlap_rate, parent_rate, diversity) over the pairs among the first k.

    spans is (chunk_id, context_id, start, end, path). Rates divide by 1 where there is no pair. Groups have k rows.
    """
    r = ranking.where(F.col("rank") <= k).join(spans, "chunk_id")
    a, b = r.alias("a"), r.alias("b")
    same = F.col("a.context_id") == F.col("b.context_id")
    duplicate = same & (F.col("a.start") == F.col("b.start")) & (F.col("a.end") == F.col("b.end"))
    overlap = same & (F.greatest("a.start", "b.start") < F.least("a.end", "b.end"))
    short, long = F.least(F.size("a.path"), F.size("b.path")), F.col
    parent = same & (F.size("a.path") != F.size("b.path")) & (F.slice(long("a.path"), F.lit(1), short) == F.slice(long("b.path"), F.lit(1), short))
    pairs = a.join(b, (F.col("a.question_id") == F.col("b.question_id")) & (F.col("a.rank") < F.col("b.rank"))).select(F.col("a.question_id").alias("question_id"), duplicate.alias("d"), overlap.alias("o"), parent.alias("p"))
    counts = pairs.groupBy("question_id").agg(F.count("*").alias("pairs"), *[F.count_if(F.col(c)).alias(c) for c in "dop"])
    kinds = r.groupBy("question_id").agg(F.count("*").alias("n"), F.count_distinct("context_id", "path").alias("distinct"))
    out = kinds.join(counts, "question_id", "left").fillna(0, ["pairs", "d", "o", "p"])
    rate = lambda c: F.col(c) / F.greatest(F.col("pairs"), F.lit(1))
    return out.select("question_id", "pairs", rate("d").alias("duplicate_rate"), rate("o").alias("overlap_rate"), rate("p").alias("parent_rate"), (F.col("distinct") / F.col("n")).alias("diversity"))


#: Per-question columns that are correlated with answer scores.
SET_METRICS = [
    "precision_at_1", "precision_at_3", "set_recall_at_3", "ndcg_at_10", "required_coverage_at_1", "required_coverage_at_3", "duplicate_rate", "overlap_rate", "parent_rate", "diversity",
    "coordinate_coverage_at_3", "context_hit_at_1", "context_hit_at_3",
]


def set_metrics(ranking: DataFrame, labels: DataFrame, spans: DataFrame, questions: DataFrame, context_evidence: DataFrame | None = None, failed_answers: DataFrame | None = None, judged_all: bool = False) -> DataFrame:
    """Rows (question_id, relevant, SET_METRICS, evidence_count_at_3, token_cost_at_3, class): graded and set-aware metrics, and one of eight failure classes.

    Grade 2 is required evidence. spans (chunk_id, context_id, path, start, end, cost) of chunks; a question's coordinates and context hits are null
    unless all its relevant chunks are ranked. context_evidence (question_id, chunk_id) names hierarchy context, failed_answers (question_id) wrong
    answers; judged_all tells that labels cover every chunk, so that a relevant one outside the ranking was not discovered.
    Questions without relevant chunks have class UNRESOLVED_LABEL_OR_GOLD and null metrics. A ranking has a chunk once; the order of classes then
    leaves nothing to REDUNDANCY_ERROR, as a relevant chunk outside the first three is a ranking or a coverage miss.
    """
    lab = labels.where(F.col("grade") > 0).groupBy("question_id", "chunk_id").agg(F.max("grade").alias("grade"))
    asked = questions.select("question_id").distinct()
    count = lab.groupBy("question_id").agg(F.count("*").alias("relevant"), F.count_if(F.col("grade") >= 2).alias("required"))
    top = lambda c, k: F.count_if(F.col("rank").isNotNull() & (F.col("rank") <= k) & c)
    yes, need = F.col("grade").isNotNull(), F.coalesce(F.col("grade") >= 2, F.lit(False))
    at = F.when(yes, F.struct("context_id", "path"))
    spans = spans.join(small(ranking.select("chunk_id").distinct()), "chunk_id", "left_semi")  # before costs are computed
    r = ranking.select("question_id", "rank", "chunk_id").join(spans.select("chunk_id", "context_id", "path", "cost"), "chunk_id").join(lab, ["question_id", "chunk_id"], "left")
    seen = r.groupBy("question_id").agg(
        F.count(F.col("grade")).alias("ranked"), *[top(yes, k).alias(f"hit{k}") for k in (1, 3)], *[top(need, k).alias(f"need{k}") for k in (1, 3)], top(F.lit(True), 3).alias("evidence_count_at_3"),
        F.when(F.count_if((F.col("rank") <= 3) & F.col("cost").isNull()) == 0, F.sum(F.when(F.col("rank") <= 3, F.col("cost")))).alias("token_cost_at_3"),
        F.collect_set(at).alias("coordinates"), F.collect_set(F.when(F.col("rank") <= 3, at)).alias("hit_coordinates"),
        F.collect_set(F.when(F.col("rank") <= 1, F.col("context_id"))).alias("contexts1"), F.collect_set(F.when(F.col("rank") <= 3, F.col("context_id"))).alias("contexts3"),
    )
    out = asked.join(count, "question_id", "left").join(seen, "question_id", "left").join(pair_redundancy(ranking, spans), "question_id", "left")
    out = out.join(ndcg(ranking, lab).withColumnRenamed("ndcg", "ndcg_at_10"), "question_id", "left")
    out = out.fillna(0, ["relevant", "required", "ranked", "hit1", "hit3", "need1", "need3", "evidence_count_at_3"])
    if context_evidence is not None:
        named = context_evidence.select("question_id", "chunk_id").distinct().join(ranking.select("question_id", "chunk_id", "rank"), ["question_id", "chunk_id"])
        out = out.join(named.groupBy("question_id").agg((F.min("rank") > 3).alias("context_missed")), "question_id", "left")
    else:
        out = out.withColumn("context_missed", F.lit(False))
    if failed_answers is not None:
        out = out.join(failed_answers.select("question_id").distinct().withColumn("failed", F.lit(True)), "question_id", "left")
    else:
        out = out.withColumn("failed", F.lit(False))
    known = (F.col("relevant") > 0) & (F.col("ranked") == F.col("relevant"))
    positive = F.transform("coordinates", lambda c: c["context_id"])
    redundant = F.coalesce((F.col("duplicate_rate") > 0) | (F.col("overlap_rate") > 0) | (F.col("parent_rate") > 0), F.lit(False))
    some = lambda c: F.when(F.col("relevant") > 0, c)
    part = lambda c: F.when(F.col("required") > 0, F.col(c) / F.greatest(F.col("required"), F.lit(1)))
    kind = (
        F.when(F.col("relevant") == 0, "UNRESOLVED_LABEL_OR_GOLD").when(F.lit(judged_all) & (F.col("ranked") < F.col("relevant")), "DISCOVERY_MISS")
        .when((F.col("hit3") == 0) & (F.col("ranked") > 0), "RANKING_MISS").when((F.col("hit3") > 0) & (F.col("hit3") < F.col("relevant")), "SET_COVERAGE_MISS")
        .when(redundant & (F.col("ranked") > F.col("hit3")), "REDUNDANCY_ERROR").when(F.coalesce("context_missed", F.lit(False)), "HIERARCHY_CONTEXT_MISS")
        .when((F.col("hit3") == F.col("relevant")) & F.coalesce("failed", F.lit(False)), "CORRECT_EVIDENCE_GENERATION_ERROR").otherwise("NO_FAILURE")
    )
    return out.select(
        "question_id", "relevant", some(F.col("hit1").cast("double")).alias("precision_at_1"), some(F.col("hit3") / 3.0).alias("precision_at_3"),
        some((F.col("hit3") == F.col("relevant")).cast("double")).alias("set_recall_at_3"), "ndcg_at_10", part("need1").alias("required_coverage_at_1"), part("need3").alias("required_coverage_at_3"),
        *[some(F.col(c)).alias(c) for c in ("duplicate_rate", "overlap_rate", "parent_rate", "diversity")],
        F.when(known, F.size("hit_coordinates") / F.greatest(F.size("coordinates"), F.lit(1))).alias("coordinate_coverage_at_3"),
        *[F.when(known, F.arrays_overlap(f"contexts{k}", positive).cast("double")).alias(f"context_hit_at_{k}") for k in (1, 3)],
        some(F.col("evidence_count_at_3")).alias("evidence_count_at_3"), some(F.col("token_cost_at_3")).alias("token_cost_at_3"), kind.alias("class"),
    )


def set_report(per: DataFrame) -> DataFrame:
    """One row over set_metrics: counts, means over evaluable questions, optional means over those that have them, distribution of evidence counts, token costs."""
    means = ["precision_at_1", "precision_at_3", "set_recall_at_3", "ndcg_at_10", "coordinate_coverage_at_3", "context_hit_at_1", "context_hit_at_3"]
    cost, some = F.col("token_cost_at_3"), F.col("relevant") > 0
    return per.agg(
        F.count("*").alias("questions"), F.count_if(some).alias("evaluable"), F.count_if(~some).alias("unevaluable"), *[F.avg(m).alias(f"mean_{m}") for m in means],
        F.count("required_coverage_at_3").alias("required_eligible"), F.count("diversity").alias("metadata_available"), F.count("coordinate_coverage_at_3").alias("coordinates_available"),
        *[F.count_if(F.col("evidence_count_at_3") == n).alias(f"evidence_{n}") for n in range(4)], F.count(cost).alias("token_cost_available"), F.count_if(some & cost.isNull()).alias("token_cost_unavailable"),
        F.sum(cost).alias("token_cost_total"), F.avg(cost).alias("token_cost_mean"), F.min(cost).alias("token_cost_minimum"), F.max(cost).alias("token_cost_maximum"),
    )


def failure_overlaps(ranking: DataFrame, labels: DataFrame, questions: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Rows (category, n): counts that may share questions: parser or alias errors, relevant chunks outside the first ten, a first chunk that is not relevant though one of ten is.

    diagnostics (question_id, diagnostic) of exact references; a question without a coordinate is no error.
    """
    lab = labels.where(F.col("grade") > 0).select("question_id", "chunk_id").distinct()
    asked = questions.select("question_id").distinct()
    wrong = diagnostics.where(F.col("diagnostic").isNotNull() & (F.col("diagnostic") != "EXACT_COORDINATE_ABSENT")).select("question_id").distinct().join(asked, "question_id")
    hits = ranking.where(F.col("rank") <= 10).join(lab, ["question_id", "chunk_id"]).groupBy("question_id").agg(F.min("rank").alias("first"), F.count("*").alias("hits"))
    q = asked.join(lab.groupBy("question_id").agg(F.count("*").alias("relevant")), "question_id").join(hits, "question_id", "left")
    counts = q.agg(F.count_if(F.coalesce("hits", F.lit(0)) < F.col("relevant")).alias("m"), F.count_if(F.col("first") > 1).alias("p")).crossJoin(wrong.agg(F.count("*").alias("w")))
    named = [("parser_or_alias_identity_error", "w"), ("missing_top_10_evidence", "m"), ("poor_top_rank_ordering", "p")]
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(c).alias("n")) for k, c in named])).alias("x")).select("x.*")


def pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows (x, y, n, r, reason) for each pair of columns; null r with a reason for fewer than two rows or no variance."""
    parts = []
    for x, y in pairs:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        parts += [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.when(both, F.col(x).cast("double")).alias("a"), F.when(both, F.col(y).cast("double")).alias("b"))]
    long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    s = long.groupBy("x", "y").agg(F.count("a").alias("n"), F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"), F.covar_pop("a", "b").alias("cov"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    reason = F.when(F.col("n") < 2, "INSUFFICIENT_PAIRS").when((F.col("a0") == F.col("a1")) | (F.col("b0") == F.col("b1")), "ZERO_VARIANCE")
    return s.select("x", "y", "n", F.when(reason.isNull(), F.try_divide(F.col("cov"), F.col("sa") * F.col("sb"))).alias("r"), reason.alias("reason"))


def nearest_rank(column: str, percent: int) -> Column:
    """The nearest-rank percentile of an integer column."""
    return F.expr(f"CAST(percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {column}) AS LONG)")


def length_summary(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Minimum, mean, nearest-rank percentiles and maximum of a column, per group."""
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.min(column).alias("minimum"), F.avg(column).alias("mean"), *[nearest_rank(column, p).alias(f"p{p}") for p in (50, 75, 90, 95, 99)], F.max(column).alias("maximum"))


def latency_quantiles(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Linear p50 and p95, and the rate per unit of the summed column."""
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.percentile(column, F.lit(0.5)).alias("p50"), F.percentile(column, F.lit(0.95)).alias("p95"), F.try_divide(F.count(column).cast("double"), F.sum(column)).alias("per_unit"))


def discovery_arm(ranking: DataFrame, labels: DataFrame, cutoffs=(5, 10, 20, 50)) -> DataFrame:
    """Rows (question_id, first, hit_at_*, set_at_*, rr) for labelled questions."""
    lab = labels.select("question_id", "chunk_id").distinct()
    counts = lab.groupBy("question_id").agg(F.count("*").alias("positives"))
    hits = ranking.where(F.col("rank") <= max(cutoffs)).join(lab, ["question_id", "chunk_id"]).groupBy("question_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= c).alias(f"n{c}") for c in cutoffs])
    q = counts.join(hits, "question_id", "left").fillna(0, [f"n{c}" for c in cutoffs])
    return q.select("question_id", "first", *[(F.col(f"n{c}") > 0).cast("double").alias(f"hit_at_{c}") for c in cutoffs], *[(F.col(f"n{c}") == F.col("positives")).cast("double").alias(f"set_at_{c}") for c in cutoffs], F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def compare_arms(base: DataFrame, arm: DataFrame) -> DataFrame:
    """One row: deltas of mean hits and reciprocal rank, questions won and lost at the last cutoff, and whether nothing regresses."""
    b = base.select("question_id", F.col("hit_at_10").alias("b10"), F.col("hit_at_50").alias("b50"), F.col("rr").alias("brr"))
    both = b.join(arm.select("question_id", "hit_at_10", "hit_at_50", "rr"), "question_id")
    out = both.agg(
        F.count("*").alias("questions"), (F.avg("hit_at_10") - F.avg("b10")).alias("delta_hit_10"), (F.avg("hit_at_50") - F.avg("b50")).alias("delta_hit_50"), (F.avg("rr") - F.avg("brr")).alias("delta_mrr"),
        F.count_if((F.col("hit_at_50") > 0) & (F.col("b50") == 0)).alias("novel"), F.count_if((F.col("hit_at_50") == 0) & (F.col("b50") > 0)).alias("lost"),
    )
    return out.withColumn("non_regressing", (F.col("delta_hit_10") >= 0) & (F.col("delta_hit_50") >= 0) & (F.col("delta_mrr") >= 0))


def win_tie_loss(pairs: DataFrame, base: str, new: str, margin: float = 0.0) -> DataFrame:
    d = F.col(new) - F.col(base)
    return pairs.agg(F.count_if(d > margin).alias("wins"), F.count_if(F.abs(d) <= margin).alias("ties"), F.count_if(d < -margin).alias("losses"), F.avg(d).alias("mean_delta"))


def rates(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with the share of each value."""
    return df.agg(F.count("*").alias("n"), *[F.avg((F.col(column) == v).cast("double")).alias(f"rate_{v}") for v in values])


def containment_join(haystack: DataFrame, needles: DataFrame, postings: blockmax.Postings | None = None) -> DataFrame:
    """Rows (needle_id, chunk_id) where a needle's token sequence stands in a text: its rarest token fetches texts, then the run is checked.

    haystack (chunk_id, text), needles (needle_id, text). Needles without tokens fit nothing. The terms of needles in each text are written once; of the texts
    only those that a rarest token fetches are read again. With postings of the haystack that serve the needles' terms no text is read but those: the index has the rest.
    """
    wrap = lambda t: F.concat(F.lit("\u0001"), F.array_join(t, "\u0001"), F.lit("\u0001"))
    n = needles.select("needle_id", tx.terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    asked = n.select("needle_id", F.explode(F.array_distinct("t")).alias("term"))
    if postings is None:
        terms = haystack.select("chunk_id", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("term"))
        post = written(terms.join(small(asked.select("term").distinct()), "term", "left_semi").select("chunk_id", "term"), "needle-terms")
        df = post.groupBy("term").agg(F.count("*").alias("df"))
    else:
        df = blockmax.frequencies(postings)
    anchor = asked.join(df, "term", "left").fillna(0, ["df"]).groupBy("needle_id").agg(F.min(F.struct("df", "term")).alias("a")).where("a.df > 0").select("needle_id", F.col("a.term").alias("term"))
    anchor = written(anchor, "needle-anchors")
    if postings is not None:
        rarest = [r["term"] for r in anchor.select("term").distinct().limit(blockmax.SLICE + 1).collect()]
        if len(rarest) > blockmax.SLICE:
            return containment_join(haystack, needles)
        post = blockmax.holders(postings, sorted(rarest))
    cand = written(small(anchor).join(post, "term").select("needle_id", "chunk_id"), "needle-fetched")
    hay = haystack.join(small(cand.select("chunk_id").distinct()), "chunk_id", "left_semi").select("chunk_id", wrap(tx.terms(F.col("text"))).alias("hay"))
    full = cand.join(n.select("needle_id", wrap(F.col("t")).alias("needle")), "needle_id").join(hay, "chunk_id")
    return full.where(F.contains("hay", "needle")).select("needle_id", "chunk_id")
