"""Queries over the driver's tables for retrieval, fusion, metrics and selection, each with its SQL counterpart.

`documents` stand for chunks, `benchmark` texts for questions. A document is relevant to a question whose token run it
holds, with grade 2 where `labels` call its quality good, else 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import queries_corpus
from corpusloom.functions import text as tx
from corpusloom.operators import blockmax, boost, corpus, dense, fuse, index, metrics, retrieve, rouge, select, split
from corpusloom.plans.materialize import fresh_path, written

DEPTH = 50


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.array("source", "lang").alias("path"), F.col("source").alias("context_id"), F.lit(0).alias("start"), F.length("text").alias("end"))


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"))


def sparse(spark, d, k=DEPTH, index=None):
    return written(retrieve.bm25(index or chunks(spark, d), questions(spark, d), k), "bm25")


def second(spark, d, k=DEPTH, index=None):
    return written(retrieve.lexical(index or chunks(spark, d), questions(spark, d), k), "lexical")


def rankings(spark, d):
    """Both rankings over one index."""
    index = blockmax.build(chunks(spark, d), questions(spark, d))
    return sparse(spark, d, index=index), second(spark, d, index=index)


def labels(spark, d):
    found = metrics.containment_join(chunks(spark, d).select("chunk_id", "text"), questions(spark, d).select(F.col("question_id").alias("needle_id"), F.col("question").alias("text")))
    good = table(spark, d, "labels").groupBy(F.col("doc_id").cast("string").alias("chunk_id")).agg(F.max("quality").alias("q"))
    return written(found.join(good, "chunk_id", "left").select(F.col("needle_id").alias("question_id"), "chunk_id", (1 + F.coalesce("q", F.lit(0))).cast("int").alias("grade")), "labels")


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def bm25_topk(spark, d):
    return r6(retrieve.bm25(chunks(spark, d), questions(spark, d)), "score")


def legal_sparse(spark, d):
    return r6(retrieve.legal_sparse(sparse(spark, d).select("question_id", "chunk_id", "score"), chunks(spark, d), questions(spark, d), 12), "score")


def lexical_topk(spark, d):
    return r6(retrieve.lexical(chunks(spark, d), questions(spark, d), 12), "score")


def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("question_id"), "embedding")
    return r6(retrieve.cosine(e.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding"), asked, 10), "score")


def _store(spark, d):
    """The vectors as a half-precision store whose build stops after a wave and is resumed, and what asks for them."""
    e = table(spark, d, "embeddings")
    vectors, path, identity = e.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding"), fresh_path(spark, "dense"), {"model": "given vectors"}
    if dense.build_store(vectors, path, identity, parts=8, wave=3, most_waves=1) != "INCOMPLETE" or dense.build_store(vectors, path, identity, parts=8, wave=3) != "COMPLETE":
        raise RuntimeError("a build of three waves does not stop after its first and end when resumed")
    return dense.open_store(spark, path, identity), vectors, e.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("question_id"), "embedding")


def dense_store_topk(spark, d):
    stored, vectors, asked = _store(spark, d)
    return r6(dense.search(stored, asked, 10, exact=vectors), "score")


def dense_drift(spark, d):
    stored, vectors, asked = _store(spark, d)
    bound = stored.agg(F.max("error")).first()[0] or 0.0
    return dense.drift(dense.search(stored, asked, 10), dense.cosine(vectors, asked, 10), bound).select("questions", "rows", "within")


def vector_audit(spark, d):
    """The vectors as a store would hold them after a bad run: a seventh is missing, an eleventh twice, others not normalised, zero or not finite."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    store = retrieve.normalized_vectors(e).where("vec_id % 7 <> 0")
    spoiled = F.when(F.col("vec_id") % 13 == 0, F.transform("embedding", lambda x: x * 2)).when(F.col("vec_id") % 17 == 0, F.transform("embedding", lambda x: x * 0))
    spoiled = spoiled.when(F.col("vec_id") % 19 == 0, F.transform("embedding", lambda x: x + float("inf"))).otherwise(F.col("embedding"))
    store = store.withColumn("embedding", spoiled)
    return retrieve.audit_vectors(store.unionByName(store.where("vec_id % 11 = 0")).select("chunk_id", "embedding"), e.select("chunk_id"))


def persisted(spark, d):
    """The documents' index, written and opened again."""
    path = fresh_path(spark, "persisted")
    nothing = F.lit(None).cast("string")
    found = chunks(spark, d).select("chunk_id", "context_id", F.col("path").alias("hierarchy_path"), nothing.alias("hierarchy_kind"), nothing.alias("hierarchy_ordinal"), "text")
    index.build_index(found, path)
    return index.open_index(spark, path), index.open_postings(spark, path)


def question_retrieval(spark, d):
    """Parsed, resolved and searched over an opened index; documents are chunks without headings."""
    aliases = queries_corpus._aliases(queries_corpus._passages(spark, d))
    opened, postings = persisted(spark, d)
    ranking, _ = index.retrieve_questions(opened, questions(spark, d), aliases, postings=postings)
    return r6(ranking, "score")


def context_chunks(spark, d):
    """What an opened index has of each source, found by its context."""
    return persisted(spark, d)[0].groupBy("context_id").agg(F.count("*").alias("chunks"), F.sum("dl").alias("terms"), F.min("chunk_id").alias("first"), F.max("dl").alias("longest"))


def rrf_fusion(spark, d):
    return r6(fuse.reciprocal_rank_fusion([*rankings(spark, d)]), "score", digits=9)


def union_rank(spark, d):
    return r6(fuse.union_rank(labels(spark, d), sparse(spark, d).select("question_id", "chunk_id", "score")), "score")


def sparse_dense_diagnosis(spark, d):
    return fuse.diagnose(*rankings(spark, d), labels(spark, d))


def union_coverage(spark, d):
    return r6(fuse.union_coverage([*rankings(spark, d)], labels(spark, d)), "recall", "set_recall", "assignment_recall", "mean_pool")


def ranking_parity(spark, d):
    return fuse.parity(sparse(spark, d), retrieve.ranked(retrieve.bm25_scores(chunks(spark, d), questions(spark, d)), DEPTH), 1e-9).select("rows", "same_order", "equal")


def per_question_metrics(spark, d):
    return r6(metrics.per_question(sparse(spark, d), labels(spark, d), questions(spark, d)), "recall_at_1", "recall_at_5", "recall_at_10", "mrr_at_10", "set_recall_at_10")


def recall_mrr(spark, d):
    return r6(metrics.retrieval_report(metrics.per_question(sparse(spark, d), labels(spark, d), questions(spark, d))), "recall_at_1", "recall_at_5", "recall_at_10", "mrr_at_10", "set_recall_at_10")


def ndcg10(spark, d):
    return r6(metrics.ndcg(sparse(spark, d), labels(spark, d)), "ndcg")


def answer_containment(spark, d):
    return r6(metrics.containment(sparse(spark, d), chunks(spark, d), questions(spark, d).withColumnRenamed("question", "answer")), "containment_at_1", "containment_at_5", "containment_at_10")


def pair_redundancy(spark, d):
    return r6(metrics.pair_redundancy(sparse(spark, d), chunks(spark, d).select("chunk_id", "context_id", "start", "end", "path")), "duplicate_rate", "overlap_rate", "parent_rate", "diversity")


def failure_class(spark, d):
    return set_metrics(spark, d).select("question_id", "class")


def failure_counts(spark, d):
    return failure_class(spark, d).groupBy("class").agg(F.count("*").alias("n"))


def pearson_metrics(spark, d):
    per = metrics.per_question(sparse(spark, d), labels(spark, d), questions(spark, d)).join(questions(spark, d).select("question_id", tx.word_count(F.col("question")).alias("words")), "question_id")
    return r6(metrics.pearson(per, [("words", "mrr_at_10"), ("words", "recall_at_1"), ("relevant", "recall_at_10")]), "r")


def set_metrics(spark, d):
    """Labels are judged over all documents; the tables name no hierarchy context and no failed answers."""
    spans = chunks(spark, d).select("chunk_id", "context_id", "path", "start", "end", F.size(tx.tokens(F.col("text"))).alias("cost"))
    return metrics.set_metrics(sparse(spark, d), labels(spark, d), spans, questions(spark, d), judged_all=True)


def set_failure_counts(spark, d):
    return failure_counts(spark, d)


def set_report(spark, d):
    return metrics.set_report(set_metrics(spark, d))


def set_correlations(spark, d):
    """Each set metric with the scores of an answer taken from the first document; the benchmark text is its reference."""
    first = sparse(spark, d, 1).join(chunks(spark, d).select("chunk_id", "text"), "chunk_id").join(questions(spark, d), "question_id")
    scores = rouge.answer_scores(first.select(F.col("question_id").alias("id"), F.col("question").alias("reference"), corpus.extractive_answer(F.col("text")).alias("prediction")))
    both = set_metrics(spark, d).where("relevant > 0").join(scores.withColumnRenamed("id", "question_id"), "question_id")
    return r6(metrics.pearson(both, [(m, a) for m in metrics.SET_METRICS for a in ("meteor_exact", "rouge_l")]), "r")


def failure_overlaps(spark, d):
    diagnostics = queries_corpus.question_resolution(spark, d).select("question_id", "diagnostic")
    return metrics.failure_overlaps(sparse(spark, d), labels(spark, d), questions(spark, d), diagnostics)


def arm_comparison(spark, d):
    lab = labels(spark, d)
    return r6(metrics.compare_arms(*(metrics.discovery_arm(r, lab) for r in rankings(spark, d))), "delta_hit_10", "delta_hit_50", "delta_mrr")


def discovery_arm(spark, d):
    return r6(metrics.discovery_arm(sparse(spark, d), labels(spark, d)), "rr")


def win_tie_loss(spark, d):
    lab = labels(spark, d)
    a, b = (metrics.discovery_arm(r, lab).select("question_id", F.col("rr").alias(n)) for r, n in zip(rankings(spark, d), ("base", "new")))
    return r6(metrics.win_tie_loss(a.join(b, "question_id"), "base", "new"), "mean_delta")


def bootstrap_ci(spark, d):
    lab = labels(spark, d)
    a, b = (metrics.discovery_arm(r, lab).select(F.col("question_id").alias("id"), F.col("rr").alias(n)) for r, n in zip(rankings(spark, d), ("base", "new")))
    return rouge.bootstrap(a.join(b, "id"), "paired")


def ltr_features(spark, d):
    return r6(fuse.ltr_features(*rankings(spark, d), questions(spark, d), chunks(spark, d), labels(spark, d)), "bm25_score", "dense_score", "lexical_overlap", "legal_term_overlap")


def fusion_features(spark, d):
    """All 16 features over the chunks of documents, whose paths have the legal coordinates; both rankings are of these chunks."""
    passages = queries_corpus._passages(spark, d)
    c = written(corpus.chunked(passages).select("chunk_id", "context_id", "path", F.col("kind").alias("hierarchy_kind"), F.col("ordinal").alias("hierarchy_ordinal"), F.col("retrieval_text").alias("text")), "fusion-chunks")
    q = questions(spark, d)
    index = blockmax.build(c, q)
    s, l = written(retrieve.bm25(index, q, DEPTH), "fusion-bm25"), written(retrieve.lexical(index, q, DEPTH), "fusion-lexical")
    found = metrics.containment_join(c.select("chunk_id", "text"), q.select(F.col("question_id").alias("needle_id"), F.col("question").alias("text")), index)
    exact = queries_corpus._resolved(q, passages, c.withColumn("hierarchy_path", F.col("path")))
    # features name documents of candidates alone; written, so that no filter on what is parsed of a name goes below the join
    ids = s.select("chunk_id").unionByName(l.select("chunk_id")).distinct()
    places = c.select("chunk_id", "context_id").join(retrieve.small(ids), "chunk_id", "left_semi").select("context_id").distinct()
    near = written(passages.join(retrieve.small(places), "context_id", "left_semi").select("context_id", "name", F.substring("passage", 1, 256).alias("passage")), "fusion-near")
    out = fuse.fusion_features(s, l, q, c, found.withColumnRenamed("needle_id", "question_id"), exact, queries_corpus._aliases(near), queries_corpus._laws(near))
    return r6(out, "bm25_score", "dense_score", "lexical_overlap", "legal_term_overlap")


def _learned(spark, d):
    """Of the candidates with all features: a learned ranking of the validation questions, fitted on the others, and the fixed fusion of both rankings for the same questions."""
    rows = written(fusion_features(spark, d), "learned-rows")
    parts = split.group_split(rows.select(F.col("question_id").alias("id")).distinct(), "learned.v1").withColumnRenamed("id", "question_id")
    rows = rows.join(parts, "question_id")
    features = [c for c in rows.columns if c not in ("question_id", "chunk_id", "label", "partition")]
    model = boost.fit(rows.where("partition = 'fit'"), features)
    held = rows.where("partition = 'validation'")
    fixed = [held.select("question_id", "chunk_id", F.col(c).alias("rank")).where(F.col("rank") <= DEPTH) for c in ("bm25_rank", "dense_rank")]
    return boost.predict(model, held, DEPTH), fuse.reciprocal_rank_fusion(fixed), held.where("label > 0").select("question_id", "chunk_id")


def learned_ranking(spark, d):
    return r6(_learned(spark, d)[0], "score")


def learned_gate(spark, d):
    """The held-out comparison of the learned ranking with the fixed fusion, and whether it may stand."""
    learned, fixed, positive = _learned(spark, d)
    a, b = (metrics.discovery_arm(r, positive).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("hit_at_10", "hit_at_50", "set_at_50", "rr")], F.count("*").alias("n")).first() for r in (learned, fixed))
    deltas = {"recall_at_10": a[0] - b[0], "recall_at_50": a[1] - b[1], "set_recall_at_50": a[2] - b[2], "mrr_at_50": a[3] - b[3]}
    row = [(a["n"], *[round(x, 6) for x in deltas.values()], boost.gate(deltas))]
    return spark.createDataFrame(row, "questions long, " + ", ".join(f"{k} double" for k in deltas) + ", passes boolean")


def _pool(spark, d):
    c = chunks(spark, d).select("chunk_id", "context_id", "path", "start", "end", tx.word_count(F.col("text")).alias("cost"))
    return sparse(spark, d, 20).join(c, "chunk_id").withColumnRenamed("chunk_id", "evidence_id")


def admission_budget(spark, d):
    return select.admit_within_budget(_pool(spark, d).withColumn("valid", F.lit(True)), 1000)


def bounded_oracle(spark, d):
    return select.bounded_oracle(_pool(spark, d).withColumn("valid", F.lit(True)), labels(spark, d), 1500)


def evidence_select(spark, d):
    return select.select_evidence(_pool(spark, d).withColumns({"status": F.lit("valid"), "role": F.lit("ranked"), "admits": F.lit(False)}), 1500)


def packing_calibration(spark, d):
    marked = sparse(spark, d).join(labels(spark, d).select("question_id", "chunk_id", F.lit(True).alias("positive")), ["question_id", "chunk_id"], "left").fillna(False, ["positive"])
    return r6(select.calibrate_threshold(marked), "threshold", "precision", "recall", "f1")


def packing_threshold(spark, d):
    return r6(select.best_threshold(packing_calibration(spark, d)), "threshold", "f1")


def evidence_mining(spark, d):
    q = questions(spark, d).select("question_id", F.array_distinct(tx.terms(F.col("question"))).alias("qt"))
    c = chunks(spark, d).select("chunk_id", F.array_distinct(tx.terms(F.col("text"))).alias("ct"))
    pool = sparse(spark, d, 20).join(q, "question_id").join(c, "chunk_id").withColumn("covered", F.array_intersect("qt", "ct"))
    pool = pool.withColumn("coverage", F.size("covered") / F.greatest(F.size("qt"), F.lit(1))).withColumn("support", F.col("coverage"))
    return select.mine_by_coverage(pool.withColumnRenamed("chunk_id", "evidence_id"), 0.2)


def answer_coverage(spark, d):
    q = questions(spark, d).select("question_id", F.array_distinct(tx.terms(F.col("question"))).alias("qt"))
    c = chunks(spark, d).select("chunk_id", F.array_distinct(tx.terms(F.col("text"))).alias("ct"))
    j = sparse(spark, d, 3).join(q, "question_id").join(c, "chunk_id")
    return j.select("question_id", "chunk_id", F.round(F.size(F.array_intersect("qt", "ct")) / F.size("qt"), 6).alias("coverage"))


QUERIES = {f.__name__: f for f in (
    bm25_topk, legal_sparse, lexical_topk, cosine_topk, dense_store_topk, dense_drift, vector_audit, rrf_fusion, union_rank, sparse_dense_diagnosis, union_coverage, ranking_parity, per_question_metrics, recall_mrr,
    ndcg10, answer_containment, pair_redundancy, failure_class, failure_counts, pearson_metrics, arm_comparison, discovery_arm, win_tie_loss, bootstrap_ci, ltr_features, admission_budget,
    bounded_oracle, evidence_select, packing_calibration, packing_threshold, evidence_mining, answer_coverage, set_metrics, set_failure_counts, set_report, set_correlations, failure_overlaps,
    fusion_features, learned_ranking, learned_gate, question_retrieval, context_chunks,
)}

# ---- SQL counterparts ----

_TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{M}}\p{{N}}]+|[\p{{P}}\p{{S}}]')"
_BASE = f"""WITH RECURSIVE q AS (SELECT CAST(item_id AS VARCHAR) AS question_id, text AS question, {_TOK.format('text')} AS qtoks FROM benchmark),
c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text, source, lang, {_TOK.format('text')} AS toks FROM documents),
qt AS (SELECT DISTINCT question_id, unnest(qtoks) AS term FROM q),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(toks)) AS avgdl FROM c),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM c) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
s AS (SELECT question_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN df USING (term) JOIN tf USING (term), st GROUP BY ALL),
bm AS (SELECT * FROM (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM s) WHERE rank <= {DEPTH}),
js AS (SELECT question_id, chunk_id, CAST(count(*) AS DOUBLE) / (len(list_distinct(toks)) + len(list_distinct(qtoks)) - count(*)) AS score FROM qt JOIN (SELECT chunk_id, toks, unnest(list_distinct(toks)) AS term FROM c) USING (term) JOIN q USING (question_id) GROUP BY question_id, chunk_id, toks, qtoks),
lx AS (SELECT * FROM (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM js) WHERE rank <= {DEPTH}),
lab AS (SELECT question_id, chunk_id, 1 + coalesce((SELECT max(quality) FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = c.chunk_id), 0) AS grade FROM q, c
  WHERE len(qtoks) > 0 AND contains(chr(1) || array_to_string(toks, chr(1)) || chr(1), chr(1) || array_to_string(qtoks, chr(1)) || chr(1))),
pos AS (SELECT question_id, count(*) AS relevant FROM lab GROUP BY 1),
hit AS (SELECT question_id, min(rank) AS first, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) FILTER (rank <= 10) AS f10 FROM bm JOIN lab USING (question_id, chunk_id) GROUP BY 1),
per AS (SELECT q.question_id, coalesce(relevant, 0) AS relevant, CASE WHEN relevant > 0 THEN coalesce(h1, 0) / relevant END AS recall_at_1, CASE WHEN relevant > 0 THEN coalesce(h5, 0) / relevant END AS recall_at_5,
  CASE WHEN relevant > 0 THEN coalesce(h10, 0) / relevant END AS recall_at_10, CASE WHEN relevant > 0 THEN coalesce(1.0 / f10, 0.0) END AS mrr_at_10, CASE WHEN relevant > 0 THEN CAST(coalesce(h10, 0) = relevant AS DOUBLE) END AS set_recall_at_10
  FROM q LEFT JOIN pos USING (question_id) LEFT JOIN hit USING (question_id)),
arm AS (SELECT a.arm, pos.question_id, min(rank) AS first, count(rank) FILTER (rank <= 5) AS n5, count(rank) FILTER (rank <= 10) AS n10, count(rank) FILTER (rank <= 20) AS n20, count(rank) FILTER (rank <= 50) AS n50, any_value(relevant) AS positives
  FROM pos CROSS JOIN (VALUES ('bm'), ('lx')) a(arm) LEFT JOIN (SELECT 'bm' AS arm, bm.question_id, rank FROM bm JOIN lab USING (question_id, chunk_id) UNION ALL SELECT 'lx', lx.question_id, rank FROM lx JOIN lab USING (question_id, chunk_id)) h ON h.arm = a.arm AND h.question_id = pos.question_id GROUP BY ALL),
pool AS (SELECT question_id, rank, chunk_id AS evidence_id, score, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS cost, source, lang, length(text) AS clen FROM bm JOIN c USING (chunk_id) WHERE rank <= 20)
"""
_DCG = "grade / log2(rank + 1.0)"


def _admit(source: str, budget: int, limit: int | None) -> str:
    more = f" AND a.n < {limit}" if limit else ""
    why = f"WHEN a.n >= {limit} THEN 'COUNT_LIMIT' " if limit else ""
    return f""", src AS ({source}), num AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS k FROM src),
    a(question_id, k, evidence_id, rank, n, total, ok, reason) AS (
      SELECT question_id, 0, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), 0, CAST(0 AS BIGINT), false, CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT question_id FROM num)
      UNION ALL
      SELECT x.question_id, a.k + 1, x.evidence_id, x.rank, a.n + CAST((a.total + x.cost <= {budget}{more}) AS INT), a.total + CASE WHEN a.total + x.cost <= {budget}{more} THEN x.cost ELSE 0 END, a.total + x.cost <= {budget}{more},
        CASE {why}WHEN a.total + x.cost > {budget} THEN 'TOKEN_BUDGET' END
      FROM a JOIN num x ON x.question_id = a.question_id AND x.k = a.k + 1)
    SELECT question_id, evidence_id, rank, ok AS admitted, CAST(CASE WHEN ok THEN n END AS BIGINT) AS admitted_rank, total, reason FROM a WHERE k > 0"""


_CAL = """, mk AS (SELECT question_id, round(CASE WHEN first_value(score) OVER w > 0 THEN score / first_value(score) OVER w ELSE 0.0 END, 9) AS ratio, CAST((question_id, chunk_id) IN (SELECT (question_id, chunk_id) FROM lab) AS INT) AS p FROM bm WINDOW w AS (PARTITION BY question_id ORDER BY rank)),
    th AS (SELECT DISTINCT ratio FROM mk UNION SELECT 0.0 UNION SELECT 1.0), tot AS (SELECT sum(p) AS positives FROM mk),
    cal AS (SELECT th.ratio AS threshold, CAST(coalesce(sum(p), 0) AS BIGINT) AS tp, count(p) AS selected, any_value(positives) AS positives FROM th LEFT JOIN mk ON mk.ratio >= th.ratio CROSS JOIN tot GROUP BY th.ratio),
    calr AS (SELECT round(threshold, 6) AS threshold, tp, selected, round(coalesce(tp / nullif(selected, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(positives, 0), 0.0), 6) AS recall, round(CASE WHEN selected + positives > 0 THEN 2 * tp / (selected + positives) ELSE 0.0 END, 6) AS f1 FROM cal)"""

# labels cover every document, so a relevant one that is not ranked was not discovered; with that, no question is left to the later classes
_CLASS = """, m3 AS (SELECT question_id, count(*) AS ranked, count(*) FILTER (rank <= 3) AS h3 FROM bm JOIN lab USING (question_id, chunk_id) GROUP BY 1),
    fc AS (SELECT q.question_id, CASE WHEN coalesce(relevant, 0) = 0 THEN 'UNRESOLVED_LABEL_OR_GOLD' WHEN coalesce(ranked, 0) < relevant THEN 'DISCOVERY_MISS' WHEN h3 = 0 THEN 'RANKING_MISS'
      WHEN h3 < relevant THEN 'SET_COVERAGE_MISS' ELSE 'NO_FAILURE' END AS class FROM q LEFT JOIN pos USING (question_id) LEFT JOIN m3 USING (question_id))"""

ORACLES = {
    # no benchmark text has a coordinate, so a citation resolves nothing here; tests have those that do
    "question_retrieval": _BASE + "SELECT question_id, rank, chunk_id, false AS exact, round(score, 6) AS score FROM bm WHERE rank <= 12",
    "context_chunks": f"SELECT source AS context_id, count(*) AS chunks, CAST(sum(len(t)) AS BIGINT) AS terms, min(id) AS first, max(len(t)) AS longest FROM (SELECT source, CAST(doc_id AS VARCHAR) AS id, {_TOK.format('text')} AS t FROM documents) GROUP BY source",
    "bm25_topk": _BASE + "SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM bm WHERE rank <= 12",
    "legal_sparse": _BASE + f""", sh AS (SELECT bm.question_id, bm.chunk_id, 0.75 * score / max(score) OVER (PARTITION BY bm.question_id) + 0.25 * len(list_intersect(list_distinct(qtoks), {_TOK.format("source || ' ' || lang")})) / len(list_distinct(qtoks)) AS score FROM bm JOIN q USING (question_id) JOIN c USING (chunk_id))
      SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM sh) WHERE rank <= 12""",
    "lexical_topk": _BASE + "SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM lx WHERE rank <= 12",
    "cosine_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      s AS (SELECT CAST(a.vec_id AS VARCHAR) AS question_id, CAST(b.vec_id AS VARCHAR) AS chunk_id, list_cosine_similarity(a.v, b.v) AS score FROM e a, e b WHERE a.vec_id % 50 = 0)
      SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""",
    "vector_audit": """WITH e AS (SELECT vec_id, 1 + CAST(vec_id % 11 = 0 AS INT) AS times FROM embeddings WHERE vec_id % 7 <> 0),
      k AS (SELECT *, vec_id % 13 = 0 AS longer, vec_id % 13 <> 0 AND vec_id % 17 = 0 AS none, vec_id % 13 <> 0 AND vec_id % 17 <> 0 AND vec_id % 19 = 0 AS wild FROM e)
      SELECT CAST(sum(times) AS BIGINT) AS rows, CAST(sum(times) - count(*) AS BIGINT) AS duplicate_ids, CAST(sum(times) FILTER (wild) AS BIGINT) AS non_finite, CAST(sum(times) FILTER (none) AS BIGINT) AS zero,
        CAST(sum(times) FILTER (longer OR none OR wild) AS BIGINT) AS non_unit, (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0) AS missing, CAST(0 AS BIGINT) AS extra FROM k""",
    "rrf_fusion": _BASE + ", f AS (SELECT question_id, chunk_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT question_id, chunk_id, rank FROM bm UNION ALL SELECT question_id, chunk_id, rank FROM lx) GROUP BY ALL) SELECT question_id, rank, chunk_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM f) WHERE rank <= 50",
    "union_rank": _BASE + ", u AS (SELECT question_id, chunk_id, bool_or(exact) AS exact, max(score) AS score FROM (SELECT question_id, chunk_id, true AS exact, NULL AS score FROM lab UNION ALL SELECT question_id, chunk_id, false, score FROM bm) GROUP BY ALL) SELECT question_id, rank, chunk_id, exact, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY exact DESC, round(score, 6) DESC NULLS LAST, chunk_id) AS rank FROM u) WHERE rank <= 12",
    "sparse_dense_diagnosis": _BASE + "SELECT b.question_id, b.first AS sparse_rank, l.first AS dense_rank, CASE WHEN b.first IS NOT NULL AND l.first IS NOT NULL THEN 'BOTH' WHEN b.first IS NOT NULL THEN 'SPARSE_ONLY' WHEN l.first IS NOT NULL THEN 'DENSE_ONLY' ELSE 'NEITHER' END AS outcome, l.first - b.first AS rank_delta FROM arm b JOIN arm l USING (question_id) WHERE b.arm = 'bm' AND l.arm = 'lx'",
    "union_coverage": _BASE + """, best AS (SELECT question_id, chunk_id, min(rank) AS rank FROM (SELECT question_id, chunk_id, rank FROM bm UNION ALL SELECT question_id, chunk_id, rank FROM lx) GROUP BY ALL),
      g AS (SELECT pos.question_id, cutoff, relevant, count(best.chunk_id) AS pool, count(lab.chunk_id) AS hits FROM pos CROSS JOIN (VALUES (5), (10), (20), (50)) v(cutoff) LEFT JOIN best ON best.question_id = pos.question_id AND best.rank <= cutoff LEFT JOIN lab ON lab.question_id = best.question_id AND lab.chunk_id = best.chunk_id GROUP BY ALL)
      SELECT CAST(cutoff AS BIGINT) AS cutoff, round(avg(CAST(hits > 0 AS DOUBLE)), 6) AS recall, round(avg(CAST(hits = relevant AS DOUBLE)), 6) AS set_recall, round(sum(hits) / sum(relevant), 6) AS assignment_recall, round(avg(pool), 6) AS mean_pool FROM g GROUP BY cutoff""",
    "ranking_parity": _BASE + "SELECT count(*) AS rows, true AS same_order, true AS equal FROM bm",
    "per_question_metrics": _BASE + "SELECT question_id, relevant, round(recall_at_1, 6) AS recall_at_1, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, round(CAST(mrr_at_10 AS DOUBLE), 6) AS mrr_at_10, set_recall_at_10 FROM per",
    "recall_mrr": _BASE + "SELECT count(*) FILTER (relevant > 0) AS evaluable, count(*) FILTER (relevant = 0) AS unevaluable, round(avg(recall_at_1), 6) AS recall_at_1, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(CAST(mrr_at_10 AS DOUBLE)), 6) AS mrr_at_10, round(avg(set_recall_at_10), 6) AS set_recall_at_10 FROM per",
    "ndcg10": _BASE + f", g AS (SELECT question_id, sum({_DCG}) AS dcg FROM bm JOIN lab USING (question_id, chunk_id) WHERE rank <= 10 GROUP BY 1), i AS (SELECT question_id, sum({_DCG}) AS idcg FROM (SELECT question_id, grade, row_number() OVER (PARTITION BY question_id ORDER BY grade DESC, chunk_id) AS rank FROM lab) WHERE rank <= 10 GROUP BY 1) SELECT question_id, round(coalesce(dcg, 0.0) / idcg, 6) AS ndcg FROM i LEFT JOIN g USING (question_id)",
    "answer_containment": _BASE + r""", n AS (SELECT question_id, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) AS answer FROM q), f AS (SELECT bm.question_id, min(rank) AS first FROM bm JOIN n USING (question_id) JOIN c USING (chunk_id) WHERE rank <= 10 AND contains(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), answer) GROUP BY 1)
      SELECT count(*) AS evaluable, round(avg(CAST(coalesce(first <= 1, false) AS DOUBLE)), 6) AS containment_at_1, round(avg(CAST(coalesce(first <= 5, false) AS DOUBLE)), 6) AS containment_at_5, round(avg(CAST(coalesce(first <= 10, false) AS DOUBLE)), 6) AS containment_at_10 FROM n LEFT JOIN f USING (question_id) WHERE answer <> ''""",
    "pair_redundancy": _BASE + """, r AS (SELECT question_id, rank, source, lang, length(text) AS e FROM bm JOIN c USING (chunk_id) WHERE rank <= 3),
      p AS (SELECT a.question_id, count(*) AS pairs, count(*) FILTER (a.source = b.source AND a.e = b.e) AS d, count(*) FILTER (a.source = b.source AND least(a.e, b.e) > 0) AS o FROM r a JOIN r b ON a.question_id = b.question_id AND a.rank < b.rank GROUP BY 1),
      k AS (SELECT question_id, count(*) AS n, count(DISTINCT (source, lang)) AS k FROM r GROUP BY 1)
      SELECT question_id, coalesce(pairs, 0) AS pairs, round(coalesce(d, 0) / greatest(coalesce(pairs, 0), 1), 6) AS duplicate_rate, round(coalesce(o, 0) / greatest(coalesce(pairs, 0), 1), 6) AS overlap_rate, 0.0::DOUBLE AS parent_rate, round(k / n, 6) AS diversity FROM k LEFT JOIN p USING (question_id)""",
    "discovery_arm": _BASE + "SELECT question_id, first, CAST(n5 > 0 AS DOUBLE) AS hit_at_5, CAST(n10 > 0 AS DOUBLE) AS hit_at_10, CAST(n20 > 0 AS DOUBLE) AS hit_at_20, CAST(n50 > 0 AS DOUBLE) AS hit_at_50, CAST(n5 = positives AS DOUBLE) AS set_at_5, CAST(n10 = positives AS DOUBLE) AS set_at_10, CAST(n20 = positives AS DOUBLE) AS set_at_20, CAST(n50 = positives AS DOUBLE) AS set_at_50, round(CAST(coalesce(1.0 / first, 0.0) AS DOUBLE), 6) AS rr FROM arm WHERE arm = 'bm'",
    "arm_comparison": _BASE + """, v AS (SELECT b.question_id, CAST(b.n10 > 0 AS DOUBLE) AS b10, CAST(b.n50 > 0 AS DOUBLE) AS b50, CAST(coalesce(1.0 / b.first, 0.0) AS DOUBLE) AS br, CAST(l.n10 > 0 AS DOUBLE) AS l10, CAST(l.n50 > 0 AS DOUBLE) AS l50, CAST(coalesce(1.0 / l.first, 0.0) AS DOUBLE) AS lr FROM arm b JOIN arm l USING (question_id) WHERE b.arm = 'bm' AND l.arm = 'lx')
      SELECT count(*) AS questions, round(avg(l10) - avg(b10), 6) AS delta_hit_10, round(avg(l50) - avg(b50), 6) AS delta_hit_50, round(avg(lr) - avg(br), 6) AS delta_mrr, count(*) FILTER (l50 > 0 AND b50 = 0) AS novel, count(*) FILTER (l50 = 0 AND b50 > 0) AS lost, avg(l10) >= avg(b10) AND avg(l50) >= avg(b50) AND avg(lr) >= avg(br) AS non_regressing FROM v""",
    "win_tie_loss": _BASE + ", v AS (SELECT CAST(coalesce(1.0 / l.first, 0.0) AS DOUBLE) - CAST(coalesce(1.0 / b.first, 0.0) AS DOUBLE) AS d FROM arm b JOIN arm l USING (question_id) WHERE b.arm = 'bm' AND l.arm = 'lx') SELECT count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses, round(avg(d), 6) AS mean_delta FROM v",
    "failure_class": _BASE + _CLASS + " SELECT question_id, class FROM fc",
    "failure_counts": _BASE + _CLASS + " SELECT class, count(*) AS n FROM fc GROUP BY class",
    "set_failure_counts": _BASE + _CLASS + " SELECT class, count(*) AS n FROM fc GROUP BY class",
    "pearson_metrics": _BASE + r""", w AS (SELECT per.*, CAST(len(list_filter(regexp_split_to_array(question, '\s+'), lambda x: x <> '')) AS DOUBLE) AS words FROM per JOIN q USING (question_id)),
      l AS (SELECT 'words' AS x, 'mrr_at_10' AS y, CAST(words AS DOUBLE) AS a, CAST(mrr_at_10 AS DOUBLE) AS b FROM w UNION ALL SELECT 'words', 'recall_at_1', words, recall_at_1 FROM w UNION ALL SELECT 'relevant', 'recall_at_10', relevant, recall_at_10 FROM w)
      SELECT x, y, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, round(CASE WHEN min(a) FILTER (b IS NOT NULL) = max(a) FILTER (b IS NOT NULL) OR min(b) = max(b) THEN NULL ELSE corr(a, b) END, 6) AS r, CASE WHEN count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) < 2 THEN 'INSUFFICIENT_PAIRS' WHEN min(a) FILTER (b IS NOT NULL) = max(a) FILTER (b IS NOT NULL) OR min(b) = max(b) THEN 'ZERO_VARIANCE' END AS reason FROM l GROUP BY x, y""",
    "ltr_features": _BASE + """, f AS (SELECT coalesce(bm.question_id, lx.question_id) AS question_id, coalesce(bm.chunk_id, lx.chunk_id) AS chunk_id, bm.score AS s, bm.rank AS sr, lx.score AS d, lx.rank AS dr FROM bm FULL OUTER JOIN lx ON bm.question_id = lx.question_id AND bm.chunk_id = lx.chunk_id)
      SELECT question_id, chunk_id, CAST((question_id, chunk_id) IN (SELECT (question_id, chunk_id) FROM lab) AS BIGINT) AS label, round(coalesce(s, 0.0), 6) AS bm25_score, CAST(coalesce(sr, 51) AS DOUBLE) AS bm25_rank, round(coalesce(d, 0.0), 6) AS dense_score, CAST(coalesce(dr, 51) AS DOUBLE) AS dense_rank, CAST(len(qtoks) AS DOUBLE) AS query_length, CAST(len(toks) AS DOUBLE) AS candidate_length,
        round(len(list_intersect(list_distinct(qtoks), list_distinct(toks))) / len(list_distinct(list_concat(qtoks, toks))), 6) AS lexical_overlap, 0.0::DOUBLE AS legal_term_overlap, CAST(CAST(sr IS NOT NULL AS INT) + 2 * CAST(dr IS NOT NULL AS INT) AS DOUBLE) AS source_retriever_flags FROM f JOIN q USING (question_id) JOIN c USING (chunk_id)""",
    "admission_budget": _BASE + _admit("SELECT * FROM pool", 1000, None),
    "bounded_oracle": _BASE + _admit("SELECT * FROM pool WHERE (question_id, evidence_id) IN (SELECT (question_id, chunk_id) FROM lab)", 1500, 3),
    "packing_calibration": _BASE + _CAL + " SELECT * FROM calr",
    "packing_threshold": _BASE + _CAL + " SELECT threshold, f1 FROM calr ORDER BY f1 DESC, threshold DESC LIMIT 1",
    "answer_coverage": _BASE + "SELECT question_id, chunk_id, round(len(list_intersect(list_distinct(qtoks), list_distinct(toks))) / len(list_distinct(qtoks)), 6) AS coverage FROM bm JOIN q USING (question_id) JOIN c USING (chunk_id) WHERE rank <= 3",
}
ORACLES["dense_store_topk"] = ORACLES["cosine_topk"]
