"""Queries over the driver's tables for corpora, splits, answer scores and training data, with their SQL counterparts.

Parsers of legal text run over the tables whole: documents are passages, assistant turns answers, benchmark texts and user turns questions.
Seven queries have SQL that states the rows of the small fixture below by hand, so they stay on it; WHOLE names the query over the
tables that does the same work.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import legal
from corpusloom.functions import text as tx
from corpusloom.operators import corpus, freeze, index, metrics, packing, resample, retrieve, rouge, split, training
from corpusloom.plans.materialize import fresh_path, written
from corpusloom.sources import sinks
from corpusloom.streaming import remaining

CONTEXTS = [
    ("1", "Luật Đất đai 2013", "Luật số 45/2013/QH13 về đất đai\nĐiều 1. Phạm vi\nLuật này quy định về đất.\nĐiều 2. Quyền\n1. Người dùng đất có quyền:\na) được cấp giấy chứng nhận;\nb) được bồi thường.\n2. Nhà nước bảo hộ quyền đó."),
    ("2", "Nghị định về phạt", "Nghị định 90/2017/NĐ-CP\nChương I\nĐiều 3. Mức phạt\n1. Phạt 5 triệu đồng.\n3. Phạt 10 triệu đồng trong 30 ngày."),
    ("3", "Công văn", "Trả lời công văn 1/2020/CV-A và 2/2021/CV-B"),
]
QUESTIONS = [
    ("a", "Điểm a khoản 1 Điều 2 số 45/2013/QH13 là gì?", "Theo điểm a khoản 1 Điều 2 Luật Đất đai 2013, được cấp giấy chứng nhận."),
    ("b", "Mức phạt bao nhiêu?", "Căn cứ khoản 3 Điều 3 Nghị định 90/2017/NĐ-CP. Như vậy phạt 10 triệu đồng."),
    ("c", "Thời hạn là bao lâu?", "Không có căn cứ."),
    ("d", "điểm b Điều 2 có hiệu lực khi nào?", "Theo Luật Đất đai 2013."),
    ("e", "Điều 1 và Điều 3 khác nhau thế nào?", "Theo Điều 9 Nghị định 90/2017/NĐ-CP."),
]


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _contexts(spark):
    return spark.createDataFrame(CONTEXTS, "context_id string, name string, passage string")


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id string, question string, answer string")


def _passages(spark, d):
    """Documents as contexts, named by their first line."""
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("context_id"), F.substring_index("text", "\n", 1).alias("name"), F.col("text").alias("passage"))


def _turns(spark, d, role):
    return table(spark, d, "conversations").where(F.col("role") == role).select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), "text")


def _answers(spark, d):
    return _turns(spark, d, "assistant").withColumnRenamed("text", "answer")


def _asked(spark, d):
    """Benchmark texts by item_id and user turns by conv_id:turn."""
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), "text").unionByName(_turns(spark, d, "user")).withColumnRenamed("text", "question")


def _aliases(contexts):
    return retrieve.alias_proposals(contexts).where("proposal IS NOT NULL").select(F.col("proposal").alias("document_key"), "context_id")


def _laws(contexts):
    return contexts.select(tx.law_identity_key(F.col("name")).alias("law_key"), "context_id").where("law_key IS NOT NULL")


def _legal_chunks(contexts):
    h = corpus.headings(contexts)
    return h.select(F.concat_ws("/", "context_id", F.concat_ws("/", "path")).alias("chunk_id"), "context_id", F.col("path").alias("hierarchy_path"), F.col("kind").alias("hierarchy_kind"), F.col("ordinal").alias("hierarchy_ordinal"), "start", "end", "path")


def token_stats(spark, d):
    return corpus.corpus_report(table(spark, d, "documents").select("lang", F.size(tx.tokens(F.col("text"))).alias("tokens")), ["lang"])


def token_windows(spark, d):
    return corpus.token_windows(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def window_report(spark, d):
    return corpus.corpus_report(token_windows(spark, d).withColumn("first", (F.col("window_no") == 0).cast("int")), ["first"])


def largest_documents(spark, d):
    return corpus.largest(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(tx.tokens(F.col("text"))).alias("tokens")))


def length_summary(spark, d):
    out = metrics.length_summary(table(spark, d, "conversations").select("role", tx.word_count(F.col("text")).alias("words")), "words", ["role"])
    return out.withColumn("mean", F.round("mean", 6))


def hash_split(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), split.assignment("split.v1", F.col("doc_id").cast("string")).alias("assignment"))


def group_split(spark, d):
    return split.group_split(table(spark, d, "documents").select(F.col("doc_id").alias("id")), "d.v1")


def char_5gram_neardup(spark, d):
    return split.near_duplicate_rows(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def components(spark, d):
    return split.split_groups(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def split_manifest(spark, d):
    return split.split_manifest(components(spark, d), "split.v1").groupBy("assignment").agg(F.count("*").alias("rows"), F.count_distinct("group").alias("groups"))


def split_certificate(spark, d):
    """What crosses the parts of the documents' split, by groups, and of one that had ignored them: counts by kind."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    groups = written(components(spark, d), "certificate-groups")
    by_group = split.assigned(docs, groups, "split.v1")
    by_id = docs.select("id", "text", F.col("id").alias("group"), split.assignment("split.v1", F.col("id").cast("string")).alias("assignment"))
    found = [split.split_leaks(rows).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(name).alias("split"), "kind", "n") for name, rows in (("by_group", by_group), ("by_id", by_id))]
    return found[0].unionByName(found[1])


def cross_overlaps(spark, d):
    return split.cross_overlaps(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def stratified_sample(spark, d):
    return split.stratified_sample(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("branch"), F.length("text").alias("length")), "sample.v1")


def evenly_spaced(spark, d):
    return split.evenly_spaced(table(spark, d, "benchmark").select(F.col("item_id").alias("id")), 8)


def delta_overlay(spark, d):
    base = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("v"))
    new = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(9).alias("v"))
    return split.overlay(base, split.changed(base, new, "id", "v"))


def url_validation(spark, d):
    return table(spark, d, "pages").select("page_id", tx.http_url_ok(F.col("url")).alias("valid"))


def content_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_id("chunk_", F.concat_ws("\n", F.lit("v1"), F.col("doc_id").cast("string"))).alias("content_id"), tx.checksum(F.coalesce("text", F.lit(""))).alias("checksum"))


def latency_quantiles(spark, d):
    out = metrics.latency_quantiles(table(spark, d, "events"), "value", ["event_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "per_unit")})


def grounding_rates(spark, d):
    out = metrics.rates(table(spark, d, "labels").withColumn("q", F.when(F.col("quality") == 1, "good").otherwise("bad")), "q", ["good", "bad"])
    return out.withColumns({c: F.round(c, 6) for c in ("rate_good", "rate_bad")})


def _answer_pairs(spark, d):
    c = table(spark, d, "conversations")
    after = Window.partitionBy("conv_id").orderBy("turn")
    j = c.withColumn("next_role", F.lead("role").over(after)).withColumn("prediction", F.lead("text").over(after))
    return j.where("role = 'user' AND next_role = 'assistant'").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("reference"), "prediction")


def rouge_n(spark, d):
    return rouge.rouge_n(_answer_pairs(spark, d)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "fmeasure")})


def rouge_2(spark, d):
    return rouge.rouge_n(_answer_pairs(spark, d), 2).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "fmeasure")})


def rouge_l(spark, d):
    return rouge.answer_scores(_answer_pairs(spark, d))


def answer_scores_stem(spark, d):
    """ROUGE-L and METEOR with stems."""
    return rouge.answer_scores(_answer_pairs(spark, d), stems=True)


def packed_sequences(spark, d):
    """Answer pairs as token hashes, packed into sequences of 512 tokens."""
    ids = lambda c: F.transform(tx.terms(F.col(c)), lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(50_000)).cast("int"))
    rows = _answer_pairs(spark, d).select(F.col("id").alias("example_id"), ids("reference").alias("prompt"), F.slice(ids("prediction"), 1, 511).alias("target")).where("size(target) > 0")
    made = packing.packed(packing.trimmed(rows, 512), 512)
    return made.select("sequence", F.size("example_ids").alias("examples"), F.size("ids").alias("tokens"), F.size(F.filter("labels", lambda x: x != packing.IGNORED)).alias("loss_tokens"), F.array_max("ends").alias("end"))


def rouge_aggregate(spark, d):
    """Percentiles of resampled means of ROUGE-1 over all answer pairs."""
    scores = rouge.rouge_n(_answer_pairs(spark, d), 1)
    return resample.aggregated(scores, ["precision", "recall", "fmeasure"], "rouge").withColumns({c: F.round(c, 6) for c in ("low", "mid", "high")})


def compaction(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.compacted(F.col("text"), 30).alias("answer"))


def compaction_proof(spark, d):
    """Assistant turns cut to the median of their words, and the proof that nothing was added."""
    a = table(spark, d, "conversations").where("role = 'assistant' AND trim(text) <> ''").select("text")
    policy = corpus.length_policy(a, "text").first()
    cut = corpus.deletion_proof(a.select(tx.canonical(F.col("text")).alias("before"), tx.compacted(F.col("text"), policy["maximum"] or 1).alias("after")))
    return cut.select("*", F.lit(policy["maximum"]).alias("maximum"))


def answer_forms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.sentence_count(F.col("text")).alias("sentences"), corpus.opening(F.col("text")).alias("opening"), corpus.closing(F.col("text")).alias("closing"), tx.has_forbidden(F.col("text")).alias("forbidden"))


def extractive_answers(spark, d):
    return table(spark, d, "documents").select("doc_id", corpus.extractive_answer(F.col("text")).alias("answer"))


def fixed_refusal(spark, d):
    return corpus.with_refusals(table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question_id")))


def forensics_summary(spark, d):
    return corpus.pattern_counts(table(spark, d, "documents"))


def legal_patterns(spark, d):
    return corpus.pattern_counts(table(spark, d, "conversations"))


def containment_pairs(spark, d):
    return metrics.containment_join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("needle_id"), "text"))


def submission_check(spark, d):
    answers = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("question_id"), F.when(F.col("toxic") == 1, "").otherwise("x").alias("answer"))
    return sinks.validate_submission(answers, table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("question_id")))


def resume_remaining(spark, d):
    work = table(spark, d, "documents").select("doc_id", F.col("lang").alias("fingerprint"))
    done = table(spark, d, "labels").where("quality = 1").select("doc_id").join(work, "doc_id")
    return remaining(work, done, "doc_id", "fingerprint")


def param_audit(spark, d):
    rows = [("embed", [1000, 64], False, False), ("head", [64, 10], True, False), ("lora.a", [64, 8], True, True), ("bias", [10], True, False)]
    return training.audit_parameters(spark.createDataFrame(rows, "name string, shape array<long>, trainable boolean, adapter boolean"))


def dataset_policy(spark, d):
    rows = table(spark, d, "conversations").select(F.lit("train").alias("partition"), (F.col("role") == "assistant").alias("generated"), F.col("role").alias("task"), F.col("text").alias("target"), F.lit("v1").alias("version"))
    return training.policy_violations(rows)


def alias_headers(spark, d):
    return _alias_states(_contexts(spark))


def document_aliases(spark, d):
    return _alias_states(_passages(spark, d))


def _alias_states(contexts):
    return retrieve.alias_proposals(contexts).select("context_id", F.size("keys").alias("keys"), "proposal", "state")


def exact_resolve(spark, d):
    return _resolved(_questions(spark), _contexts(spark))


def alias_freeze(spark, d):
    """Documents named by the one mail address in them, as no document has a number of a law: proposed, frozen, opened again and verified."""
    c = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("context_id"), F.col("text").alias("passage"))
    found = freeze.proposed(c, lambda t: F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), F.lit(0)), F.lower, head=4096)
    path = fresh_path(spark, "aliases")
    freeze.freeze(found, c, path, freeze.approval(found), F.lower)
    return freeze.open_frozen(spark, path, c, F.lower).select("place", "document_key", "context_id", "canonical_start", "canonical_end")


def question_resolution(spark, d):
    return _resolved(_asked(spark, d), _passages(spark, d))


def _resolved(questions, contexts, chunks=None):
    return index.resolved(questions, _aliases(contexts), _legal_chunks(contexts) if chunks is None else chunks)


def hierarchy_chunks(spark, d):
    return corpus.chunked(_passages(spark, d)).groupBy("context_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))


def hierarchy_warnings(spark, d):
    return _warnings(_contexts(spark))


def document_warnings(spark, d):
    return _warnings(_passages(spark, d))


def _warnings(contexts):
    return corpus.headings(contexts).groupBy("context_id").agg(F.count("*").alias("nodes"), F.count_if("breaks").alias("warnings"))


def citations(spark, d):
    return _citations(_questions(spark))


def answer_citations(spark, d):
    return _citations(_answers(spark, d))


def _citations(answers):
    return training.cited(answers).select("question_id", "document_number", "law_identity", "article", "clause", "point")


def supervision_classes(spark, d):
    return _supervision(_questions(spark), _contexts(spark))


def answer_supervision(spark, d):
    return _supervision(_answers(spark, d), _passages(spark, d))


def _supervision(answers, contexts):
    laws = _laws(contexts)
    chunks = _legal_chunks(contexts).select("chunk_id", "context_id", F.col("hierarchy_path").alias("path"))
    return training.supervision_groups(answers, training.supervise(training.cited(answers), _aliases(contexts), laws, chunks)).select("question_id", "mapping_class", F.size("chunk_ids").alias("chunks"), "confidence")


def question_taxonomy(spark, d):
    return _taxonomy(_questions(spark))


def question_types(spark, d):
    return _taxonomy(_asked(spark, d))


def _taxonomy(questions):
    s = corpus.question_signals(F.col("question"))
    return questions.select("question_id", F.concat_ws(",", s).alias("signals"), corpus.primary_type(s).alias("primary"))


def semantic_signals(spark, d):
    return corpus.semantic_signals(_answers(spark, d).select(F.col("question_id").alias("id"), F.col("answer").alias("text")))


def hard_negatives(spark, d):
    """A benchmark text's positives are the chunks of documents that hold it; negatives come from the same documents."""
    chunks = written(corpus.chunked(_passages(spark, d)).select("chunk_id", "context_id", "path", "start", "end", F.col("display_text").alias("text")), "legal-chunks")
    questions = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"))
    positives = metrics.containment_join(chunks.select("chunk_id", "text"), questions.select(F.col("question_id").alias("needle_id"), F.col("question").alias("text")))
    positives = written(positives.select(F.col("needle_id").alias("question_id"), "chunk_id"), "positives")
    return training.hard_negatives(positives, chunks, questions).select("question_id", "chunk_id", "negative_type", "position")


QUERIES = {f.__name__: f for f in (
    token_stats, token_windows, window_report, largest_documents, length_summary, hash_split, group_split, char_5gram_neardup, components, split_manifest, split_certificate, cross_overlaps, stratified_sample,
    evenly_spaced, delta_overlay, url_validation, content_ids, latency_quantiles, grounding_rates, rouge_n, rouge_2, rouge_l, answer_scores_stem, rouge_aggregate, packed_sequences, compaction, compaction_proof, answer_forms, extractive_answers, fixed_refusal,
    forensics_summary, legal_patterns, containment_pairs, submission_check, resume_remaining, param_audit, dataset_policy, alias_headers, exact_resolve, hierarchy_chunks, hierarchy_warnings,
    citations, supervision_classes, question_taxonomy, semantic_signals, hard_negatives, document_aliases, alias_freeze, question_resolution, document_warnings, answer_citations, answer_supervision,
    question_types,
)}

#: Queries on the fixture, as their SQL fixes its rows; none is registered, as they read no table. The query over the tables does each one's work there, but tables have no model parameters.
WHOLE = {
    "alias_headers": "document_aliases", "exact_resolve": "question_resolution", "hierarchy_warnings": "document_warnings", "citations": "answer_citations",
    "supervision_classes": "answer_supervision", "question_taxonomy": "question_types", "param_audit": None,
}
ON_FIXTURE = {name: QUERIES.pop(name) for name in WHOLE}

# ---- SQL counterparts ----

_TOK = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}]+|[\p{P}\p{S}]')"
_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '\p{P}', ' ', 'g'), '\s+', ' ', 'g'))"
_WINDOWS = f"""WITH t AS (SELECT doc_id AS id, {_TOK} AS t FROM documents),
w AS (SELECT id, t, unnest(CASE WHEN len(t) <= 512 THEN [0] ELSE range(0, CAST(greatest(ceil((len(t) - 512) / 448.0), 0) AS BIGINT) * 448 + 1, 448) END) AS s FROM t WHERE len(t) > 0),
x AS (SELECT id, s, CASE WHEN len(t) <= 512 THEN t ELSE t[s + 1:s + 512] END AS w FROM w)
"""
_SHARE = "CAST(CAST('0x' || substr(sha256('{0}' || chr(10) || {1}), 1, 16) AS UBIGINT) AS HUGEINT)"
_ASSIGN = "CASE WHEN {0} * 10 < 18446744073709551616::HUGEINT * 8 THEN 'train' WHEN {0} * 10 < 18446744073709551616::HUGEINT * 9 THEN 'development' ELSE 'local_test' END"
_PAIRS = "WITH o AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT conv_id || ':' || turn AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS r, list_filter(regexp_split_to_array(lower(nt), '[^a-z0-9]+'), lambda x: x <> '') AS p FROM o WHERE role = 'user' AND nr = 'assistant')"


def _rouge(n: int) -> str:
    grams = "list_transform(range(1, greatest(len({0}) - " + str(n) + " + 1, 0) + 1), lambda i: array_to_string({0}[CAST(i AS BIGINT):CAST(i AS BIGINT) + " + str(n - 1) + "], ' '))"
    return _PAIRS + f""", g AS (SELECT id, {grams.format('r')} AS r, {grams.format('p')} AS p FROM p),
    a AS (SELECT id, x, count(*) AS c FROM (SELECT id, unnest(r) AS x FROM g) GROUP BY ALL), b AS (SELECT id, x, count(*) AS c FROM (SELECT id, unnest(p) AS x FROM g) GROUP BY ALL),
    h AS (SELECT id, sum(least(a.c, b.c)) AS hit FROM a JOIN b USING (id, x) GROUP BY id),
    s AS (SELECT g.id, coalesce(coalesce(hit, 0) / nullif(len(p), 0), 0.0) AS pr, coalesce(coalesce(hit, 0) / nullif(len(r), 0), 0.0) AS rc FROM g LEFT JOIN h USING (id))
    SELECT id, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS fmeasure FROM s"""


_DISC = lambda p: f"CAST(quantile_disc(n, {p}) AS BIGINT)"

# white space as Unicode has it, and the four separators besides
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _compact(source: str, columns: str, limit: str) -> str:
    """CTEs: cut has the columns, the canonical text t and what is left of it within limit words."""
    return f"""cw AS (SELECT {columns}t, string_split(t, ' ') AS ws, {limit} AS most FROM (SELECT *, trim(regexp_replace(nfc_normalize(text), '{_SPACES}', ' ', 'g')) AS t FROM {source})),
    ce AS (SELECT *, list_max(list_filter(range(1, CAST(most AS BIGINT) + 1), lambda i: regexp_matches(coalesce(ws[i], ''), '[.!?]$'))) AS e FROM cw),
    cut AS (SELECT {columns}t, most, CASE WHEN len(ws) <= most OR e IS NULL THEN t ELSE array_to_string(ws[1:e], ' ') END AS answer FROM ce)"""


ORACLES = {
    "alias_freeze": r"""WITH h AS (SELECT doc_id, substr(text, 1, 4096) AS head, regexp_extract_all(substr(text, 1, 4096), '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS found FROM documents),
    o AS (SELECT doc_id, head, found[1] AS number FROM h WHERE len(list_distinct(list_transform(found, lambda x: lower(x)))) = 1)
    SELECT row_number() OVER (ORDER BY lower(number), doc_id, number) - 1 AS place, lower(number) AS document_key, CAST(doc_id AS VARCHAR) AS context_id, CAST(strpos(head, number) - 1 AS BIGINT) AS canonical_start,
      CAST(strpos(head, number) - 1 + length(number) AS BIGINT) AS canonical_end FROM o""",
    "compaction": f"WITH {_compact('conversations', 'conv_id, turn, ', '30')} SELECT conv_id, turn, answer FROM cut",
    "compaction_proof": f"""WITH a AS (SELECT text FROM conversations WHERE role = 'assistant' AND trim(text) <> ''),
    m AS (SELECT quantile_disc(len(string_split(trim(regexp_replace(nfc_normalize(text), '{_SPACES}', ' ', 'g')), ' ')), 0.5) AS most FROM a), {_compact('a', '', '(SELECT most FROM m)')}
    SELECT count(*) AS answers, count(*) FILTER (t <> answer) AS changed, CAST(sum(length(t) - length(answer)) AS BIGINT) AS removed_characters, bool_and(starts_with(t, answer)) AS passed, CAST(max(most) AS BIGINT) AS maximum FROM cut""",
    "token_stats": f"WITH t AS (SELECT lang, len({_TOK}) AS n FROM documents) SELECT lang, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS total, {_DISC(0.5)} AS p50, {_DISC(0.95)} AS p95, {_DISC(0.99)} AS p99, max(n) AS longest FROM t GROUP BY lang",
    "token_windows": _WINDOWS + "SELECT id, CAST(s / 448 AS BIGINT) AS window_no, s AS first_token, len(w) AS tokens, sha256(array_to_string(w, ' ')) AS checksum FROM x",
    "window_report": _WINDOWS + f", t2 AS (SELECT CAST(s = 0 AS BIGINT) AS first, len(w) AS n FROM x) SELECT first, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS total, {_DISC(0.5)} AS p50, {_DISC(0.95)} AS p95, {_DISC(0.99)} AS p99, max(n) AS longest FROM t2 GROUP BY first",
    "largest_documents": f"SELECT doc_id AS id, len({_TOK}) AS tokens FROM documents ORDER BY tokens DESC, id LIMIT 20",
    "length_summary": r"WITH t AS (SELECT role, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM conversations) SELECT role, count(n) AS n, min(t.n) AS minimum, round(avg(t.n), 6) AS mean, " + ", ".join(f"CAST(quantile_disc(t.n, {p / 100}) AS BIGINT) AS p{p}" for p in (50, 75, 90, 95, 99)) + ", max(t.n) AS maximum FROM t GROUP BY role",
    "hash_split": f"SELECT doc_id AS id, {_ASSIGN.format(_SHARE.format('split.v1', 'CAST(doc_id AS VARCHAR)'))} AS assignment FROM documents",
    "group_split": f"SELECT doc_id AS id, CASE WHEN {_SHARE.format('d.v1', 'CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN 'validation' ELSE 'fit' END AS partition FROM documents",
    "cross_overlaps": f"""WITH l AS (SELECT CAST(item_id AS VARCHAR) AS id, {_NORM} AS text FROM benchmark), r AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_NORM} AS text FROM documents),
      ch AS (SELECT side, id, text, length(text) AS len, string_split(text, '') AS c FROM (SELECT 'L' AS side, * FROM l UNION ALL SELECT 'R', * FROM r) WHERE length(text) > 0),
      g AS (SELECT side, id, text, len, list_distinct(list_transform(range(1, greatest(len - 3, 2)), lambda i: array_to_string(c[CAST(i AS BIGINT):CAST(i AS BIGINT) + 4], ''))) AS g FROM ch)
      SELECT a.id AS left_id, b.id AS right_id, CASE WHEN a.text = b.text THEN 'exact_normalized' ELSE 'near_duplicate' END AS kind FROM g a JOIN g b ON a.side = 'L' AND b.side = 'R' AND (a.text = b.text OR (abs(a.len - b.len) * 10 <= greatest(a.len, b.len) AND len(list_intersect(a.g, b.g)) * 10 >= (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) * 9))""",
    "stratified_sample": """WITH r AS (SELECT doc_id AS id, lang AS branch, row_number() OVER (PARTITION BY lang ORDER BY length(text), CAST(doc_id AS VARCHAR)) AS rn, count(*) OVER (PARTITION BY lang) AS n, sha256('sample.v1' || chr(10) || CAST(doc_id AS VARCHAR)) AS digest FROM documents),
      t AS (SELECT *, least(2, 3 * (rn - 1) // n) AS tercile FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY branch, tercile ORDER BY digest) AS k FROM t)
      SELECT id, branch, CAST(tercile AS BIGINT) AS tercile, row_number() OVER (ORDER BY digest) - 1 AS position FROM k WHERE k <= 10""",
    "evenly_spaced": "WITH n AS (SELECT item_id AS id, row_number() OVER (ORDER BY item_id) - 1 AS position, count(*) OVER () AS n FROM benchmark) SELECT id, position FROM n WHERE position IN (SELECT i * (SELECT max(n) FROM n) // 8 FROM range(8) t(i))",
    "delta_overlay": "SELECT doc_id AS id, CAST(CASE WHEN toxic = 1 THEN 9 ELSE quality END AS BIGINT) AS v FROM labels",
    "url_validation": r"SELECT page_id, coalesce(regexp_full_match(url, '(?i)https?://[^/?#@\s]+(?:[/?#]\S*)?'), false) AS valid FROM pages",
    "content_ids": "SELECT doc_id, 'chunk_' || substr(sha256('v1' || chr(10) || CAST(doc_id AS VARCHAR)), 1, 24) AS content_id, 'sha256:' || sha256(coalesce(text, '')) AS checksum FROM documents",
    "latency_quantiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(count(value) / sum(value), 6) AS per_unit FROM events GROUP BY event_type",
    "grounding_rates": "SELECT count(*) AS n, round(avg(CAST(quality = 1 AS DOUBLE)), 6) AS rate_good, round(avg(CAST(quality IS DISTINCT FROM 1 AS DOUBLE)), 6) AS rate_bad FROM labels",
    "rouge_n": _rouge(1),
    "rouge_2": _rouge(2),
    "fixed_refusal": f"SELECT CAST(item_id AS VARCHAR) AS question_id, '{corpus.REFUSAL}' AS answer FROM benchmark",
    "containment_pairs": r"""WITH c AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+|[\p{P}\p{S}]') AS t FROM documents), n AS (SELECT item_id AS needle_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+|[\p{P}\p{S}]') AS t FROM benchmark)
      SELECT needle_id, chunk_id FROM n, c WHERE len(n.t) > 0 AND contains(chr(1) || array_to_string(c.t, chr(1)) || chr(1), chr(1) || array_to_string(n.t, chr(1)) || chr(1))""",
    "submission_check": "SELECT (SELECT count(*) FROM labels) AS rows, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unknown, (SELECT count(*) - count(DISTINCT doc_id) FROM labels) AS duplicates, (SELECT count(*) FROM labels WHERE toxic = 1) AS empty",
    "resume_remaining": "SELECT doc_id, lang AS fingerprint FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "param_audit": "SELECT CAST(65162 AS BIGINT) AS total, CAST(1162 AS BIGINT) AS trainable, CAST(512 AS BIGINT) AS adapters, true AS within_limit",
    "dataset_policy": "SELECT CAST(0 AS BIGINT) AS not_train, count(*) FILTER (role = 'assistant') AS generated_text, count(*) FILTER (text IS NULL OR text = '') AS empty_target, CAST(1 AS BIGINT) AS versions FROM conversations",
    "alias_headers": "SELECT * FROM (VALUES ('1', 1::BIGINT, '45/2013/qh13', 'PROPOSED'), ('2', 1::BIGINT, '90/2017/nd-cp', 'PROPOSED'), ('3', 2::BIGINT, NULL, 'AMBIGUOUS')) t(context_id, keys, proposal, state)",
    "exact_resolve": "SELECT * FROM (VALUES ('a', '1/Điều 2/Khoản 1/Điểm a', NULL), ('b', NULL, 'EXACT_COORDINATE_ABSENT'), ('c', NULL, 'EXACT_COORDINATE_ABSENT'), ('d', NULL, 'EXACT_REFERENCE_MALFORMED'), ('e', NULL, 'EXACT_COORDINATE_AMBIGUOUS')) t(question_id, chunk_id, diagnostic)",
    "hierarchy_warnings": "SELECT * FROM (VALUES ('1', 6::BIGINT, 0::BIGINT), ('2', 4::BIGINT, 1::BIGINT)) t(context_id, nodes, warnings)",
    "citations": "SELECT * FROM (VALUES ('a', NULL, 'luat dat dai 2013', '2', '1', 'a'), ('b', '90/2017/NĐ-CP', NULL, '3', '3', NULL), ('d', NULL, 'luat dat dai 2013', NULL, NULL, NULL), ('e', '90/2017/NĐ-CP', NULL, '9', NULL, NULL)) t(question_id, document_number, law_identity, article, clause, point)",
    "supervision_classes": "SELECT * FROM (VALUES ('a', 'EXACT_DOC_ARTICLE_POINT', 1::BIGINT, 0.95::DOUBLE), ('b', 'EXACT_DOC_ARTICLE_CLAUSE', 1::BIGINT, 1.0::DOUBLE), ('c', 'UNRESOLVED', 0::BIGINT, 0.0::DOUBLE), ('d', 'DOCUMENT_ONLY', 0::BIGINT, 1.0::DOUBLE), ('e', 'UNRESOLVED', 0::BIGINT, 0.0::DOUBLE)) t(question_id, mapping_class, chunks, confidence)",
    "question_taxonomy": "SELECT * FROM (VALUES ('a', 'DEFINITION,MULTI_COORDINATE', 'MULTI_COORDINATE'), ('b', 'PENALTY,NUMERIC,MULTI_CONDITION', 'MULTI_CONDITION'), ('c', 'DEADLINE', 'DEADLINE'), ('d', 'CONDITION,DEADLINE,MULTI_CONDITION,MULTI_COORDINATE', 'MULTI_COORDINATE'), ('e', 'DEFINITION,MULTI_COORDINATE', 'MULTI_COORDINATE')) t(question_id, signals, \"primary\")",
}
