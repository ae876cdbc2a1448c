"""Chunk corpora, their reports, question taxonomies and answer forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import legal
from corpusloom.functions import text as tx
from corpusloom.operators.metrics import nearest_rank

# fixed values: cues of question types, in folded form as written, and their priority
CUES = {
    "DEFINITION": ["là gì", "được hiểu", "khái niệm", "định nghĩa", "thế nào"],
    "CONDITION": ["điều kiện", "khi nào", "trường hợp nào"],
    "PROCEDURE": ["thủ tục", "trình tự", "hồ sơ", "thực hiện như thế nào"],
    "AUTHORITY": ["thẩm quyền", "cơ quan nào", "ai quyết định", "ai có quyền"],
    "RIGHT": ["quyền gì", "được quyền", "có được"],
    "OBLIGATION": ["nghĩa vụ", "trách nhiệm", "phải làm gì"],
    "ELIGIBILITY": ["đối tượng", "ai được", "được hưởng"],
    "DEADLINE": ["thời hạn", "bao lâu", "khi nào"],
    "PENALTY": ["xử phạt", "mức phạt", "phạt bao nhiêu"],
    "EXCEPTION": ["ngoại lệ", "trừ trường hợp", "không áp dụng"],
    "NUMERIC": ["bao nhiêu", "mức", "tỷ lệ", "phần trăm"],
}
PRIORITY = ["MULTI_COORDINATE", "MULTI_CONDITION", "PENALTY", "DEADLINE", "AUTHORITY", "PROCEDURE", "EXCEPTION", "CONDITION", "ELIGIBILITY", "OBLIGATION", "RIGHT", "DEFINITION", "NUMERIC"]
SIGNALS = {
    "number": r"(?U)(?<!\w)\d+(?:[.,]\d+)*(?!\w)",
    "percentage": r"(?iuU)(?:\d+(?:[.,]\d+)?\s*%|\bphần\s+trăm\b)",
    "date": r"(?iuU)(?:\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\bngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}\b)",
    "currency": r"(?iuU)(?:\b\d+(?:[.,]\d+)*\s*(?:đồng|vnđ|vnd|triệu|tỷ)\b|\b(?:đồng|vnđ|vnd)\b)",
    "duration": r"(?iuU)\b\d+(?:[.,]\d+)?\s*(?:ngày|tháng|năm|giờ|phút|tuần|buổi)\b",
    "article": r"(?iuU)\bđiều\s+[0-9a-zđ]+",
    "clause": r"(?iuU)\bkhoản\s+[0-9a-zđ]+",
    "point": r"(?iuU)\bđiểm\s+[0-9a-zđ]+",
    "document": r"(?iuU)\b(?:luật|nghị\s+định|thông\s+tư|quyết\s+định|pháp\s+lệnh)\b",
    "list": r"(?imuU)^\s*(?:[-+*]|\d+[.)]|[a-zđ][.)])\s+",
    "condition": r"(?iuU)\b(?:nếu|khi|trường hợp|với điều kiện|đáp ứng)\b",
    "exception": r"(?iuU)\b(?:trừ|ngoại trừ|ngoại lệ|không áp dụng)\b",
}
_COORDINATE = r"(?iuU)\b(?:điều|khoản|điểm)\s+[0-9a-zđ]+"
OPENINGS, CLOSINGS = [("CAN_CU", ["căn cứ"]), ("THEO_QUY_DINH", ["theo quy định", "theo"])], [("THEO_DO", ["theo đó"]), ("DO_DO", ["do đó"]), ("VI_VAY", ["vì vậy"]), ("NHU_VAY", ["như vậy"])]
REFUSAL = "Không đủ căn cứ trong dữ liệu được cung cấp để trả lời câu hỏi này."
ANSWER_LENGTH = 800


def chunked(contexts: DataFrame) -> DataFrame:
    """Rows (chunk_id, context_id, chunk_no, kind, ordinal, path, start, end, window, tokens, display_text, retrieval_text) of contexts (context_id, passage)."""
    c = contexts.select("context_id", F.posexplode(legal.chunks_of(F.col("passage"))).alias("chunk_no", "c")).select("context_id", "chunk_no", "c.*")
    key = F.concat_ws("\n", F.lit("chunking.v1"), F.col("context_id").cast("string"), F.concat_ws("/", "path"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("window").cast("string"), "display_text")
    return c.withColumn("chunk_id", tx.content_id("chunk_", key)).withColumn("chunk_checksum", tx.checksum(F.col("display_text")))


def headings(contexts: DataFrame) -> DataFrame:
    """Rows (context_id, node_no, rule, kind, ordinal, title, path, start, end, level, heading_only, breaks)."""
    return contexts.select("context_id", F.posexplode(legal.hierarchy_of(F.col("passage"))).alias("node_no", "h")).select("context_id", "node_no", "h.*")


def token_windows(texts: DataFrame, window: int = 512, overlap: int = 64, longest: int = 512) -> DataFrame:
    """Rows (id, window_no, first_token, tokens, checksum): a text over longest tokens in windows that overlap, others whole; on built-ins alone."""
    step = window - overlap
    t = texts.select("id", tx.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    starts = F.when(F.size("t") <= longest, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("t") - window) / step).cast("int")) * step, F.lit(step)))
    w = t.select("id", F.transform(starts, lambda s: F.struct(s.alias("first_token"), F.slice("t", s + 1, F.when(F.size("t") <= longest, F.size("t")).otherwise(F.lit(window))).alias("w"))).alias("ws"))
    return w.select("id", F.posexplode("ws").alias("window_no", "x")).select("id", "window_no", "x.first_token", F.size("x.w").alias("tokens"), F.sha2(F.array_join("x.w", " ").cast("binary"), 256).alias("checksum"))


def corpus_report(chunks: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts and nearest-rank lengths of chunks (tokens), per group."""
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.sum("tokens").alias("total"), *[nearest_rank("tokens", p).alias(f"p{p}") for p in (50, 95, 99)], F.max("tokens").alias("longest"))


def largest(chunks: DataFrame, k: int = 20) -> DataFrame:
    return chunks.orderBy(F.col("tokens").desc(), "id").limit(k)


def question_signals(question: Column) -> Column:
    """The types whose cues a question has, with MULTI_CONDITION for two and MULTI_COORDINATE for two coordinates."""
    folded = tx.collapsed(question)
    named = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(folded, F.lit(c)) for c in cues]), F.lit(n)) for n, cues in CUES.items()]))
    multi = F.array_compact(F.array(F.when(F.size(named) >= 2, F.lit("MULTI_CONDITION")), F.when(F.regexp_count(folded, F.lit(_COORDINATE)) >= 2, F.lit("MULTI_COORDINATE"))))
    return F.concat(named, multi)


def primary_type(signals: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(signals, p), F.lit(p)) for p in PRIORITY], F.lit("OTHER"))


def semantic_signals(texts: DataFrame) -> DataFrame:
    """Rows (id, has_reference, numeric, percentage, date, currency, duration): numbers that stand outside references."""
    m = texts.select("id", F.size(legal.citations_of(F.col("text"))).alias("n"), legal.masked_of(F.col("text")).alias("m"))
    flag = lambda k: F.col("m").rlike(SIGNALS[k])
    return m.select("id", (F.col("n") > 0).alias("has_reference"), flag("number").alias("numeric"), *[flag(k).alias(k) for k in ("percentage", "date", "currency", "duration")])


def pattern_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """One row: how many texts have each pattern."""
    return texts.agg(F.count("*").alias("n"), *[F.count_if(F.col(column).rlike(p)).alias(k) for k, p in SIGNALS.items()])


def _named(text: Column, patterns, other: str) -> Column:
    folded, out = tx.collapsed(text), None
    for name, cues in patterns:
        hit = reduce(lambda a, b: a | b, [F.startswith(folded, F.lit(c)) for c in cues])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def opening(text: Column) -> Column:
    return _named(text, OPENINGS, "DIRECT")


def closing(text: Column) -> Column:
    parts = tx.sentences(text)
    return _named(F.coalesce(F.try_element_at(parts, F.lit(-1)), text), CLOSINGS, "OTHER")


def extractive_answer(display: Column) -> Column:
    """The first sentence within ANSWER_LENGTH characters of a text without its heading line, else a cut at a word with an ellipsis; a refusal for null."""
    heading = reduce(lambda a, b: a | b, [F.regexp_extract(display, r"^\s*([^\r\n]*)", 1).rlike("(?iuU)" + h[4].replace("(?P<ordinal>", "(?:").replace("(?P<title>.*)", "")) for h in legal.HEADINGS])
    body = F.regexp_replace(display, r"^\s*[^\r\n]*[\r\n]+", "")
    flat = F.trim(F.regexp_replace(F.when(heading & body.rlike(r"\S"), body).otherwise(display), r"(?U)\s+", " "))
    sentence = F.regexp_extract(flat, rf"(?s)^(.{{0,{ANSWER_LENGTH - 1}}}?[.?!…])(?=\s|$)", 1)
    cut = F.regexp_replace(F.substring(flat, 1, ANSWER_LENGTH), r"\s+\S*$", "")
    return F.when(display.isNull(), REFUSAL).when(sentence != "", sentence).otherwise(F.concat(F.regexp_replace(F.trim(cut), "…+$", ""), F.lit("…")))


def with_refusals(questions: DataFrame) -> DataFrame:
    """The fixed-refusal baseline."""
    return questions.select("question_id", F.lit(REFUSAL).alias("answer"))


def length_policy(answers: DataFrame, column: str = "answer", quantile: float = 0.5) -> DataFrame:
    """One row (rows, maximum): how many answers there are, and the nearest-rank quantile of their words, which no compacted answer may exceed. Blank answers are an error."""
    told = answers.select(tx.canonical(F.col(column)).alias("a"))
    words = F.when(F.coalesce(F.col("a"), F.lit("")) == "", F.raise_error(F.lit("ANSWER_COMPACTION_SOURCE_INVALID")).cast("int")).otherwise(F.size(F.split("a", " ")))
    return told.select(words.alias("n")).agg(F.count("*").alias("rows"), F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY n)").cast("long").alias("maximum"))


def deletion_proof(answers: DataFrame) -> DataFrame:
    """One row (answers, changed, removed_characters, passed) of answers (before, after), both canonical: passed if every change is a cut at the end of a sentence."""
    cut = F.length("before") - F.length("after")
    return answers.agg(F.count("*").alias("answers"), F.count_if(F.col("before") != F.col("after")).alias("changed"), F.coalesce(F.sum(cut), F.lit(0)).alias("removed_characters"), F.coalesce(F.bool_and(tx.deletion_only(F.col("before"), F.col("after"))), F.lit(True)).alias("passed"))
