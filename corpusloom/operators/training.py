"""Training-data construction: citation supervision, hard negatives, pairs, datasets and their policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import legal
from corpusloom.functions import text as tx

# fixed values: mapping classes from most to least exact, and priorities of negatives
CLASSES = ["EXACT_DOC_ARTICLE_POINT", "EXACT_DOC_ARTICLE_CLAUSE", "EXACT_DOC_ARTICLE", "SAME_COORDINATE_MULTICHUNK", "DOCUMENT_ONLY", "AMBIGUOUS", "UNRESOLVED"]
NEGATIVES = ["SAME_CLAUSE_WRONG_POINT", "SAME_ARTICLE_WRONG_CLAUSE", "SAME_DOCUMENT_WRONG_ARTICLE", "ADJACENT_COORDINATE"]
_LABELS = {"part": "phần", "chapter": "chương", "section": "mục", "subsection": "tiểu mục", "article": "điều", "clause": "khoản", "point": "điểm"}


def cited(answers: DataFrame) -> DataFrame:
    """Rows (question_id, citation_no, start, end, document_number, law_identity, article, clause, point, other) of answers (question_id, answer)."""
    found = answers.select("question_id", legal.citations_of(F.col("answer")).alias("c"))
    return found.select("question_id", F.posexplode("c").alias("citation_no", "c")).select("question_id", "citation_no", "c.*")


def _ordinal(path, kind: str):
    """The ordinal of a path's member of one kind, null without."""
    label = _LABELS[kind] + " "
    return F.get(F.transform(F.filter(path, lambda p: F.lower(p).startswith(label)), lambda p: F.substring(F.lower(p), len(label) + 1, 1000)), F.lit(0))


def _met(kind: str):
    """Whether a coordinate, if it is of this kind, is that of the path."""
    return lambda o: (o["kind"] != kind) | F.coalesce(_ordinal(F.col("path"), kind) == o["ordinal"], F.lit(False))


def supervise(citations: DataFrame, aliases: DataFrame, laws: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (question_id, citation_no, contexts, chunk_ids, mapping_class, confidence): each citation's document and chunks, or why not.

    aliases (document_key, context_id) and laws (law_key, context_id) may have several contexts a key; where a citation names both, only
    common contexts count. chunks: chunk_id, context_id, path.
    """
    c = citations.withColumn("document_key", tx.document_number_key(F.col("document_number")))
    by_number = aliases.groupBy("document_key").agg(F.collect_set("context_id").alias("na"))
    by_law = laws.groupBy(F.col("law_key").alias("law_identity")).agg(F.collect_set("context_id").alias("nl"))
    c = c.join(by_number, "document_key", "left").join(by_law, "law_identity", "left")
    none = F.array().cast("array<string>")
    sets = F.when(F.col("document_number").isNotNull() & F.col("law_identity").isNotNull(), F.array_intersect(F.coalesce("na", none), F.coalesce("nl", none)))
    contexts = F.array_sort(sets.when(F.col("document_number").isNotNull(), F.coalesce("na", none)).when(F.col("law_identity").isNotNull(), F.coalesce("nl", none)).otherwise(none))
    c = c.withColumn("contexts", contexts).withColumn("bare", F.col("article").isNull() & (F.size("other") == 0))
    one = c.where((F.size("contexts") == 1) & ~F.col("bare")).select("question_id", "citation_no", "article", "clause", "point", "other", F.col("contexts")[0].alias("context_id"))
    j = one.join(chunks.select("chunk_id", "context_id", "path"), "context_id")
    fits = F.lit(True)
    for kind in ("article", "clause", "point"):
        fits = fits & (F.col(kind).isNull() | F.coalesce(_ordinal(F.col("path"), kind) == F.col(kind), F.lit(False)))
    for kind in ("part", "chapter", "section", "subsection"):
        fits = fits & F.forall("other", _met(kind))
    matched = j.where(fits).groupBy("question_id", "citation_no").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    out = c.join(matched, ["question_id", "citation_no"], "left").withColumn("chunk_ids", F.coalesce("chunk_ids", none))
    kind = (
        F.when(F.size("contexts") == 0, "UNRESOLVED").when(F.size("contexts") > 1, "AMBIGUOUS").when(F.col("bare"), "DOCUMENT_ONLY").when(F.size("chunk_ids") == 0, "UNRESOLVED")
        .when(F.size("chunk_ids") > 1, "SAME_COORDINATE_MULTICHUNK").when(F.col("point").isNotNull(), CLASSES[0]).when(F.col("clause").isNotNull(), CLASSES[1]).when(F.col("article").isNotNull(), CLASSES[2]).otherwise("SAME_COORDINATE_MULTICHUNK")
    )
    out = out.withColumn("mapping_class", kind)
    sure = F.when(F.col("mapping_class").isin("UNRESOLVED", "AMBIGUOUS"), 0.0).when((F.col("mapping_class") == "DOCUMENT_ONLY") | F.col("document_number").isNotNull(), 1.0).otherwise(0.95)
    return out.select("question_id", "citation_no", "contexts", "chunk_ids", "mapping_class", sure.alias("confidence"))


def supervision_groups(questions: DataFrame, supervised: DataFrame) -> DataFrame:
    """Rows (question_id, mapping_class, chunk_ids, confidence): a question fails closed on its worst citation; without any it is unresolved."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("mapping_class"))
    g = supervised.groupBy("question_id").agg(F.max(rank).alias("worst"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids"), F.min("confidence").alias("confidence"))
    out = questions.select("question_id").join(g, "question_id", "left")
    name = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.coalesce("worst", F.lit(len(CLASSES))).cast("int"))
    return out.select("question_id", name.alias("mapping_class"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def overlap_class(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (question_id, overlap): EXACT, PARTIAL or NONE between two lists of chunk ids, INVALID where one is empty."""
    j = old.select("question_id", F.col("chunk_ids").alias("o")).join(new.select("question_id", F.col("chunk_ids").alias("n")), "question_id", "full_outer")
    both = F.size(F.array_intersect("o", "n"))
    empty = F.coalesce(F.size("o") == 0, F.lit(True)) | F.coalesce(F.size("n") == 0, F.lit(True))
    return j.select("question_id", F.when(empty, "INVALID").when(F.array_sort("o") == F.array_sort("n"), "EXACT").when(both > 0, "PARTIAL").otherwise("NONE").alias("overlap"))


def hard_negatives(positives: DataFrame, chunks: DataFrame, questions: DataFrame, limit: int = 16) -> DataFrame:
    """Rows (question_id, chunk_id, negative_type, overlap, distance, position): chunks of a positive's context that do not overlap it and have another path.

    positives (question_id, chunk_id), chunks (chunk_id, context_id, path, start, end, text), questions (question_id, question). Ordered by type,
    larger lexical overlap of term values, nearness, id.
    """
    p = positives.join(chunks.select("chunk_id", "context_id", F.col("path").alias("pp"), F.col("start").alias("ps"), F.col("end").alias("pe")), "chunk_id").withColumnRenamed("chunk_id", "positive_id")
    j = p.join(chunks, "context_id").join(positives, ["question_id", "chunk_id"], "left_anti")
    j = j.where((F.greatest("ps", "start") >= F.least("pe", "end")) & (F.col("pp") != F.col("path")))

    def differ(kind):
        return _ordinal(F.col("pp"), kind) != _ordinal(F.col("path"), kind)

    kind = F.when(differ("article"), 2).when(differ("clause"), 1).when((_ordinal(F.col("pp"), "article") == _ordinal(F.col("path"), "article")) & (_ordinal(F.col("pp"), "clause") == _ordinal(F.col("path"), "clause")) & differ("point"), 0).otherwise(3)
    g = j.groupBy("question_id", "chunk_id").agg(F.min(kind).alias("k"), F.min(F.abs(F.col("start") - F.col("ps"))).alias("distance"))
    q = questions.select("question_id", F.array_distinct(tx.terms(F.col("question"))).alias("qt"))
    g = g.join(q, "question_id").join(chunks.select("chunk_id", F.array_distinct(tx.terms(F.col("text"))).alias("ct")), "chunk_id").withColumn("overlap", F.size(F.array_intersect("qt", "ct")))
    order = Window.partitionBy("question_id").orderBy("k", F.col("overlap").desc(), "distance", "chunk_id")
    out = g.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return out.select("question_id", "chunk_id", F.element_at(F.array(*[F.lit(n) for n in NEGATIVES]), F.col("k") + 1).alias("negative_type"), "overlap", "distance", "position")


def pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Rows (question_id, positive_id, negative_id): each positive with each negative of its question; both lists are bounded."""
    return positives.select("question_id", F.col("chunk_id").alias("positive_id")).join(negatives.select("question_id", F.col("chunk_id").alias("negative_id")), "question_id")


def sft_rows(questions: DataFrame, evidence: DataFrame, chunks: DataFrame, template: str = "Question: {question}\nEvidence:\n{evidence}\nAnswer: ") -> DataFrame:
    """Rows (example_id, question_id, prompt, target): gold answers with their selected evidence in order. evidence: question_id, chunk_id, position."""
    e = evidence.join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("evidence"))
    j = questions.where(F.col("answer").isNotNull()).join(e, "question_id")
    return j.select(tx.content_id("sft_", F.concat_ws("\n", F.lit("rag-sft.v1"), "question_id")).alias("example_id"), "question_id", tx.rendered(template, question=F.col("question"), evidence=F.col("evidence")).alias("prompt"), F.col("answer").alias("target"))


def policy_violations(rows: DataFrame) -> DataFrame:
    """One row of counts over rows (partition, generated, task, target, version); any above zero, or several versions, rejects the whole set."""
    return rows.agg(F.count_if(F.col("partition") != "train").alias("not_train"), F.count_if(F.col("generated")).alias("generated_text"), F.count_if(F.col("target").isNull() | (F.col("target") == "")).alias("empty_target"), F.count_distinct("version").alias("versions"))


def enforce(rows: DataFrame, bad, code: str) -> DataFrame:
    """rows, failing with code as soon as one is bad."""
    return rows.where(F.when(bad, F.raise_error(F.lit(code)).cast("boolean")).otherwise(F.lit(True)))


def adjudication_sample(rows: DataFrame, seed: str, percent: int = 20) -> DataFrame:
    """The ceiling of percent of the rows (id), those with the smallest digest."""
    n = -(-rows.count() * percent // 100)
    return rows.orderBy(F.sha2(F.concat(F.lit(seed + "\n"), F.col("id").cast("string")).cast("binary"), 256)).limit(n)


def upsert(base: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the highest version."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return base.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prefilled(queue: DataFrame, labelled: DataFrame, fields: list[str], label: str) -> DataFrame:
    """queue with the label of a row that equals it in every field, nulls included."""
    on = [queue[f].eqNullSafe(labelled[f]) for f in fields]
    return queue.join(labelled.select(*fields, label).dropDuplicates(fields), on, "left").select(*[queue[c] for c in queue.columns], labelled[label])


def audit_parameters(tensors: DataFrame, limit: int = 4_000_000_000) -> DataFrame:
    """One row (total, trainable, adapters, within_limit) of tensors (name, shape, trainable, adapter); limit is exclusive."""
    numel = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    t = tensors.withColumn("n", numel).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("trainable"), F.col("n")).otherwise(0)).alias("trainable"), F.sum(F.when(F.col("adapter"), F.col("n")).otherwise(0)).alias("adapters"))
    return t.withColumn("within_limit", F.col("total") < limit)
