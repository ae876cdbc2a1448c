"""A persistent sparse index, and retrieval of questions over it.

An index is a folder with the table `chunks`, read by column: what a chunk is, its terms in order and their number,
the table `postings`, blocks laid out by term (see `blockmax`), and the table `manifest`, one row with all that makes two indexes alike. It is written once, never changed, and
verified when it is opened. Opened postings are what `retrieve.bm25` and `retrieve.lexical` take, so no query tokenises the corpus or counts terms again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import legal
from corpusloom.functions import text as tx
from corpusloom.operators import blockmax, fuse, retrieve

VERSION = "index.v1"
COLUMNS = ["chunk_id", "context_id", "hierarchy_path", "hierarchy_kind", "hierarchy_ordinal", "text", "t", "dl"]
_CHUNK = {"chunk_id": "string", "context_id": "string", "hierarchy_path": "array<string>", "hierarchy_kind": "string", "hierarchy_ordinal": "string", "text": "string"}


def _summary(index: DataFrame) -> DataFrame:
    """One row: rows, terms, and a checksum that does not depend on the rows' order."""
    return index.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("terms"),
        F.coalesce(F.sum(F.xxhash64(*COLUMNS).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"),
    )


def _laid(blocks: DataFrame) -> DataFrame:
    """One row: blocks, pairs of a chunk and a term, and a checksum of the blocks that does not depend on their order."""
    pairs = F.coalesce(F.sum(F.octet_length("at") / 4), F.lit(0)).cast("long").alias("pairs")
    heads = F.coalesce(F.sum(F.xxhash64("names", "dl", "own").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    return blocks.agg(F.count("*").alias("blocks"), pairs, (heads + F.coalesce(F.sum(F.xxhash64("term", "at", "tf").cast("decimal(38,0)")), F.lit(0))).cast("string").alias("laid"))


def _parameters() -> dict:
    return {"version": VERSION, "token": tx.TOKEN, "k1": retrieve.K1, "b": retrieve.B}


def build_index(chunks: DataFrame, path: str) -> None:
    """Writes the index of chunks (chunk_id, context_id, hierarchy_path, hierarchy_kind, hierarchy_ordinal, text) to a path that must not exist.

    A null text has no terms. Null or repeated chunk_ids are a ValueError, found before anything is written; other columns are not read. The manifest comes last, so a
    build that was broken off cannot be opened.
    """
    told = chunks.select(*[F.col(c).cast(kind).alias(c) for c, kind in _CHUNK.items()])
    bad = told.groupBy("chunk_id").count().where("chunk_id IS NULL OR count > 1").select("chunk_id").take(1)
    if bad:
        raise ValueError(f"chunk ids must be unique and not null: {bad[0].chunk_id}")
    told.withColumn("t", tx.terms(F.col("text"))).withColumn("dl", F.size("t")).write.parquet(f"{path}/chunks")
    whole = chunks.sparkSession.read.parquet(f"{path}/chunks")
    blockmax.laid_out(whole).write.parquet(f"{path}/postings")
    summary = _summary(whole).crossJoin(_laid(chunks.sparkSession.read.parquet(f"{path}/postings")))  # two tables of one row
    summary.select("*", *[F.lit(v).alias(k) for k, v in _parameters().items()]).write.parquet(f"{path}/manifest")


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The index at path; a ValueError where its parameters are others, or its rows are not those that were written."""
    manifest = spark.read.parquet(f"{path}/manifest").first().asDict()
    index = spark.read.parquet(f"{path}/chunks")
    for name, value in _parameters().items():
        if manifest[name] != value:
            raise ValueError(f"the index has {name} {manifest[name]!r}, not {value!r}")
    found = _summary(index).first().asDict()
    for name, value in found.items():
        if manifest[name] != value:
            raise ValueError(f"the index is damaged: {name} is {value}, not {manifest[name]}")
    return index


def open_postings(spark: SparkSession, path: str) -> blockmax.Postings:
    """The postings of the index at path; a ValueError where its blocks are not those that were written."""
    manifest = spark.read.parquet(f"{path}/manifest").first().asDict()
    blocks = spark.read.parquet(f"{path}/postings")
    for name, value in _laid(blocks).first().asDict().items():
        if manifest[name] != value:
            raise ValueError(f"the index is damaged: {name} is {value}, not {manifest[name]}")
    return blockmax.of(blocks)


def chunks_of_context(index: DataFrame, context_id: str) -> DataFrame:
    """The chunks of a context; the filter reaches the scan."""
    return index.where(F.col("context_id") == context_id)


def chunks_at(index: DataFrame, kind: str | None, ordinal: str | None) -> DataFrame:
    """The chunks whose own heading has this kind and ordinal; null fits null."""
    return index.where(F.col("hierarchy_kind").eqNullSafe(F.lit(kind)) & F.col("hierarchy_ordinal").eqNullSafe(F.lit(ordinal)))


def chunks_by_ids(index: DataFrame, ids: list[str]) -> DataFrame:
    """The chunks of ids with their position in it, in its order. Repeated and missing ids are a ValueError."""
    if len(set(ids)) < len(ids):
        raise ValueError("ids repeat")
    asked = index.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], "chunk_id string, position long")
    found = index.join(asked, "chunk_id")
    if (n := found.count()) < len(ids):
        raise ValueError(f"{len(ids) - n} ids are not in the index")
    return found.orderBy("position")


def parsed_references(questions: DataFrame) -> DataFrame:
    """Rows (question_id, document_key, article, clause, point, diagnostic) of questions (question_id, question)."""
    r = questions.select("question_id", legal.reference_of(F.col("question")).alias("r")).select("question_id", "r.*")
    return r.select("question_id", tx.document_number_key(F.col("document_number")).alias("document_key"), "article", "clause", "point", "diagnostic")


def resolved(questions: DataFrame, aliases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (question_id, chunk_id, diagnostic), one for each question: the chunk that it cites, or why there is none."""
    parsed = parsed_references(questions)
    found = retrieve.resolve_exact(parsed.where("diagnostic IS NULL").drop("diagnostic"), aliases, chunks)
    return found.unionByName(parsed.where("diagnostic IS NOT NULL").select("question_id", F.lit(None).cast("string").alias("chunk_id"), "diagnostic"))


def retrieve_questions(index: DataFrame, questions: DataFrame, aliases: DataFrame, k: int = 12, postings: blockmax.Postings | None = None) -> tuple[DataFrame, DataFrame]:
    """Parses, resolves and searches questions (question_id, question): a ranking (question_id, rank, chunk_id, exact, score) and (question_id, diagnostic).

    The cited chunk, if it is one alone, comes first; the first k of BM25 follow. The ranking has no row of a question that finds nothing; the
    second table has a row of each question, its diagnostic null where its citation is resolved. Without postings they are built of the index.
    """
    exact = resolved(questions, aliases, index)
    sparse = retrieve.bm25(postings or index, questions, k)
    ranking = fuse.union_rank(exact.where("chunk_id IS NOT NULL").select("question_id", "chunk_id"), sparse.select("question_id", "chunk_id", "score"), k)
    return ranking, exact.select("question_id", "diagnostic")
