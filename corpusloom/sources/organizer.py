"""Strict readers: question objects, context files, typed JSON lines; nothing is inferred and a violation fails with its code."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.functions import text as tx

# fixed values: limits of a context import
MAX_FILES, MAX_FILE, MAX_TOTAL = 10_000, 16 << 20, 1 << 30
CHUNK = "chunk_id string, context_id string, source_url string, hierarchy_path array<string>, hierarchy_rule_id string, hierarchy_kind string, hierarchy_ordinal string, canonical_start int, canonical_end int, display_text string, retrieval_text string, window_index int, chunk_checksum string, context_checksum string"
ALIAS = "schema_version string, document_number string, document_number_key string, context_id string, source_kind string, canonical_start int, canonical_end int, review_state string"


class _Problem(Exception):
    pass


def _decoded(data: bytes | None):
    """The value of a JSON document, objects as lists of pairs; a _Problem for its encoding, syntax, repeated members and numbers that are not finite."""
    try:
        text = (data or b"").decode("utf-8-sig")
    except UnicodeDecodeError:
        raise _Problem("DATA_UTF8_INVALID") from None

    def constant(_):
        raise _Problem("DATA_NON_FINITE")

    def pairs(found):
        names = [k for k, _ in found]
        if len(set(names)) < len(names):
            raise _Problem(f"DATA_DUPLICATE_KEY {next(k for i, k in enumerate(names) if k in names[:i])}")
        return dict(found)

    try:
        return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except ValueError:
        raise _Problem("DATA_JSON") from None


def _fields(row, at: str, needed: set, allowed: set) -> None:
    if not isinstance(row, dict):
        raise _Problem(f"DATA_ROOT_TYPE {at}")
    for code, names in (("DATA_FIELD_MISSING", needed - row.keys()), ("DATA_FIELD_UNKNOWN", row.keys() - allowed)):
        if names:
            raise _Problem(f"{code} {at}.{min(names)}")


def _typed(ok: bool, code: str, at: str) -> None:
    if not ok:
        raise _Problem(f"{code} {at}")


def question_problem(data: bytes | None, kind: str = "train") -> str | None:
    """What is wrong with an object of questions, as a code and the place, null if nothing. Train answers are filled strings, public ones null."""
    try:
        value = _decoded(data)
        _typed(isinstance(value, dict), "DATA_ROOT_TYPE", "$")
        for name, row in value.items():
            at = f"$[{json.dumps(name, ensure_ascii=False)}]"
            _fields(row, at, {"question", "answer"}, {"question", "answer"})
            _typed(isinstance(row["question"], str) and bool(row["question"].strip()), "DATA_QUESTION_TYPE", f"{at}.question")
            answer = row["answer"]
            _typed(isinstance(answer, str) and bool(answer.strip()) if kind == "train" else answer is None, "DATA_ANSWER_TYPE", f"{at}.answer")
    except _Problem as problem:
        return str(problem)
    return None


def context_problem(data: bytes | None, name: str | None) -> str | None:
    """What is wrong with the context of a file, null if nothing: the id is the JSON integer of the file's name, name is optional."""
    try:
        row = _decoded(data)
        _fields(row, "$", {"id", "link", "passage"}, {"id", "link", "passage", "name"})
        _typed(type(row["id"]) is int and f"context_{row['id']}.json" == name, "DATA_CONTEXT_ID_TYPE", "$.id")
        _typed(isinstance(row["link"], str), "DATA_CONTEXT_LINK_INVALID", "$.link")
        _typed(isinstance(row["passage"], str), "DATA_CONTEXT_PASSAGE_TYPE", "$.passage")
        _typed(isinstance(row.get("name", ""), str), "DATA_CONTEXT_NAME_TYPE", "$.name")
    except _Problem as problem:
        return str(problem)
    return None


@F.pandas_udf(T.StringType())
def question_problem_of(data: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([question_problem(d, k) for d, k in zip(data, kind)], dtype=object)


@F.pandas_udf(T.StringType())
def context_problem_of(data: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([context_problem(d, n) for d, n in zip(data, name)], dtype=object)


def _sound(df: DataFrame) -> DataFrame:
    """df, whose column problem is null; the first problem that is not is raised."""
    return df.where(F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("boolean")).otherwise(F.lit(True))).drop("problem")


def _require(df: DataFrame, ok: Column, code: str) -> DataFrame:
    return df.where(F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.lit(code)).cast("boolean")).otherwise(F.lit(True)))


def read_questions(spark: SparkSession, path: str, kind: str = "train") -> DataFrame:
    """Rows (question_id, source_position, source_checksum, bom, question, answer, answer_state) of a JSON object keyed by id; train answers are filled, public ones null.

    Types are those of the JSON: a number is no text. A byte order mark is accepted and told in bom. Anything else fails with a code and its place.
    """
    raw = spark.read.format("binaryFile").load(path).select("content")
    raw = _sound(raw.withColumn("problem", question_problem_of("content", F.lit(kind))))
    obj = F.from_json(F.regexp_replace(F.col("content").cast("string"), "^\uFEFF", ""), "map<string,struct<question:string,answer:string>>")
    told = [F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("source_checksum"), (F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("bom")]
    rows = raw.select(*told, F.posexplode(F.map_entries(obj)).alias("source_position", "e"))
    return rows.select(F.col("e.key").alias("question_id"), "source_position", "source_checksum", "bom", F.col("e.value.question").alias("question"), F.col("e.value.answer").alias("answer"), F.lit("gold" if kind == "train" else "unlabeled").alias("answer_state"))


def read_contexts(spark: SparkSession, directory: str) -> DataFrame:
    """Rows (context_id, source_position, source_artifact, source_checksum, name, source_url, passage, indexable, quarantine_reason) of context_*.json files.

    The id must be a JSON integer and that in the file's name, the link an absolute HTTP(S) URL; members besides id, link, passage and name, repeated members and other types fail
    with a code, their place and the file. Ids must differ. An empty passage is quarantined, not dropped.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "context_*.json").load(directory)
    limits = raw.agg(F.count("*").alias("n"), F.max("length").alias("m"), F.sum("length").alias("s")).first()
    if limits["n"] > MAX_FILES or (limits["m"] or 0) > MAX_FILE or (limits["s"] or 0) > MAX_TOTAL:
        raise ValueError("DATA_LIMITS")
    raw = raw.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    raw = _sound(raw.withColumn("problem", F.concat_ws(" ", context_problem_of("content", "file"), "file")).withColumn("problem", F.when(F.col("problem") != F.col("file"), F.col("problem"))))
    text = F.regexp_replace(F.col("content").cast("string"), "^\uFEFF", "")
    rows = raw.select("file", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("source_checksum"), F.from_json(text, "id string, link string, passage string, name string").alias("j"))
    rows = _require(rows, tx.http_url_ok(F.col("j.link")), "DATA_CONTEXT_LINK_INVALID")
    passage = tx.nfc_exact(F.coalesce("j.passage", F.lit("")))
    rows = rows.select(F.col("j.id").alias("context_id"), F.col("file").alias("source_artifact"), "source_checksum", F.col("j.name").alias("name"), F.col("j.link").alias("source_url"), passage.alias("passage"))
    blank = ~F.col("passage").rlike(r"\S")
    rows = rows.withColumns({"indexable": ~blank, "quarantine_reason": F.when(blank, "EMPTY_PASSAGE")})
    return rows.withColumn("source_position", F.row_number().over(Window.orderBy(F.col("context_id").cast("long"), "source_artifact")) - 1)  # at most MAX_FILES rows


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON lines: unknown members, missing types and broken lines fail."""
    names = {f.name for f in T._parse_datatype_string(schema).fields} if hasattr(T, "_parse_datatype_string") else set()
    lines = spark.read.text(path, lineSep="\n")
    extra = F.size(F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>"))) > 0
    lines = _require(lines, F.json_object_keys("value").isNotNull() & ~extra, "DATA_SCHEMA")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_records(spark: SparkSession, path: str, delimiter: str = "\n") -> DataFrame:
    """Rows (position, text) of a text file of delimited records."""
    return spark.read.text(path, lineSep=delimiter).select(F.monotonically_increasing_id().alias("position"), F.col("value").alias("text"))
