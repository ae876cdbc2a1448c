"""Sinks: immutable tables, checksums of tables and files, canonical JSON, submissions."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


class SinkError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def table_checksum(df: DataFrame) -> str:
    """A checksum of a table's rows that their order does not change: the sum of 128 bits of each row's SHA-256, with the row count."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{i}") for i in range(4)]
    r = df.agg(F.count("*").cast("string").alias("n"), *parts).first()
    return "rows:" + ":".join(x or "0" for x in r)


def write_immutable(df: DataFrame, path: str) -> None:
    """Writes a table once: the same rows again are accepted, others raise ARTIFACT_IMMUTABLE."""
    spark = df.sparkSession
    try:
        df.write.mode("errorifexists").parquet(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        if table_checksum(spark.read.parquet(path).select(*df.columns)) != table_checksum(df):
            raise SinkError("ARTIFACT_IMMUTABLE", path) from e


def file_set_checksum(files: DataFrame) -> DataFrame:
    """One row (files, bytes, checksum) of a binaryFile table, in order of names, each with its length."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    line = F.struct(name.alias("name"), F.concat_ws(":", name, F.col("length").cast("string"), F.sha2("content", 256)).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
    return files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), tx.checksum(joined).alias("checksum"))


def canonical_json(value) -> bytes:
    """Sorted keys, no spaces, one final line feed; numbers must be finite."""
    return (json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False) + "\n").encode("utf-8")


def content_json(df: DataFrame) -> DataFrame:
    """Rows (json) with sorted keys."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def validate_submission(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """One row (rows, missing, unknown, duplicates, empty) of answers (question_id, answer) against expected (question_id)."""
    a = answers.agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct("question_id")).alias("duplicates"), F.count_if(F.coalesce(F.trim("answer"), F.lit("")) == "").alias("empty"))
    missing = expected.join(answers, "question_id", "left_anti").agg(F.count("*").alias("missing"))
    unknown = answers.join(expected, "question_id", "left_anti").agg(F.count("*").alias("unknown"))
    return a.crossJoin(missing).crossJoin(unknown).select("rows", "missing", "unknown", "duplicates", "empty")  # three tables of one row


def submission(answers: DataFrame, expected: DataFrame, limit: int = 1_000_000) -> bytes:
    """The submission object of at most limit answers in the order of expected (question_id, position)."""
    check = validate_submission(answers, expected.select("question_id")).first()
    if check["rows"] > limit:
        raise SinkError("SUBMISSION_SIZE", str(check["rows"]))
    if check["missing"] or check["unknown"] or check["duplicates"] or check["empty"]:
        raise SinkError("SUBMISSION_INVALID", str(check.asDict()))
    rows = expected.join(answers, "question_id").orderBy("position").select("question_id", "answer").collect()
    return (json.dumps({r["question_id"]: {"answer": r["answer"]} for r in rows}, ensure_ascii=False, separators=(",", ":")) + "\n").encode("utf-8")


def submission_zip(data: bytes, name: str = "results.json") -> bytes:
    """A ZIP file whose bytes depend on data alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def write_scores_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)
