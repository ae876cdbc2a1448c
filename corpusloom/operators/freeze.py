"""Frozen aliases: an artifact whose every row proves itself against the passages.

An alias names a context by a document number that stands in its passage. Proposals are made from the passages; a freeze takes approved ones, checks them by joins, and writes

* `aliases`: the rows in canonical order (key and number by bytes, context by number), each with its place;
* `links`: for each run of BLOCK places the digest of its rows in order, chained to the run before;
* `manifest`: one row with the count, the last link, the versions and a checksum of the corpus.

An opened artifact is compared with all of it, and every row has to rebuild its number from the offsets in its passage. Nothing is derived anew, so questions
resolve by what was approved. Rows are only joined and grouped by place or context; the driver sees a link for each BLOCK rows.
"""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.plans.numbering import numbered

VERSION, BLOCK = "aliases.v1", 4096
ALIAS = ["document_number", "document_number_key", "context_id", "source_kind", "canonical_start", "canonical_end", "review_state"]


def proposed(contexts: DataFrame, find=tx.document_numbers, key=tx.document_number_key, head: int = 256) -> DataFrame:
    """Proposals (the columns of ALIAS) of contexts (context_id, passage): those whose first head code points hold numbers of one key only, by its first occurrence.

    find gives the numbers of a text, key what makes two of them alike.
    """
    start = F.substring("passage", 1, head)
    told = contexts.select(F.col("context_id").cast("string").alias("context_id"), start.alias("head"), find(start).alias("found"))
    one = told.where(F.size(F.array_distinct(F.transform("found", key))) == 1)
    number = F.get("found", F.lit(0))
    at = F.call_function("locate", number, F.col("head"))
    return one.select(number.alias("document_number"), key(number).alias("document_number_key"), "context_id", F.lit("passage_header").alias("source_kind"), (at - 1).alias("canonical_start"), (at - 1 + F.length(number)).alias("canonical_end"), F.lit("proposed").alias("review_state"))


def approval(proposals: DataFrame) -> dict:
    """What an approval states of proposals: their count and a checksum that does not depend on their order."""
    row = proposals.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*ALIAS).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
    return {"count": row["n"], "checksum": row["s"]}


def corpus_checksum(contexts: DataFrame) -> str:
    row = contexts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.col("context_id").cast("string"), "passage").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
    return f"{row['n']}:{row['s']}"


def _fail(df: DataFrame, bad: Column, code: str) -> None:
    found = df.where(F.coalesce(bad, F.lit(True))).take(1)
    if found:
        raise ValueError(f"{code}: {found[0]['document_number']} of context {found[0]['context_id']}")


def _proved(aliases: DataFrame, contexts: DataFrame, key) -> None:
    """Every alias names one context that is there and not blank, has the key of its number, and rebuilds the number from its offsets."""
    _fail(aliases, F.col("document_number_key") != key(F.col("document_number")), "ALIAS_KEY_INVALID")
    known = contexts.select(F.col("context_id").cast("string").alias("context_id"), "passage")
    twice = known.groupBy("context_id").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"ALIAS_CONTEXT_DUPLICATE: {twice[0]['context_id']}")
    met = aliases.join(known, "context_id", "left")
    _fail(met, ~F.coalesce(F.col("passage").rlike(r"\S"), F.lit(False)), "ALIAS_CONTEXT_INVALID")
    there = F.substring(F.col("passage"), F.col("canonical_start") + 1, F.col("canonical_end") - F.col("canonical_start"))
    inside = (F.col("canonical_start") >= 0) & (F.col("canonical_end") > F.col("canonical_start")) & (F.col("canonical_end") <= F.length("passage"))
    _fail(met.where("source_kind = 'passage_header'"), ~(inside & (there == F.col("document_number"))), "ALIAS_PROVENANCE_INVALID")


def _links(aliases: DataFrame) -> list[tuple[int, str, str]]:
    """(block, digest, chained digest) of aliases with places, in order."""
    row = F.sha2(F.to_json(F.struct("place", *ALIAS)), 256)
    blocks = aliases.groupBy(F.floor(F.col("place") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", row.alias("d")))).alias("rows"))
    found = blocks.select("block", F.sha2(F.concat_ws("", F.transform("rows", lambda x: x["d"])), 256).alias("digest")).orderBy("block").collect()
    out, before = [], ""
    for r in found:
        before = hashlib.sha256(f"{before}{r['block']}:{r['digest']}".encode()).hexdigest()
        out.append((r["block"], r["digest"], before))
    return out


def freeze(proposals: DataFrame, contexts: DataFrame, path: str, approved: dict, key=tx.document_number_key) -> dict:
    """Writes the artifact of proposals at a path that must not exist, if they are those that were approved and prove themselves; its manifest."""
    spark = proposals.sparkSession
    if approval(proposals) != approved:
        raise ValueError("ALIAS_APPROVAL_MISMATCH")
    told = proposals.select(*ALIAS)
    _fail(told.groupBy(*ALIAS).count(), F.col("count") > 1, "ALIAS_RECORD_DUPLICATE")
    _proved(told, contexts, key)
    order = [F.col("document_number_key"), F.col("context_id").cast("long"), F.col("document_number"), F.col("context_id")]
    placed = numbered(told.withColumn("review_state", F.lit("approved")), *order, name="place")
    placed.select("place", *ALIAS).write.parquet(f"{path}/aliases")
    links = _links(spark.read.parquet(f"{path}/aliases"))
    spark.createDataFrame(links, "block long, digest string, prefix string").coalesce(1).write.parquet(f"{path}/links")
    manifest = {"version": VERSION, "unicode": unicodedata.unidata_version, "rows": approved["count"], "prefix": links[-1][2] if links else "", "corpus": corpus_checksum(contexts)}
    spark.createDataFrame([tuple(manifest.values())], "version string, unicode string, rows long, prefix string, corpus string").coalesce(1).write.parquet(f"{path}/manifest")
    return manifest


def open_frozen(spark: SparkSession, path: str, contexts: DataFrame, key=tx.document_number_key) -> DataFrame:
    """The aliases of an artifact, verified; a ValueError with its code where the corpus is another, a row, its order or an offset was altered, or a link is missing."""
    manifest = spark.read.parquet(f"{path}/manifest").first()
    if (manifest["version"], manifest["unicode"]) != (VERSION, unicodedata.unidata_version) or manifest["corpus"] != corpus_checksum(contexts):
        raise ValueError("ALIAS_MANIFEST_MISMATCH")
    aliases = spark.read.parquet(f"{path}/aliases")
    places = aliases.agg(F.count("*").alias("n"), F.count_distinct("place").alias("d"), F.max("place").alias("m")).first()
    if places["n"] != manifest["rows"] or places["d"] != places["n"] or (places["n"] and places["m"] != places["n"] - 1):
        raise ValueError("ALIAS_MANIFEST_MISMATCH")
    here, then = (aliases.select((F.col("place") + shift).alias("place"), F.struct("document_number_key", F.col("context_id").cast("long"), "document_number", "context_id").alias(name)) for shift, name in ((1, "a"), (0, "b")))
    if here.join(then, "place").where("a > b").take(1):
        raise ValueError("ALIAS_ORDER_INVALID")
    links = _links(aliases)
    stored = [tuple(r) for r in spark.read.parquet(f"{path}/links").orderBy("block").collect()]
    if links != stored or (links[-1][2] if links else "") != manifest["prefix"]:
        raise ValueError("ALIAS_CHECKSUM_MISMATCH")
    _proved(aliases, contexts, key)
    return aliases.select(F.col("document_number_key").alias("document_key"), *ALIAS, "place")
