"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds one posting (tid, doc_id, th, pos) for each occurrence of a term of the test vocabulary in
the training documents. It is partitioned by document: a task writes the postings of the documents it
reads, so building needs no shuffle and a term that fills the corpus fills no partition.

A phrase query takes the two rarest terms of each window of WINDOW consecutive test words. Postings of
these terms, moved back by their offset in the item, meet on (document, item, diagonal); only diagonals on
which two lists agree are candidates, which leaves out nearly all chance hits. Candidates are then
confirmed word by word on whole items and yield all windows that occur. A proximity query asks that
all words of a window stand within a reach of its rarest term's posting, in any order; it is a function on its own
(proximity_matches), not on the path of op3, keep_clean or the pipeline, whose results are exact phrases.

Null texts have no words. An item of fewer than WINDOW words, but at least one, is one window of its own.
Repeated rows are each answered; th, the hash of the text, tells rows of one doc_id apart. Items that share
an item_id count as one item id whose windows are those of all its rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.plans.materialize import written

WINDOW = 10
#: Rows up to which a table made of benchmark text is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; an empty array for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NOT_WORD), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_terms(items: DataFrame) -> DataFrame:
    """Rows (row_id, item_id, n, ipos, term): the words of every test text."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("row_id", F.xxhash64("item_id", F.concat_ws(" ", "words"))).dropDuplicates(["row_id"])
    return rows.select("row_id", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("ipos", "term"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (tid, doc_id, th, pos) of the terms (tid, term) in documents (doc_id, th, text), written to the shared folder."""
    tokens = docs.select("doc_id", "th", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return written(tokens.join(_small(terms), "term").select("tid", "doc_id", "th", "pos"), "ii-postings")


def _windows(tokens: DataFrame, width: int) -> DataFrame:
    """Rows (row_id, start, offset, ...) for each word of each window of the items."""
    last = F.greatest(F.col("n") - width, F.lit(0))
    spots = F.sequence(F.greatest(F.col("ipos") - width + 1, F.lit(0)), F.least(F.col("ipos"), last))
    return tokens.select("*", F.explode(F.when(F.greatest(F.col("ipos") - width + 1, F.lit(0)) <= F.least(F.col("ipos"), last), spots)).alias("start"))


def phrase_candidates(postings: DataFrame, tokens: DataFrame, width: int = WINDOW) -> DataFrame:
    """Rows (doc_id, th, row_id, diag): where two rarest lists of a window agree after subtracting their offsets.

    tokens has row_id, n, ipos, tid and freq, the number of postings of tid; a word without a posting rules its windows out.
    """
    per = _windows(tokens, width).groupBy("row_id", "start", "n").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("freq", "ipos", "tid"))), 1, 2).alias("rare"), F.min("freq").alias("least")
    )
    lists = per.where("least > 0").select("row_id", "n", F.explode("rare").alias("r")).select("row_id", "n", "r.ipos", "r.tid").distinct()
    lists = written(lists, "ii-lists")
    hits = postings.join(_small(lists), "tid").select("doc_id", "th", "row_id", "n", (F.col("pos") - F.col("ipos")).alias("diag"))
    met = hits.groupBy("doc_id", "th", "row_id", "n", "diag").agg(F.count("*").alias("met"))
    return met.where("met >= least(n, 2)").select("doc_id", "th", "row_id", "diag")


def proximity_matches(postings: DataFrame, tokens: DataFrame, width: int = WINDOW, reach: int = 2 * WINDOW) -> DataFrame:
    """Rows (doc_id, th, row_id, start, pos): all words of a window, as often as it has them, stand within reach words of its rarest term at pos."""
    per = _windows(tokens, width)
    many = per.groupBy("row_id", "start").agg(F.countDistinct("tid").alias("terms"), F.min(F.struct("freq", "ipos", "tid")).alias("r"), F.min("freq").alias("least"))
    many = many.where("least > 0").select("row_id", "start", "terms", F.col("r.tid").alias("rare"))
    at = postings.join(_small(many), postings.tid == many.rare).select("doc_id", "th", "row_id", "start", "terms", "pos")
    members = per.groupBy("row_id", "start", "tid").agg(F.count("*").alias("times"))
    near = postings.withColumnRenamed("pos", "other")
    found = at.join(members, ["row_id", "start"]).join(near, ["doc_id", "th", "tid"]).where(F.abs(F.col("other") - F.col("pos")) <= reach)
    found = found.groupBy("doc_id", "th", "row_id", "start", "pos", "terms", "tid", "times").agg(F.countDistinct("other").alias("stands")).where("stands >= times")
    found = found.groupBy("doc_id", "th", "row_id", "start", "pos", "terms").agg(F.count("*").alias("seen"))
    return found.where("seen = terms").select("doc_id", "th", "row_id", "start", "pos")


def _confirmed(doc_words: Column, cands: Column, width: int) -> Column:
    """For each candidate the item and the document positions at which its windows begin."""

    def aligned(c):
        same = F.transform(c["words"], lambda w, i: F.coalesce(F.get(doc_words, c["diag"] + i) == w, F.lit(False)))
        return F.struct(c["item_id"].alias("item_id"), c["diag"].alias("diag"), same.alias("same"), F.least(F.size(c["words"]), F.lit(width)).alias("long"))

    def one(c):
        starts = F.filter(F.sequence(F.lit(0), F.size(c["same"]) - c["long"]), lambda s: F.forall(F.slice(c["same"], s + 1, c["long"]), lambda x: x))
        return F.struct(c["item_id"].alias("item_id"), F.transform(starts, lambda s: F.struct((c["diag"] + s).alias("lo"), (c["diag"] + s + c["long"]).alias("hi"))).alias("runs"))

    return F.filter(F.transform(F.transform(cands, aligned), one), lambda m: F.size(m["runs"]) > 0)


def exact_matches(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Rows (doc_id, row, n_words, runs, item_ids), one for each row of docs, which it holds whole as the struct row.

    runs are the sorted distinct (lo, hi) word positions of windows that occur, item_ids the sorted ids
    of items with occurring windows.
    """
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.struct("*").alias("row"))
    tokens = written(item_terms(items), "ii-items")
    terms = written(tokens.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "ii-terms")
    postings = build_index(d, terms)
    freq = postings.groupBy("tid").agg(F.count("*").alias("freq"))
    known = written(tokens.join(terms, "term").join(freq, "tid", "left").withColumn("freq", F.coalesce("freq", F.lit(0))), "ii-freq")
    whole = tokens.groupBy("row_id", "item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ipos", "term"))), lambda x: x["term"]).alias("words"))
    cands = phrase_candidates(postings, known, width).join(_small(whole), "row_id")
    cands = cands.groupBy(F.col("doc_id").alias("of"), F.col("th").alias("of_th")).agg(F.collect_set(F.struct("item_id", "diag", "words")).alias("cands"))
    cands = written(cands, "ii-candidates")
    # always by a shuffle: the candidates grow with the corpus, so a plan that broadcasts them holds only for small ones
    out = d.join(cands.hint("merge"), d.doc_id.eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")), "left").select("doc_id", F.col("row"), F.col("row.text").alias("text"), "cands")
    out = out.withColumn("words", words(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    none = F.array().cast("array<struct<item_id:string,runs:array<struct<lo:int,hi:int>>>>")
    out = out.withColumn("found", F.when(F.col("cands").isNull(), none).otherwise(_confirmed(F.col("words"), F.col("cands"), width)))
    return out.select(
        "doc_id", "row", "n_words",
        F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda m: m["runs"])))).alias("runs"),
        F.array_sort(F.array_distinct(F.transform("found", lambda m: m["item_id"]))).alias("item_ids"),
    )


def covered(runs: Column) -> Column:
    """Number of positions under sorted (lo, hi) runs."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, r: F.struct(F.greatest(a["end"], r["hi"]).alias("end"), (a["n"] + F.greatest(r["hi"] - F.greatest(r["lo"], a["end"]), F.lit(0))).alias("n"))
    return F.aggregate(runs, zero, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one for each row of docs."""
    found = exact_matches(docs, items, width)
    return found.select(
        "doc_id",
        "n_words",
        covered(F.col("runs")).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, in which no window of any item occurs."""
    return exact_matches(docs, items, width).where(F.size("runs") == 0).select("row.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {WINDOW}) AS n, w[s:s + least(len(w), {WINDOW}) - 1] AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, w[s:s + n - 1] AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
