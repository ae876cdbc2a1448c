"""A store of half-precision vectors in blocks, built in waves that can be resumed, and exact search over blocks.

A block is one row: up to BLOCK ids of one part in UTF-8 order and their vectors, brought to length 1 and rounded to half precision, as bytes. `error` is the largest
distance between a vector and its rounded form, so a cosine with a vector of length 1 is off by no more than that.

A build goes part by part, in waves. After each wave the ledger gets a row for every part of it: the digest of its blocks, and the digest of the ledger so far, which binds the
order and the identity of the build. A build that was broken off goes on after the last wave in the ledger: rows behind it are written again, rows before it
are read and compared first. Another identity, among it a checksum of the vectors themselves, is refused.

A search meets blocks of vectors with blocks of queries, so one scan of the store serves any number of queries and a task holds a few blocks at a time.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 6
#: Vectors of a block, rows of a part, queries that are scored against a block at once.
BLOCK, PART, ASKED = 8192, 1 << 20, 64

_BLOCK = "part int, block int, ids array<string>, vectors binary, rows int, error double"


def _unit(rows: pa.Array) -> np.ndarray:
    n = len(rows)
    m = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if rows.null_count or n and len(m) % n or len(set(np.diff(rows.offsets.to_numpy()))) > 1:
        raise ValueError("vectors differ in dimension")
    m = m.reshape(n, -1)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    if not np.isfinite(m).all() or (norms == 0).any():
        raise ValueError("vectors must be finite and not zero")
    return m / norms


def _blocked(kind):
    """Blocks of rows (part, id, embedding) that come part by part in the order of ids; kind is the stored type."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        part, block = None, 0

        def out():
            whole = pa.Table.from_batches(held).combine_chunks()
            m = _unit(whole.column("embedding").combine_chunks())
            stored = m.astype(kind)
            error = float(np.sqrt(((m - stored.astype(np.float64)) ** 2).sum(axis=1)).max())
            columns = [pa.array([x], t) for x, t in ((part, pa.int32()), (block, pa.int32()), (whole.column("id").to_pylist(), pa.list_(pa.string())), (stored.tobytes(), pa.binary()), (len(m), pa.int32()), (error, pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "ids", "vectors", "rows", "error"])

        for b in batches:
            parts = b.column("part").to_numpy(zero_copy_only=False)
            at = 0
            while at < b.num_rows:
                if held and (parts[at] != part or sum(x.num_rows for x in held) == BLOCK):
                    yield out()
                    held, block = [], block + 1
                if parts[at] != part:
                    part, block = int(parts[at]), 0
                same = int(np.searchsorted(parts[at:], part, side="right"))
                n = min(same, BLOCK - sum(x.num_rows for x in held))
                held.append(b.slice(at, n))
                at += n
        if held:
            yield out()

    return run


def blocks(vectors: DataFrame, parts: int | None = None, kind: str = "<f8", id_col: str = "chunk_id") -> DataFrame:
    """Blocks of vectors (chunk_id, embedding), dealt to parts by their id, or as they come; kind `<f2` rounds to half precision, `<f8` keeps them."""
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(parts)) if parts else F.lit(0)
    v = vectors.select(part.cast("int").alias("part"), F.col(id_col).cast("string").alias("id"), "embedding")
    if parts:
        v = v.repartition(parts, "part").sortWithinPartitions("part", "id")
    return v.mapInArrow(_blocked(kind), _BLOCK)


# building and opening a store


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _digests(stored: DataFrame) -> DataFrame:
    """Rows (part, digest): of a part's blocks in order."""
    one = F.sha2(F.concat(F.to_json("ids").cast("binary"), "vectors"), 256)
    listed = F.array_sort(F.collect_list(F.struct("block", one.alias("d"))))
    return stored.groupBy("part").agg(F.sum("rows").alias("rows"), listed.alias("b")).select("part", "rows", F.sha2(F.concat_ws("", F.transform("b", lambda x: x["d"])), 256).alias("digest"))


def source_checksum(vectors: DataFrame, id_col: str = "chunk_id") -> str:
    """A checksum of the rows that does not depend on their order."""
    row = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.col(id_col).cast("string"), "embedding").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{row['n']}:{row['s']}"


def _chained(before: str, part: int, digest: str) -> str:
    return hashlib.sha256(f"{before}{part}:{digest}".encode()).hexdigest()


def _ledger(spark: SparkSession, path: str, name: str) -> list:
    """The ledger's rows in order, from the wave files that are whole and follow each other; a ValueError where they are another build's or do not chain."""
    rows: list = []
    while _there(spark, f"{path}/ledger/{len(rows)}/_SUCCESS"):
        wave = spark.read.parquet(f"{path}/ledger/{len(rows)}").orderBy("part").collect()
        for r in wave:
            before = rows[-1]["prefix"] if rows else ""
            if r["identity"] != name:
                raise ValueError("the store is that of another build")
            if r["part"] != len(rows) or r["prefix"] != _chained(before, r["part"], r["digest"]):
                raise ValueError("the ledger is damaged")
            rows.append(r)
    return rows


def _waves(spark: SparkSession, path: str, rows: list) -> DataFrame | None:
    """All blocks of the waves in the ledger."""
    firsts = sorted({r["wave"] for r in rows})
    return spark.read.parquet(*[f"{path}/blocks/{w}" for w in firsts]) if firsts else None


def _verified(spark: SparkSession, path: str, rows: list) -> None:
    if rows:
        found = {r["part"]: (r["rows"], r["digest"]) for r in _digests(_waves(spark, path, rows)).collect()}
        for r in rows:
            if found.get(r["part"], (0, hashlib.sha256(b"").hexdigest())) != (r["rows"], r["digest"]):
                raise ValueError(f"the store is damaged: part {r['part']} is not as it was written")


def build_store(vectors: DataFrame, path: str, identity: dict, parts: int | None = None, wave: int = 8, most_waves: int | None = None, id_col: str = "chunk_id") -> str:
    """Builds or resumes the store of vectors (chunk_id, embedding) at path; `COMPLETE`, or `INCOMPLETE` after most_waves waves.

    identity is whatever makes two builds alike, as plain values; the source's checksum, the number of parts and the layout are added to it. Ids must be
    unique and not null, vectors of one dimension, finite and not zero: a ValueError otherwise. The driver holds one ledger row for each part.
    """
    spark = vectors.sparkSession
    bad = vectors.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).take(1)
    if bad:
        raise ValueError("ids must be unique and not null")
    parts = parts or max(1, -(-vectors.count() // PART))
    told = {**identity, "source": source_checksum(vectors, id_col), "parts": parts, "wave": wave, "block": BLOCK, "layout": "f16.v1"}
    name = hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()
    rows = _ledger(spark, path, name)
    _verified(spark, path, rows)
    part_of = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(parts))
    done = 0
    while len(rows) < parts:
        if most_waves is not None and done == most_waves:
            return "INCOMPLETE"
        first = len(rows)
        mine = range(first, min(parts, first + wave))
        # a wave that was broken off before its ledger rows is written again
        blocks(vectors.where((part_of >= first) & (part_of < mine.stop)), parts, "<f2", id_col).write.mode("overwrite").parquet(f"{path}/blocks/{first}")
        found = {r["part"]: r for r in _digests(spark.read.parquet(f"{path}/blocks/{first}")).collect()}
        new = []
        for p in mine:
            digest = found[p]["digest"] if p in found else hashlib.sha256(b"").hexdigest()
            before = new[-1][3] if new else rows[-1]["prefix"] if rows else ""
            new.append((p, found[p]["rows"] if p in found else 0, digest, _chained(before, p, digest), first, name))
        spark.createDataFrame(new, "part int, rows long, digest string, prefix string, wave int, identity string").coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/{first}")
        rows = _ledger(spark, path, name)
        done += 1
    if not _there(spark, f"{path}/manifest/_SUCCESS"):
        spark.createDataFrame([(name, json.dumps(told, sort_keys=True), parts, rows[-1]["prefix"], sum(r["rows"] for r in rows))], "identity string, told string, parts int, prefix string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return "COMPLETE"


def open_store(spark: SparkSession, path: str, identity: dict | None = None) -> DataFrame:
    """The blocks of a complete store, read and compared with its ledger; a ValueError where it is incomplete, damaged, or not of this identity."""
    if not _there(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError("the store is not complete")
    manifest = spark.read.parquet(f"{path}/manifest").first()
    told = json.loads(manifest["told"])
    for k, v in (identity or {}).items():
        if told.get(k) != v:
            raise ValueError(f"the store has {k} {told.get(k)!r}, not {v!r}")
    rows = _ledger(spark, path, manifest["identity"])
    if len(rows) != manifest["parts"] or rows[-1]["prefix"] != manifest["prefix"]:
        raise ValueError("the ledger is damaged")
    _verified(spark, path, rows)
    return _waves(spark, path, rows)


# search


def _met(k: int, own: bool, kind: str):
    """The best k of a block of vectors for each query of a block, with all that its error may hide among them."""

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):  # a pair of blocks at a time
                ids, raw, rows, error, qids, qraw = (b.column(c)[at].as_py() for c in ("ids", "vectors", "rows", "error", "qids", "qvectors"))
                v, q = np.frombuffer(raw, kind).astype(np.float64).reshape(rows, -1), np.frombuffer(qraw, "<f8").reshape(len(qids), -1)
                if v.shape[1] != q.shape[1]:
                    raise ValueError("vectors differ in dimension")
                names = np.array(ids, object)
                where, who, scores = [], [], []
                for i, row in enumerate(row for low in range(0, len(q), ASKED) for row in q[low : low + ASKED] @ v.T):
                    if not own:
                        row[names == qids[i]] = -np.inf
                    least = np.partition(row, -k)[-k] - 2 * error - 2 * 10.0**-SCALE if rows > k else -np.inf
                    near = np.flatnonzero((row >= least) & np.isfinite(row))
                    where.append(near), who.append(np.full(len(near), i)), scores.append(row[near])
                where, who = np.concatenate(where), np.concatenate(who)
                columns = [pa.array(np.array(qids, object)[who], pa.string()), pa.array(names[where], pa.string()), pa.array(np.concatenate(scores), pa.float64()), pa.array(np.full(len(who), error), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["question_id", "chunk_id", "score", "error"])

    return run


def near(stored: DataFrame, queries: DataFrame, k: int = 10, own: bool = True, kind: str = "<f2") -> DataFrame:
    """Rows (question_id, chunk_id, score, error) of queries (question_id, embedding): the best k of every query by the stored vectors, and all others that may be
    among the best k by exact ones. own tells whether a vector may find itself."""
    spark = stored.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = blocks(queries, min(n, max(1, -(-queries.count() // BLOCK))), "<f8", "question_id").select(F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    # blocks with blocks: every vector has to be compared with every query asked for
    pairs = stored.select("ids", "vectors", "rows", "error").crossJoin(asked)
    found = pairs.mapInArrow(_met(k, own, kind), "question_id string, chunk_id string, score double, error double")
    order = Window.partitionBy("question_id").orderBy(F.col("low").desc())
    low = found.withColumn("low", F.col("score") - F.col("error"))
    least = low.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("question_id", F.col("low").alias("least"))
    return found.join(least, "question_id", "left").where(F.col("least").isNull() | (F.col("score") + F.col("error") >= F.col("least") - 2 * 10.0**-SCALE)).drop("least")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.round("score", SCALE).desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "rank", "chunk_id", "score")


def search(stored: DataFrame, queries: DataFrame, k: int = 10, own: bool = True, exact: DataFrame | None = None, kind: str = "<f2") -> DataFrame:
    """Rows (question_id, rank, chunk_id, score), ties in id order. With exact (chunk_id, embedding), whatever the rounding may have hidden is scored again by it, so the ranking
    is that of the exact vectors; without, it is that of the stored ones."""
    found = near(stored, queries, k, own, kind)
    if exact is None:
        return _ranked(found, k)
    unit = lambda e: F.transform(e, lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    a, b = exact.select(F.col("chunk_id").cast("string").alias("chunk_id"), unit("embedding").alias("a")), queries.select(F.col("question_id").cast("string").alias("question_id"), unit("embedding").alias("b"))
    joined = found.select("question_id", "chunk_id").join(a, "chunk_id").join(b, "question_id")
    return _ranked(joined.select("question_id", "chunk_id", (dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))).alias("score")), k)


def cosine(vectors: DataFrame, queries: DataFrame, k: int = 10, own: bool = True) -> DataFrame:
    """Exact cosine top k of vectors (chunk_id, embedding) for queries (question_id, embedding), without a store. Repeated ids take part each."""
    return search(blocks(vectors), queries, k, own, kind="<f8")


def drift(stored: DataFrame, exact: DataFrame, bound: float) -> DataFrame:
    """One row (questions, rows, changed, lost, max_delta, within): a ranking by stored vectors against the exact one. changed counts ranks with another chunk, lost the chunks
    of the exact ranking that the other lacks; within says whether no score of a shared chunk is off by more than bound."""
    a, b = stored.select("question_id", "chunk_id", F.col("score").alias("s"), F.col("rank").alias("r")), exact.select("question_id", "chunk_id", F.col("score").alias("e"), F.col("rank").alias("x"))
    both = b.join(a, ["question_id", "chunk_id"], "left")
    out = both.agg(
        F.count_distinct("question_id").alias("questions"), F.count("*").alias("rows"), F.count_if(F.col("r").isNull() | (F.col("r") != F.col("x"))).alias("changed"),
        F.count_if(F.col("r").isNull()).alias("lost"), F.max(F.abs(F.col("s") - F.col("e"))).alias("max_delta"),
    )
    return out.withColumn("within", F.coalesce(F.col("max_delta") <= bound, F.lit(True)))
