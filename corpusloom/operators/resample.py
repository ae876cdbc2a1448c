"""Bootstrap means in parallel: the draws of one seeded generator, cut into slices that tasks make for themselves.

Resample r of n rows takes n row numbers, one after the other, from the generator `Generator(PCG64(sha256(seed))).integers(0, n)`. Each number comes from one 32-bit
draw d as (d * n) >> 32, unless the low half of the product is below 2**32 mod n: then the draw is skipped. Whether a draw is skipped depends on it alone, so a task can jump to
its slice of draws, count those that stay, and, once the counts before it are known, tell which resample each belongs to. Rows come in blocks; a task adds up, for one slice and one
block, what the slice draws from the block. So neither all rows nor all draws are ever in one place, and the figures are those of a single loop.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.plans.materialize import written
from corpusloom.plans.numbering import numbered

#: Draws of a slice, rows of a block.
DRAWS, ROWS = 1 << 23, 1 << 19


def _generator(seed: str) -> np.random.PCG64:
    return np.random.PCG64(int.from_bytes(hashlib.sha256(seed.encode()).digest(), "big"))


def _drawn(seed: str, part: int, n: int) -> np.ndarray:
    """The row numbers that a slice of DRAWS 32-bit draws gives, skipped ones left out."""
    source = _generator(seed)
    source.advance(part * DRAWS // 2)
    raw = source.random_raw(DRAWS // 2)
    halves = np.empty(DRAWS, np.uint64)
    halves[0::2], halves[1::2] = raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)
    product = halves * np.uint64(n)
    return (product >> np.uint64(32))[(product & np.uint64(0xFFFFFFFF)) >= np.uint64((2**32 - n) % n)].astype(np.int64)


def _counted(seed: str, n: int):
    def run(batches):
        for b in batches:
            parts = b.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([len(_drawn(seed, p, n)) for p in parts], pa.int64())], names=["slice", "kept"])

    return run


def _summed(seed: str, n: int, resamples: int, width: int):
    def run(batches):
        for b in batches:
            for part, before, first, raw in zip(*[b.column(c).to_pylist() for c in ("slice", "before", "first", "raw")]):
                values = np.frombuffer(raw, "<f8").reshape(-1, width)
                drawn = _drawn(seed, part, n)[: max(0, resamples * n - before)]
                resample = (before + np.arange(len(drawn))) // n
                mine = (drawn >= first) & (drawn < first + len(values))
                at, resample = drawn[mine] - first, resample[mine]
                low = int(resample[0]) if len(resample) else 0
                sums = np.stack([np.bincount(resample - low, weights=values[at, j]) for j in range(width)], axis=1) if len(at) else np.empty((0, width))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, width), pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(low + np.arange(len(sums)), pa.int64()), lists], names=["resample", "sums"])

    return run


def _packed(width: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("n")
        values = np.stack([group.column(f"v{j}").to_numpy() for j in range(width)], axis=1)
        return pa.table({"first": pa.array([group.column("n")[0].as_py()], pa.int64()), "raw": pa.array([values.astype("<f8").tobytes()], pa.binary())})

    return run


def resampled(rows: DataFrame, columns: list[str], seed: str, resamples: int, id_col: str = "id") -> DataFrame:
    """Rows (resample, one mean for each column) of rows (id, columns) in the order of ids; numbers only, nulls are an error. No rows, no resamples."""
    spark, width = rows.sparkSession, len(columns)
    told = numbered(rows.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(columns)]), "id")
    n = told.count()
    if n >= 1 << 32:
        raise ValueError("more rows than a 32-bit draw can choose from")
    if told.where(" OR ".join(f"v{j} IS NULL" for j in range(width))).take(1):
        raise ValueError("nulls cannot be resampled")
    means = ", ".join(f"{c} double" for c in columns)
    if not n:
        return spark.createDataFrame([], f"resample long, {means}")
    blocks = written(told.groupBy(F.floor(F.col("n") / ROWS).alias("block")).applyInArrow(_packed(width), "first long, raw binary"), "resample-blocks")
    kept = 1 - ((2**32 - n) % n) / 2**32
    total = resamples * n
    slices = math.ceil((total / kept + 8 * math.sqrt(total / kept) + 64) / DRAWS)
    counts = written(spark.range(slices).repartition(min(slices, 10_000)).mapInArrow(_counted(seed, n), "slice long, kept long"), "resample-counts")
    before = F.coalesce(F.sum("kept").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for 2**23 draws
    placed = counts.select("slice", before.alias("before"), "kept").where(F.col("before") < total)
    if counts.agg(F.sum("kept")).first()[0] < total:
        raise RuntimeError("too few draws stayed")
    pairs = placed.repartition(min(slices, 10_000), "slice").crossJoin(blocks)  # each slice has draws from each block
    sums = pairs.mapInArrow(_summed(seed, n, resamples, width), "resample long, sums array<double>")
    return sums.groupBy("resample").agg(*[(F.sum(F.col("sums")[j]) / n).alias(c) for j, c in enumerate(columns)])


def interval(pairs: DataFrame, seed: str, resamples: int = 10_000) -> DataFrame:
    """One row (n, delta, low, high): the mean paired difference of pairs (id, base, new) and its 95 percent interval, linear quantiles. No row without pairs."""
    d = pairs.select("id", (F.col("new").cast("double") - F.col("base").cast("double")).alias("d"))
    means = resampled(d, ["d"], seed, resamples).agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = d.agg(F.count("*").alias("n"), F.avg("d").alias("delta")).where("n > 0")
    return whole.crossJoin(means).select("n", "delta", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))  # two tables of one row


def aggregated(scores: DataFrame, columns: list[str], seed: str, resamples: int = 1000, confidence: float = 0.95) -> DataFrame:
    """Rows (score, low, mid, high): percentiles of the resampled means of each column of scores (id, columns)."""
    tail = (1 - confidence) / 2
    means = resampled(scores, columns, seed, resamples)
    told = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.*")
    q = told.groupBy("score").agg(F.percentile("v", F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail))).alias("q"))
    return q.select("score", *[F.col("q")[i].alias(name) for i, name in enumerate(("low", "mid", "high"))])
