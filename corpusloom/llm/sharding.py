"""Sharding by longest-processing-time scheduling, exact at any size.

Documents of equal text form a group that must stay together; groups sorted by size go, largest first, to
the least-loaded shard. That rule sees only sizes: so the driver schedules the histogram of group sizes, not
the groups. The distinct sizes are at most about the square root of twice the corpus's bytes; they reach the driver one by one in
their order and leave it as a table, PLANNED rows at a time, so it holds the loads and no histogram. A run of
equal sizes is dealt by one computation on the heap's loads, which gives each shard as many groups as the
heap would have. Groups then take their shard from their rank within their size, and ranks and
slots are built from counts per cell, so no task ever numbers more than a cell.

A null text is empty. Repeated rows are separate rows of one group. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm.common import table
from corpusloom.plans.materialize import fresh_path, written

SHARDS = 16
#: Rows that one task numbers at most, about.
CELL = 50_000
#: Sizes whose shares the driver writes at once.
PLANNED = 100_000


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of count groups of one size each shard gets if every group goes to the least-loaded shard, ties to the first.

    Changes loads. Short runs go through the heap one by one; for long ones the level that the heap would reach is searched for.
    """
    got = [0] * len(loads)
    if count <= 4 * len(loads):
        heap = [(load, i) for i, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, i = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (load + size, i))
    else:
        below = lambda level: [max(0, -(-(level - load) // size)) for load in loads]  # noqa: E731  groups that would start under the level
        lo, hi = min(loads), max(loads) + size * (count // len(loads) + 2)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if sum(below(mid)) >= count else (mid + 1, hi)
        got = below(lo)
        extra = sum(got) - count
        for i in range(len(loads) - 1, -1, -1):  # the last to start at the level itself, counted from the back
            if extra and got[i] and loads[i] + (got[i] - 1) * size == lo - 1:
                got[i] -= 1
                extra -= 1
    for i, n in enumerate(got):
        loads[i] += n * size
    return got


def numbered(df: DataFrame, by: list[str], order: list[str], cells: int, name: str) -> DataFrame:
    """df with a gapless number from 0 within each value of by, through counts per cell of the hashed order."""
    df = df.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    offsets = df.groupBy(*by, "cell").agg(F.count("*").alias("n"))
    offsets = offsets.withColumn("before", F.sum("n").over(Window.partitionBy(*by).orderBy("cell")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy(*by, "cell").orderBy(*order)) - 1
    return df.withColumn("within", within).join(offsets, [*by, "cell"]).withColumn(name, F.col("before") + F.col("within")).drop("cell", "within", "before")


def planned(sizes: DataFrame, shards: int) -> DataFrame:
    """Rows (gsize, ends) of the histogram (gsize, n): of the groups of a size, those of rank under ends[i], and not under ends[i - 1], go to shard i."""
    spark, path = sizes.sparkSession, fresh_path(sizes.sparkSession, "lpt-plan")
    kind = T.StructType([T.StructField("gsize", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    loads, plan = [0] * shards, []
    spark.createDataFrame(plan, kind).write.parquet(path)
    for row in sizes.orderBy(F.desc("gsize")).toLocalIterator():
        plan.append((row["gsize"], list(accumulate(deal(loads, row["gsize"], row["n"])))))
        if len(plan) == PLANNED:
            spark.createDataFrame(plan, kind).write.mode("append").parquet(path)
            plan = []
    if plan:
        spark.createDataFrame(plan, kind).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of docs; law is always `bytes`.

    size is the text's UTF-8 bytes plus 1; slot numbers a shard's rows without gaps.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    d = written(d, "lpt-rows")
    key = ["h", "text_crc32", "size"]
    groups = d.groupBy(*key).agg((F.count("*") * F.col("size")).alias("gsize"))
    groups = written(groups, "lpt-groups")
    sizes = written(groups.groupBy("gsize").agg(F.count("*").alias("n")).orderBy(F.desc("gsize")), "lpt-sizes")
    plan = planned(sizes, shards)
    most, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    most, rows = most or 0, rows or 0
    ranked = numbered(groups, ["gsize"], key[:2], max(1, -(-most // CELL)), "rank")
    placed = ranked.join(plan, "gsize").select(*key, F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    out = written(d.join(placed, key), "lpt-placed")
    rows = max(rows, out.count())
    out = numbered(out, ["shard"], ["doc_id", "h"], max(1, -(-rows // (CELL * shards))), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
