"""Packing of tokenised training rows into sequences of one length, with loss masks and boundaries.

Only the histogram of row lengths, at most one count for each length, comes to the driver. It is used up greedily: a sequence takes the longest rows that still fit, one after the other, and
this pattern is repeated as long as all its lengths last. So the plan is a short list of runs: rows of one length, numbered within it, go to the sequences of a run. The
rows are numbered by their length, a hash of their id, and the id, find their run by a join on the length, and meet their sequence's others in a group that is no longer
than a sequence. No row is cut or split between sequences, and the result does not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.materialize import written
from corpusloom.plans.numbering import numbered

#: fixed value: the label of tokens without loss.
IGNORED = -100


def trimmed(rows: DataFrame, length: int) -> DataFrame:
    """Rows (example_id, ids, labels) of rows (example_id, prompt, target), arrays of token ids: a prompt keeps its last tokens that fit before the target, which alone has loss.

    A target that is empty, or as long as a sequence, is an error; nulls are empty.
    """
    empty = F.array().cast("array<int>")
    t, p = F.coalesce("target", empty), F.coalesce("prompt", empty)
    bad = rows.select("example_id", F.size(t).alias("n")).where((F.col("n") == 0) | (F.col("n") >= length)).take(1)
    if bad:
        raise ValueError(f"GENERATOR_TARGET_{'TOO_LONG' if bad[0]['n'] else 'EMPTY'}: {bad[0]['example_id']}")
    room = F.lit(length) - F.size(t)
    kept = F.when(F.size(p) > room, F.slice(p, F.size(p) - room + 1, room)).otherwise(p)
    told = rows.select("example_id", kept.alias("prompt"), t.alias("target"))
    return told.select("example_id", F.concat("prompt", "target").alias("ids"), F.concat(F.transform("prompt", lambda _: F.lit(IGNORED)), "target").alias("labels"))


def runs(histogram: dict[int, int], length: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row length, first row, rows, first sequence, rows of a sequence, place of the first of them): how rows of each length go to sequences, longest first."""
    left, given = {n: c for n, c in histogram.items() if c}, dict.fromkeys(histogram, 0)
    out, sequence = [], 0
    while left:
        room, pattern = length, []
        for n in sorted(left, reverse=True):
            if (many := min(left[n], room // n)) > 0:
                pattern.append((n, many))
                room -= many * n
        if not pattern:
            raise ValueError("a row is longer than a sequence")
        times, slot = min(left[n] // many for n, many in pattern), 0
        for n, many in pattern:
            out.append((n, given[n], many * times, sequence, many, slot))
            given[n] += many * times
            left[n] -= many * times
            if not left[n]:
                del left[n]
            slot += many
        sequence += times
    return out


def placed(rows: DataFrame, length: int) -> DataFrame:
    """rows (example_id, ids, labels) with the sequence and the slot of each; sequences and slots are gapless from 0. Ids must be unique."""
    sized = rows.withColumn("size", F.size("ids").cast("long"))
    if sized.where(F.col("example_id").isNull() | (F.col("size") < 1) | (F.col("size") > length)).take(1) or rows.groupBy("example_id").count().where("count > 1").take(1):
        raise ValueError("examples must have unique ids and between one token and a sequence of them")
    order = numbered(sized, "size", F.xxhash64("example_id"), "example_id", name="place")
    classes = written(order.groupBy(F.col("size").alias("n")).agg(F.min("place").alias("least"), F.count("*").alias("many")), "packing-classes")
    plan = runs({r["n"]: r["many"] for r in classes.collect()}, length)
    told = rows.sparkSession.createDataFrame(plan, "n long, first long, many_rows long, sequence long, per long, slot long")
    starts = classes.select("n", "least")
    met = order.join(F.broadcast(starts), F.col("size") == F.col("n")).withColumn("k", F.col("place") - F.col("least")).drop("n", "least")  # a row for each length
    at = F.col("k") - F.col("first")
    met = met.join(F.broadcast(told), (F.col("size") == F.col("n")) & (F.col("k") >= F.col("first")) & (F.col("k") < F.col("first") + F.col("many_rows")))
    return met.select(*rows.columns, (F.col("sequence") + F.floor(at / F.col("per"))).alias("sequence"), (F.col("slot") + at % F.col("per")).alias("slot"))


def packed(rows: DataFrame, length: int) -> DataFrame:
    """Rows (sequence, example_ids, ids, labels, ends): all tokens of a sequence's examples, in the order of slots, and where each example ends."""
    some = F.array_sort(F.collect_list(F.struct("slot", "example_id", "ids", "labels")))
    whole = placed(rows, length).groupBy("sequence").agg(some.alias("x"))
    part = lambda c: F.flatten(F.transform("x", lambda e: e[c]))
    sizes = F.transform("x", lambda e: F.size(e["ids"]))
    ends = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda s, n: s + n))
    return whole.select("sequence", F.transform("x", lambda e: e["example_id"]).alias("example_ids"), part("ids").alias("ids"), part("labels").alias("labels"), ends.alias("ends"))


def report(sequences: DataFrame, length: int) -> DataFrame:
    """One row (sequences, examples, tokens, loss_tokens, fill): fill is the share of all places that hold a token."""
    loss = F.size(F.filter("labels", lambda x: x != IGNORED))
    out = sequences.agg(F.count("*").alias("sequences"), F.coalesce(F.sum(F.size("example_ids")), F.lit(0)).alias("examples"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(loss), F.lit(0)).alias("loss_tokens"))
    return out.withColumn("fill", F.when(F.col("sequences") > 0, F.col("tokens") / (F.col("sequences") * length)))
