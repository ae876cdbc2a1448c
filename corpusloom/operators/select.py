"""Greedy selection under budgets, as folds over bounded arrays, and its calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_KEPT = "array<struct<evidence_id:string,context_id:string,path:array<string>,start:int,end:int,score:double>>"
_STATE = f"struct<kept:{_KEPT},seen:array<string>,cost:bigint,decisions:array<struct<evidence_id:string,rank:int,decision:string,reason:string>>>"


#: Cells that ratios between 0 and 1 fall into.
CELLS = 4096


def select_evidence(candidates: DataFrame, budget: int, count: int = 3, overlap: float = 0.8, relative: float | None = None) -> DataFrame:
    """Rows (question_id, evidence_id, rank, decision, reason) of candidates in rank order; a pool is at most a few hundred rows.

    candidates: question_id, rank, evidence_id, context_id, path, start, end, cost, status, role, admits (boolean), score. A rejected
    candidate uses no budget, yet its id counts as seen.
    """
    c = candidates.withColumn("context", F.col("admits") & F.col("role").isin("parent_context", "sibling_context"))
    pool = c.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "evidence_id", "context_id", "path", "start", "end", "cost", "status", "role", "context", "score"))).alias("pool"))

    def step(s: Column, x: Column) -> Column:
        same = lambda k: k["context_id"] == x["context_id"]
        common = lambda k: F.greatest(F.lit(0), F.least(k["end"], x["end"]) - F.greatest(k["start"], x["start"]))
        shorter = lambda k: F.greatest(F.lit(1), F.least(k["end"] - k["start"], x["end"] - x["start"]))
        prefix = lambda k: F.least(F.size(k["path"]), F.size(x["path"]))
        parent = lambda k: same(k) & (F.size(k["path"]) != F.size(x["path"])) & (F.slice(k["path"], F.lit(1), prefix(k)) == F.slice(x["path"], F.lit(1), prefix(k)))
        reason = (
            F.when(F.array_contains(s["seen"], x["evidence_id"]), "SKIP_DUPLICATE_ID")
            .when(x["status"] != "valid", "SKIP_INVALID_EVIDENCE")
            .when(F.exists(s["kept"], lambda k: same(k) & (k["start"] == x["start"]) & (k["end"] == x["end"])), "SKIP_DUPLICATE_SPAN")
            .when(~x["context"] & F.exists(s["kept"], parent), "SKIP_PARENT_CHILD_REDUNDANCY")
            .when(~x["context"] & F.exists(s["kept"], lambda k: same(k) & (common(k) / shorter(k) >= overlap)), "SKIP_EXCESSIVE_OVERLAP")
            .when(F.size(s["kept"]) >= count, "SKIP_LOW_INCREMENTAL_COVERAGE")
            .when(~x["context"] & F.exists(s["kept"], lambda k: same(k) & (k["path"] == x["path"])), "SKIP_LOW_INCREMENTAL_COVERAGE")
        )
        if relative is not None:
            lead = F.get(s["kept"], F.lit(0))["score"]
            low = lead.isNull() | (lead <= 0) | x["score"].isNull() | (F.try_divide(x["score"], lead) < relative)
            reason = reason.when((F.size(s["kept"]) > 0) & low, "SKIP_LOW_INCREMENTAL_COVERAGE")
        reason = reason.when(s["cost"] + x["cost"] > budget, "SKIP_TOKEN_BUDGET")
        taken = (
            F.when(F.size(s["kept"]) == 0, "SELECT_PRIMARY").when(x["role"] == "parent_context", "SELECT_PARENT_CONTEXT")
            .when(x["role"] == "sibling_context", "SELECT_SIBLING_CONTEXT").otherwise("SELECT_COMPLEMENTARY_COORDINATE")
        )
        item = F.array(F.struct(x["evidence_id"].alias("evidence_id"), x["context_id"].alias("context_id"), x["path"].alias("path"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["score"].cast("double").alias("score")))
        made = F.array(F.struct(x["evidence_id"].alias("evidence_id"), x["rank"].cast("int").alias("rank"), F.when(reason.isNull(), "selected").otherwise("rejected").alias("decision"), F.coalesce(reason, taken).alias("reason")))
        return F.struct(
            F.when(reason.isNull(), F.concat(s["kept"], item)).otherwise(s["kept"]).alias("kept"), F.concat(s["seen"], F.array(x["evidence_id"])).alias("seen"),
            F.when(reason.isNull(), s["cost"] + x["cost"]).otherwise(s["cost"]).cast("bigint").alias("cost"), F.concat(s["decisions"], made).alias("decisions"),
        ).cast(_STATE)

    zero = F.struct(F.array().alias("kept"), F.array().alias("seen"), F.lit(0).alias("cost"), F.array().alias("decisions")).cast(_STATE)
    return pool.select("question_id", F.inline(F.aggregate("pool", zero, step)["decisions"]))


def admit_within_budget(candidates: DataFrame, budget: int, count: int | None = None) -> DataFrame:
    """Rows (question_id, evidence_id, rank, admitted, admitted_rank, total, reason): in order, what does not fit is skipped and uses nothing.

    candidates: question_id, rank, evidence_id, cost, valid (boolean). The count limit comes before the budget.
    """
    pool = candidates.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "evidence_id", "cost", "valid"))).alias("pool"))
    kind = "struct<n:int,total:bigint,out:array<struct<evidence_id:string,rank:int,admitted:boolean,admitted_rank:int,total:bigint,reason:string>>>"

    def step(s: Column, x: Column) -> Column:
        reason = F.when(~x["valid"], "INVALID")
        if count is not None:
            reason = reason.when(s["n"] >= count, "COUNT_LIMIT")
        reason = reason.when(s["total"] + x["cost"] > budget, "TOKEN_BUDGET")
        ok = reason.isNull()
        total = F.when(ok, s["total"] + x["cost"]).otherwise(s["total"])
        n = F.when(ok, s["n"] + 1).otherwise(s["n"])
        row = F.struct(x["evidence_id"].alias("evidence_id"), x["rank"].alias("rank"), ok.alias("admitted"), F.when(ok, n).alias("admitted_rank"), total.alias("total"), reason.alias("reason"))
        return F.struct(n.alias("n"), total.alias("total"), F.concat(s["out"], F.array(row)).alias("out")).cast(kind)

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("total"), F.array().alias("out")).cast(kind)
    return pool.select("question_id", F.inline(F.aggregate("pool", zero, step)["out"]))


def bounded_oracle(candidates: DataFrame, labels: DataFrame, budget: int, count: int = 3) -> DataFrame:
    """Admission over labelled candidates only, in source order: an upper bound that is never promoted."""
    return admit_within_budget(candidates.join(labels.select("question_id", F.col("chunk_id").alias("evidence_id")).distinct(), ["question_id", "evidence_id"], "left_semi"), budget, count)


def calibrate_threshold(candidates: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Rows (threshold, tp, selected, precision, recall, f1) for relative scores of candidates (question_id, rank, score, positive).

    Thresholds are all distinct ratios to the first score, and 0 and 1. Counts at and above a threshold come from one
    cumulative pass over the ratios, not from a product of thresholds and candidates.
    """
    lead = F.first("score").over(Window.partitionBy("question_id").orderBy("rank"))
    r = candidates.select(F.round(F.when(lead > 0, F.col("score") / lead).otherwise(0.0), 9).alias("ratio"), F.col("positive").cast("int").alias("p"))
    ends = candidates.sparkSession.createDataFrame([(0.0, 0), (1.0, 0)], "ratio double, p int").select("ratio", F.lit(0).alias("n"), F.lit(0).alias("tp"))
    counts = r.groupBy("ratio").agg(F.count("*").alias("n"), F.sum("p").alias("tp")).unionByName(ends).groupBy("ratio").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    # ratios fall into cells; only the cells' sums meet in one task, and a cell has no more ratios than nine digits can tell apart
    counts = counts.withColumn("cell", F.floor(F.col("ratio") * CELLS))
    inside = Window.partitionBy("cell").orderBy(F.col("ratio").desc())
    higher = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    sums = sums.select("cell", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("n_above"), F.coalesce(F.sum("tp").over(higher), F.lit(0)).alias("tp_above"), F.sum("tp").over(Window.partitionBy()).alias("positives"))
    c = counts.withColumns({"n": F.sum("n").over(inside), "tp": F.sum("tp").over(inside)}).join(F.broadcast(sums), "cell")
    c = c.select("ratio", (F.col("n") + F.col("n_above")).alias("selected"), (F.col("tp") + F.col("tp_above")).alias("tp"), "positives")
    f1 = F.when(F.col("selected") + F.col("positives") > 0, 2 * F.col("tp") / (F.col("selected") + F.col("positives"))).otherwise(0.0)
    return c.select(
        F.col("ratio").alias("threshold"), "tp", "selected", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("selected")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("positives")), F.lit(0.0)).alias("recall"), f1.cast("double").alias("f1"),
    )


def best_threshold(calibration: DataFrame) -> DataFrame:
    """The threshold of the largest F1, the higher one in a tie."""
    return calibration.agg(F.max(F.struct(F.round("f1", 12).alias("f1"), "threshold")).alias("b")).select("b.threshold", "b.f1")


def mine_by_coverage(candidates: DataFrame, least: float = 0.5, count: int = 3, pool: int = 8) -> DataFrame:
    """Rows (question_id, evidence_id, position, gain): greedy choice of the candidate that covers most answer terms not yet covered.

    candidates: question_id, evidence_id, support (double), coverage (double), covered (array of answer terms). The pool is the first by coverage.
    """
    order = Window.partitionBy("question_id").orderBy(F.round("coverage", 9).desc(), "evidence_id")
    c = candidates.where(F.col("support") >= least).withColumn("k", F.row_number().over(order)).where(F.col("k") <= pool)
    rows = c.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("k", "evidence_id", "covered"))).alias("pool"))
    kind = "struct<terms:array<string>,out:array<struct<evidence_id:string,position:int,gain:int>>>"
    zero = F.struct(F.array().alias("terms"), F.array().alias("out")).cast(kind)

    def step(pool_col):
        def one(s, i):
            gains = F.transform(pool_col, lambda x: F.struct(F.size(F.array_except(x["covered"], s["terms"])).alias("gain"), (-x["k"]).alias("k"), x["evidence_id"].alias("evidence_id"), x["covered"].alias("covered")))
            best = F.array_max(gains)
            row = F.array(F.struct(best["evidence_id"].alias("evidence_id"), i.alias("position"), best["gain"].alias("gain")))
            taken = F.struct(F.array_union(s["terms"], best["covered"]).alias("terms"), F.concat(s["out"], row).alias("out")).cast(kind)
            return F.when(best["gain"] > 0, taken).otherwise(s)

        return one

    return rows.select("question_id", F.inline(F.aggregate(F.sequence(F.lit(1), F.lit(count)), zero, step(F.col("pool")))["out"]))
