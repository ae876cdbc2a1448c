"""Set-aware metrics, the eight failure classes and overlapping failure counts on hand-made cases."""

import math

import pytest

from corpusloom import registry
from corpusloom.operators import metrics

ASKED = ["none", "lost", "late", "part", "ctx", "gen", "ok"]


@pytest.fixture(scope="module")
def case(spark):
    ranked = {"none": "uv", "lost": "uv", "late": "uvwa", "part": "auvb", "ctx": "auvx", "gen": "a", "ok": "ab"}
    ranking = spark.createDataFrame([(q, i + 1, c) for q, ids in ranked.items() for i, c in enumerate(ids)], "question_id string, rank int, chunk_id string")
    relevant = [("none", "a", 0), ("lost", "a", 1), ("late", "a", 2), ("part", "a", 2), ("part", "b", 1), ("ctx", "a", 1), ("gen", "a", 1), ("ok", "a", 2), ("ok", "b", 1)]
    labels = spark.createDataFrame(relevant, "question_id string, chunk_id string, grade int")
    spans = spark.createDataFrame([(c, "d" if c in "ab" else "e", ["p", c], 10 * i, 10 * i + 5, i) for i, c in enumerate("abuvwx")], "chunk_id string, context_id string, path array<string>, start int, end int, cost int")
    return ranking, labels, spans, spark.createDataFrame([(q,) for q in ASKED], "question_id string")


def test_classes_and_set_metrics(spark, case):
    ranking, labels, spans, questions = case
    context = spark.createDataFrame([("ctx", "x"), ("ok", "a")], "question_id string, chunk_id string")
    failed = spark.createDataFrame([("gen",), ("part",)], "question_id string")
    got = {r.question_id: r for r in metrics.set_metrics(ranking, labels, spans, questions, context, failed, judged_all=True).collect()}
    want = ["UNRESOLVED_LABEL_OR_GOLD", "DISCOVERY_MISS", "RANKING_MISS", "SET_COVERAGE_MISS", "HIERARCHY_CONTEXT_MISS", "CORRECT_EVIDENCE_GENERATION_ERROR", "NO_FAILURE"]
    assert [got[q]["class"] for q in ASKED] == want
    p = got["part"]
    assert (p.precision_at_1, p.precision_at_3, p.set_recall_at_3, p.required_coverage_at_3, p.coordinate_coverage_at_3, p.context_hit_at_1) == (1.0, pytest.approx(1 / 3), 0.0, 1.0, 0.5, 1.0)
    assert p.ndcg_at_10 == pytest.approx((2 + 1 / math.log2(5)) / (2 + 1 / math.log2(3))) and p.token_cost_at_3 == 0 + 2 + 3
    assert (got["late"].context_hit_at_3, got["late"].coordinate_coverage_at_3, got["lost"].coordinate_coverage_at_3) == (0.0, 0.0, None)
    assert got["none"].precision_at_1 is None and got["ctx"].required_coverage_at_1 is None
    report = metrics.set_report(metrics.set_metrics(*case)).first()
    assert (report.questions, report.evaluable, report.required_eligible, report.coordinates_available) == (7, 6, 3, 5)
    assert (report.evidence_1, report.evidence_2, report.evidence_3, report.token_cost_minimum) == (1, 2, 3, 0)


def test_failures_may_overlap(spark, case):
    ranking, labels, _, questions = case
    diagnostics = spark.createDataFrame([("late", "EXACT_REFERENCE_MALFORMED"), ("ok", "EXACT_COORDINATE_ABSENT"), ("gen", None), ("part", "DOCUMENT_UNRESOLVED")], "question_id string, diagnostic string")
    got = {r.category: r.n for r in metrics.failure_overlaps(ranking, labels, questions, diagnostics).collect()}
    assert got == {"parser_or_alias_identity_error": 2, "missing_top_10_evidence": 1, "poor_top_rank_ordering": 1}


def test_registered(spark):
    found = {r["class"]: r.n for r in registry.queries()["set_failure_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert sum(found.values()) == 40 and "UNRESOLVED_LABEL_OR_GOLD" in found
    assert registry.queries()["set_correlations"](spark, "/root/testdata/sf0.001").count() == 26
