import pytest

from corpusloom.operators import governance as g


def test_identities():
    m = {"fingerprint": {"a": 1}, "outputs": {"x": g.checksum(b"1")}}
    m["run_id"] = g.run_id(m["fingerprint"])
    g.check_run(m)
    g.check_outputs(m, {"x": b"1"})
    for bad in (lambda: g.check_run({**m, "run_id": "run_0"}), lambda: g.check_outputs(m, {"x": b"2"}), lambda: g.check_telemetry(m, {"run_id": "y"}), lambda: g.safe_relative_path("../a")):
        with pytest.raises(g.GovernanceError):
            bad()


def test_machines():
    life = g.retrieval_lifecycle()
    life.mark("created")
    with pytest.raises(g.GovernanceError, match="RECEIPT"):
        life.mark("deleted")
    life.mark("deleted", "r")
    life.mark("absence_verified")
    assert life.complete
    s = g.Submission()
    assert [s.attempt() for _ in range(4)] == [1, 2, 3, 4]
    with pytest.raises(g.GovernanceError):
        s.attempt()
    assert [g.retry_delay(i) for i in (1, 2, 3)] == [1, 2, 4]


def test_limits_and_decisions():
    assert g.parameter_total({"a": 3, "b": 4}) == 7
    with pytest.raises(g.GovernanceError, match="LIMIT"):
        g.parameter_total({"a": 4_000_000_000})
    assert g.sparse_preflight(100, 50.0, 1000, 4, 600)["within_cap"] and not g.dense_preflight(1000, 1.0, 8, 999)["within_cap"]
    assert g.bottleneck(0.5, 0.5, 1, 0) == "DISCOVERY" and g.bottleneck(0.9, 0.5, 1, 0) == "RANKING"
    assert g.model_gates({}) == ["MODEL_REVISION", "TOKENIZER_REVISION", "LICENSE", "PARAMETER_AUDIT", "REGISTRATION"]
    rows = [{"question_id": q, "chunk_id": c, "rank": r} for q, c, r in (("a", "x", 1), ("a", "y", 2), ("b", "x", 1))]
    g.check_response(["a", "b"], rows)
    with pytest.raises(g.GovernanceError, match="ORDER"):
        g.check_response(["b", "a"], rows)
