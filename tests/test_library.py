"""Functions, parsers and operators on hand-made cases, and queries against SQL."""

import glob
import itertools
import json
import math
import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom import queries_corpus, registry
from corpusloom.functions import legal
from corpusloom.functions import text as tx
from corpusloom.operators import corpus, fuse, metrics, retrieve, rouge, select, split, training
from corpusloom.plans import components
from corpusloom.sources import organizer, sinks
from corpusloom.streaming import run_resumable

SF = "/root/testdata/sf0.001"


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, tx.tokens, "Điều 12A: mức-phạt 1.000₫ ✅") == ["Điều", "12A", ":", "mức", "-", "phạt", "1", ".", "000", "₫", "✅"]
    assert one(spark, tx.tokens, None) == []


def test_normal_forms(spark):
    assert one(spark, lambda c: tx.split_normalized(tx.nfc_exact(c)), unicodedata.normalize("NFD", "  ĐIỀU 1:\tPhí + 20%—đúng?!  ")) == "điều 1 phí + 20 đúng"
    assert one(spark, tx.document_number_key, "08/2022/NQ-HĐND") == "08/2022/nq-hdnd"
    assert one(spark, tx.document_number_key_exact, "08/2022/NQ-HĐND") == "08/2022/nq-hdnd"
    assert one(spark, tx.law_identity_key, "Bộ luật Dân sự 2015 (sửa đổi)") == "bo luat dan su 2015"
    assert one(spark, tx.character_ngrams, "abcdefabcde") == ["abcde", "bcdef", "cdefa", "defab", "efabc", "fabcd"]
    assert one(spark, tx.character_ngrams, "abc") == ["abc"] and one(spark, tx.character_ngrams, "") == []
    assert one(spark, lambda c: tx.compacted(c, 4), "One two. Three four five. Six.") == "One two."
    assert one(spark, lambda c: tx.compacted(c, 9), "  E\u0301 \n\t x\u00a0y ") == "\u00c9 x y"
    assert one(spark, lambda c: tx.compacted(c, 2), "no end at all") == "no end at all"
    assert one(spark, tx.redacted, "password=abc at /home/x/y") == "[REDACTED] at [PATH]"


def test_bm25_by_hand(spark):
    q = spark.createDataFrame([("q", "luật")], "question_id string, question string")
    one_doc = spark.createDataFrame([("c", "luật")], "chunk_id string, text string")
    assert retrieve.bm25(one_doc, q).first()["score"] == pytest.approx(0.2876820724517809, abs=1e-15)
    two = spark.createDataFrame([("a", "luật luật mẫu"), ("b", "luật khác")], "chunk_id string, text string")
    got = {r.chunk_id: r.score for r in retrieve.bm25(two, q).collect()}
    idf = math.log1p(0.5 / 2.5)
    assert got["a"] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5)))
    assert got["b"] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2.5)))


def ranking(spark, rows):
    return spark.createDataFrame([(q, i + 1, c, 1.0 / (i + 1)) for q, ids in rows.items() for i, c in enumerate(ids)], "question_id string, rank int, chunk_id string, score double")


def test_fusion_and_metrics_by_hand(spark):
    got = fuse.reciprocal_rank_fusion([ranking(spark, {"q": ["a", "common", "sparse"]}), ranking(spark, {"q": ["b", "common", "dense"]})]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["common", "a", "b", "dense", "sparse"]
    r = ranking(spark, {"q1": ["a", "x", "b"], "q2": ["x", "c"]})
    lab = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 1), ("q2", "c", 1)], "question_id string, chunk_id string, grade int")
    rep = metrics.retrieval_report(metrics.per_question(r, lab)).first()
    assert (rep.recall_at_1, rep.recall_at_5, rep.mrr_at_10) == (0.25, 1.0, 0.75)
    graded = spark.createDataFrame([("q1", "a", 1), ("q1", "x", 2), ("q1", "z", 1)], "question_id string, chunk_id string, grade int")
    want = (1 + 2 / math.log2(3)) / (2 + 1 / math.log2(3) + 1 / 2)
    assert metrics.ndcg(r, graded).where("question_id = 'q1'").first()["ndcg"] == pytest.approx(want)
    exact = spark.createDataFrame([("q", "z")], "question_id string, chunk_id string")
    got = fuse.union_rank(exact, ranking(spark, {"q": ["a", "z", "b"]})).orderBy("rank").collect()
    assert [(x.chunk_id, x.exact) for x in got] == [("z", True), ("a", False), ("b", False)]


def test_hierarchy_and_chunks():
    text = "Phần I\nChương II. Quy định\nĐiều 1. Phạm vi\n1. abc def\na) gh ij\nĐiều 3: xyz\n"
    nodes = legal.hierarchy(text)
    assert [n["path"][-1] for n in nodes] == ["Phần I", "Chương II", "Điều 1", "Khoản 1", "Điểm a", "Điều 3"]
    assert [n["breaks"] for n in nodes] == [False] * 5 + [True]
    assert [c["tokens"] for c in legal.chunks("x " * 600)] == [512, 152]
    for c in legal.chunks(text + "lời " * 900):
        assert c["display_text"] == (text + "lời " * 900)[c["start"] : c["end"]]
    assert legal.chunks(None) == [] and legal.hierarchy("") == []


def test_citations_and_references():
    got = legal.citations("khoản 3, khoản 05 Điều 017 Nghị định 90/2017/NĐ-CP; điểm A khoản 9 Điều 3 Luật Đất đai 2013")
    assert [(c["article"], c["clause"], c["point"]) for c in got] == [("17", "3", None), ("17", "5", None), ("3", "9", "a")]
    assert got[0]["document_number"] == "90/2017/NĐ-CP" and got[2]["law_identity"] == "luat dat dai 2013"
    assert legal.reference("điểm a Điều 5")["diagnostic"] == "EXACT_REFERENCE_MALFORMED"
    assert legal.reference("Điều 1 và Điều 2")["diagnostic"] == "EXACT_COORDINATE_AMBIGUOUS"
    assert legal.reference(None)["diagnostic"] == "EXACT_COORDINATE_ABSENT"
    text = "khoản 3 Điều 5 phạt 10 triệu"
    assert len(legal.masked(text)) == len(text) and legal.masked(text).split() == ["phạt", "10", "triệu"]


def test_split_by_hand(spark):
    rows = [(i, t) for i, t in enumerate(["abcdefghij" * 20, "abcdefghij" * 20 + "k", "Zz!", "zz", "other text entirely", ""])]
    groups = {r.id: r.group for r in split.split_groups(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert groups == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}


def grams(t):
    return {t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else {t} - {""}


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(3, 400))).strip() for _ in range(40)]
    for t in texts[:20]:
        k = rng.randrange(max(1, len(t)))
        texts += [t[:k] + "x" + t[k + 1 :], t + "ab"]
    rows = list(enumerate(sorted({t for t in texts if t})))
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if abs(len(a) - len(b)) * 10 <= max(len(a), len(b)) and len(grams(a) & grams(b)) * 10 >= len(grams(a) | grams(b)) * 9}
    got = {(r.a, r.b) for r in split.near_duplicate_pairs(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == want and want


@pytest.mark.parametrize("chunk", [3, 250_000])
def test_components_equal_union_find(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 12)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_hash_split_digest(spark):
    rows = spark.createDataFrame([("q0",), ("q5",), ("q11",)], "id string")
    import hashlib

    for r in rows.select("id", split.hash_share("seed", F.col("id")).alias("h")).collect():
        assert int(r.h) == int.from_bytes(hashlib.sha256(f"seed\n{r.id}".encode()).digest()[:8], "big")


def test_selection_by_hand(spark):
    kind = "question_id string, rank int, evidence_id string, context_id string, path array<string>, start int, end int, cost int, status string, role string, admits boolean, score double"
    rows = [
        ("q", 1, "a", "c", ["A"], 0, 10, 5, "valid", "ranked", False, 1.0), ("q", 2, "a", "c", ["B"], 20, 30, 1, "valid", "ranked", False, 1.0), ("q", 3, "b", "c", ["A", "1"], 40, 50, 1, "valid", "ranked", False, 1.0),
        ("q", 4, "d", "c", ["C"], 1, 10, 1, "valid", "ranked", False, 1.0), ("q", 5, "e", "d", ["C"], 1, 10, 9, "valid", "ranked", False, 1.0), ("q", 6, "f", "d", ["D"], 1, 10, 2, "missing", "ranked", False, 1.0),
        ("q", 7, "g", "d", ["D"], 1, 10, 2, "valid", "ranked", False, 0.1), ("q", 8, "h", "e", ["D"], 1, 10, 2, "valid", "ranked", False, 0.9),
    ]
    got = select.select_evidence(spark.createDataFrame(rows, kind), 10, relative=0.5).orderBy("rank").collect()
    assert [r.reason for r in got] == ["SELECT_PRIMARY", "SKIP_DUPLICATE_ID", "SKIP_PARENT_CHILD_REDUNDANCY", "SKIP_EXCESSIVE_OVERLAP", "SKIP_TOKEN_BUDGET", "SKIP_INVALID_EVIDENCE", "SKIP_LOW_INCREMENTAL_COVERAGE", "SELECT_COMPLEMENTARY_COORDINATE"]
    admitted = select.admit_within_budget(spark.createDataFrame([("q", i, str(c), c, True) for i, c in enumerate([5, 9, 3, 4])], "question_id string, rank int, evidence_id string, cost int, valid boolean"), 12)
    assert [r.evidence_id for r in admitted.where("admitted").orderBy("rank").collect()] == ["5", "3", "4"]


def test_scores_by_hand(spark):
    pairs = spark.createDataFrame([("1", "the cat sat on the mat", "the cat on the mat sat"), ("2", "a b", ""), ("3", None, "x")], "id string, reference string, prediction string")
    got = {r.id: r for r in rouge.answer_scores(pairs).collect()}
    assert got["1"].rouge_l == pytest.approx(5 / 6) and got["2"].rouge_l == 0 and got["3"].meteor_exact == 0
    n = {r.id: r.fmeasure for r in rouge.rouge_n(pairs, 2).collect()}
    assert n["1"] == pytest.approx(3 / 5) and n["2"] == 0
    rng = random.Random(0)
    for _ in range(100):
        a, b = rng.choices("abc", k=rng.randint(0, 12)), rng.choices("abc", k=rng.randint(0, 12))
        assert rouge.lcs_length(a, b) == rouge._lcs_rows(a, b)[-1][-1]
    both = spark.createDataFrame([(str(i), 0.0, 1.0) for i in range(9)], "id string, base double, new double")
    assert tuple(rouge.bootstrap(both, "s", 200).first()) == (9, 1.0, 1.0, 1.0)


def test_extractive_answer(spark):
    assert one(spark, corpus.extractive_answer, "Điều 1\nNgười đủ 18 tuổi được cấp thẻ. Sau đó.") == "Người đủ 18 tuổi được cấp thẻ."
    assert one(spark, corpus.extractive_answer, None) == corpus.REFUSAL
    assert one(spark, corpus.extractive_answer, "a " * 600).endswith("a…")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"1": {"question": "a", "answer": "b"}, "0": {"question": "c", "answer": "d"}}))
    assert [r.question_id for r in organizer.read_questions(spark, str(tmp_path / "q.json")).orderBy("source_position").collect()] == ["1", "0"]
    (tmp_path / "bad.json").write_text('{"1": {"question": "a", "answer": "b", "answer": "c"}}')
    with pytest.raises(Exception, match="DATA_DUPLICATE_KEY"):
        organizer.read_questions(spark, str(tmp_path / "bad.json")).collect()
    golden = {
        "train": [(b"[]", "DATA_ROOT_TYPE $"), (b'{"1":{"question":"a","question":"b","answer":"c"}}', "DATA_DUPLICATE_KEY"), (b'{"1":{"question":"a","answer":null}}', 'DATA_ANSWER_TYPE $["1"].answer'), (b'{"1":{"question":"a","answer":7}}', "DATA_ANSWER_TYPE")],
        "public": [(b'{"1":{"question":"a"}}', 'DATA_FIELD_MISSING $["1"].answer'), (b'{"1":{"question":4,"answer":null}}', 'DATA_QUESTION_TYPE $["1"].question'), (b'{"1":{"question":"a","answer":null,"extra":1}}', "DATA_FIELD_UNKNOWN"), (b'{"1":{"question":"\xff","answer":null}}', "DATA_UTF8_INVALID"), (b'{"1":{"question":"a","answer":"b"}}', "DATA_ANSWER_TYPE")],
    }
    for kind, cases in golden.items():
        for data, code in cases:
            assert organizer.question_problem(data, kind).startswith(code), data
    (tmp_path / "bom.json").write_bytes(b'\xef\xbb\xbf{"01":{"question":"C\xc3\xa2u h\xe1\xbb\x8fi?","answer":null}}')
    assert [(r.question_id, r.question, r.answer, r.answer_state, r.bom) for r in organizer.read_questions(spark, str(tmp_path / "bom.json"), "public").collect()] == [("01", "Câu hỏi?", None, "unlabeled", True)]
    link = b'"link":"https://example.invalid/2"'
    for data, code in ((b'{"id":"2",' + link + b',"passage":"x"}', "DATA_CONTEXT_ID_TYPE $.id"), (b'{"id":true,' + link + b',"passage":"x"}', "DATA_CONTEXT_ID_TYPE"), (b'{"id":2,"passage":"x"}', "DATA_FIELD_MISSING $.link"), (b'{"id":2,' + link + b',"passage":null}', "DATA_CONTEXT_PASSAGE_TYPE $.passage"), (b'{"id":2,' + link + b',"passage":"x","extra":1}', "DATA_FIELD_UNKNOWN $.extra")):
        assert organizer.context_problem(data, "context_2.json").startswith(code), data
    (tmp_path / "strict").mkdir()
    (tmp_path / "strict" / "context_2.json").write_bytes(b'{"id":2,"link":"relative","passage":"x"}')
    with pytest.raises(Exception, match="DATA_CONTEXT_LINK_INVALID"):
        organizer.read_contexts(spark, str(tmp_path / "strict")).collect()
    (tmp_path / "strict" / "context_2.json").write_bytes(b'{"id":"2",' + link + b',"passage":"x"}')
    with pytest.raises(Exception, match="DATA_CONTEXT_ID_TYPE"):
        organizer.read_contexts(spark, str(tmp_path / "strict")).collect()
    for i, passage in ((10, "text"), (9, " ")):
        (tmp_path / f"context_{i}.json").write_text(json.dumps({"id": i, "link": "https://a.vn/x", "passage": passage}))
    got = organizer.read_contexts(spark, str(tmp_path)).orderBy("source_position").collect()
    assert [(r.context_id, r.indexable, r.quarantine_reason) for r in got] == [("9", False, "EMPTY_PASSAGE"), ("10", True, None)]
    df = spark.range(5).withColumn("v", F.lit("x"))
    sinks.write_immutable(df, str(tmp_path / "t"))
    sinks.write_immutable(df.repartition(3), str(tmp_path / "t"))
    with pytest.raises(sinks.SinkError, match="ARTIFACT_IMMUTABLE"):
        sinks.write_immutable(df.limit(4), str(tmp_path / "t"))
    answers = spark.createDataFrame([("b", "2"), ("a", "1")], "question_id string, answer string")
    expected = spark.createDataFrame([("a", 1), ("b", 0)], "question_id string, position int")
    assert json.loads(sinks.submission(answers, expected)) == {"b": {"answer": "2"}, "a": {"answer": "1"}}
    assert sinks.submission_zip(b"x") == sinks.submission_zip(b"x")
    with pytest.raises(sinks.SinkError, match="SUBMISSION_INVALID"):
        sinks.submission(answers.limit(1), expected)


def test_resumable_batches(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.range(3).write.parquet(src)
    for _ in range(2):
        run_resumable(spark, src, "id long", out, check, lambda s: s.withColumn("twice", F.col("id") * 2))
    spark.range(3, 5).write.mode("append").parquet(src)
    run_resumable(spark, src, "id long", out, check, lambda s: s.withColumn("twice", F.col("id") * 2))
    assert sorted(r.twice for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8]


def test_policy_and_failures(spark):
    rows = spark.createDataFrame([("train",), ("dev",)], "partition string")
    with pytest.raises(Exception, match="NOT_TRAIN"):
        training.enforce(rows, F.col("partition") != "train", "NOT_TRAIN").collect()
    conflict = spark.createDataFrame([("q", "a", 1.0), ("q", "a", 2.0)], "question_id string, chunk_id string, score double")
    with pytest.raises(Exception, match="conflicting"):
        fuse.union_rank(conflict.select("question_id", "chunk_id"), conflict).collect()


def duck():
    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        source = f"{path}/**/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{source}')")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["bm25_topk", "cosine_topk", "recall_mrr", "ndcg10", "union_rank", "admission_budget", "packing_calibration", "token_windows", "hash_split", "rouge_n", "supervision_classes", "exact_resolve", "latency_quantiles", "delta_overlay"])
def test_queries_equal_sql(spark, name):
    df = (registry.queries() | queries_corpus.ON_FIXTURE)[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck().sql((queries_corpus.ORACLES | registry.oracle_sql())[name])
    assert sorted(rel.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
