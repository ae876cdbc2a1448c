"""Fill-in-the-middle against lists of units, on odd texts; the contract's SQL on the same rows."""

import hashlib
import re

import duckdb

from corpusloom.llm import fim

ODD = ["", None, "a", "one two", "\x01\x02\x01", "\x020\x021\x02", "<P> has a mark", "né 😀\n\tÄÖ ß", "<" * 5, "x<S", "P>a<", "0123", "word " * 3000, "żółw 12 " * 500]


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, text)
    p, m, x = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{x}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{x}<M>{m}"
    return (doc_id, len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out)


def test_parts_and_their_texts(spark, tmp_path):
    rows = [(i, ODD[i % len(ODD)], "x", 1, "y") for i in range(600)] + [(None, "no id here", "x", 2, "y"), (5, "one two", "x", 3, "y"), (5, "one two", "x", 3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long, marked string")
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["n"], r["form"], r["prefix"] and len(r["prefix"]), r["middle"] and len(r["middle"]), r["output"]) for r in made if r["doc_id"] is not None)
    want = sorted((True, *(e if e[2] == "plain" else (*e[:3], e[3] or "", e[4] or "", e[5]))) for e in (expected(i, t) for i, t, *_ in rows if i is not None))
    assert got == want
    texts = {(r["doc_id"], r["output"]): r["back"] for r in made}
    for i, t, *_ in rows:
        e = expected(i, t)
        assert texts[i, e[5]] == (t or "")
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    mine = fim.op13_fim(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = db.sql(fim.ORACLE)
    assert sorted(map(str, (tuple(r[c] for c in theirs.columns) for r in mine))) == sorted(map(str, theirs.fetchall()))


def test_no_rows_no_python(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    made = fim.fill_in_middle(docs)
    assert made.count() == 0 and "Python" not in made._jdf.queryExecution().toString()


def test_other_draws(spark):
    docs = spark.createDataFrame([(i, f"text of {i}") for i in range(50)], "doc_id long, text string")
    assert {r["form"] for r in fim.fill_in_middle(docs, plain_from=100, spm_below=100).collect()} == {"spm"}
    assert {r["form"] for r in fim.fill_in_middle(docs, plain_from=0).collect()} == {"plain"}
