"""The tree join against Spark's own join and against sums over nested loops; the contract's SQL on the driver's tables."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hotjoin
from corpusloom.llm.hotjoin import TreeJoin

SCHEMA = "id long, k string, w long, list int, row string"


def sides(seed, n, m):
    rng = random.Random(seed)
    keys = ["hot"] * 40 + ["warm"] * 10 + [None] * 3 + [f"k{i}" for i in range(30)]
    side = lambda size, only: [(rng.randrange(size), rng.choice([*keys, only]), rng.randrange(100), 1, "x") for _ in range(size)]
    return side(n, "left only"), side(m, "right only")


def nested(left, right):
    return [(a, b) for a in left for b in right if a[1] is not None and a[1] == b[1]]


@pytest.mark.parametrize("pairs,leaf,fan", [(10, 3, 2), (200, 16, 8), (1 << 14, 1 << 10, 8)])
def test_rows_of_all_joins(spark, pairs, leaf, fan):
    left, right = sides(1, 150, 120)
    join = TreeJoin(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA.replace("k s", "c s")), "k", "c", pairs, leaf, fan)
    inner = nested(left, right)
    lone = {"left": [(a, None) for a in left if all(a is not x for x, _ in inner)], "right": [(None, b) for b in right if all(b is not y for _, y in inner)]}
    want = {"inner": inner, "left": inner + lone["left"], "right": inner + lone["right"], "full": inner + lone["left"] + lone["right"]}
    for how, rows in want.items():
        got = [(r["left"] and tuple(r["left"]), r["right"] and tuple(r["right"])) for r in join.rows(how).collect()]
        assert Counter(got) == Counter(rows), how
    join.forget()


def test_leaves_cover_each_pair_of_sublists_once(spark):
    left, right = sides(2, 500, 300)
    join = TreeJoin(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "k", None, 20, 4, 3)
    hot = {r["key"]: (r["lists_left"], r["lists_right"]) for r in join.hot.collect()}
    assert hot["hot"][0] > 9 and hot["hot"][1] > 3  # three rounds and more
    leaves = [tuple(r) for r in join.leaves().collect()]
    assert Counter(leaves) == Counter((k, i, j) for k, (a, b) in hot.items() for i in range(a) for j in range(b))
    n = Counter(r["key"] for r in join.dealt["left"].collect()) + Counter(r["key"] for r in join.dealt["right"].collect())
    assert all(a * b <= max(n[k], 1) for k, (a, b) in hot.items())


@pytest.mark.parametrize("pairs", [10, 1 << 14])
def test_totals(spark, pairs):
    left, right = sides(3, 200, 150)
    join = TreeJoin(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "k", None, pairs, 4, 2)
    for side, rows, pick in (("left", left, 0), ("right", right, 1)):
        got = {r["of"]: tuple(r)[1:] for r in join.totals(side, "id", "w").groupBy("of").agg(F.sum("partners"), F.sum("outer"), F.sum("total")).collect()}
        met = [p if pick == 0 else p[::-1] for p in nested(left, right)]
        want = {}
        for row in rows:
            mine = [b for a, b in met if a is row]
            x = want.get(row[0], (0, 0, 0))
            want[row[0]] = (x[0] + len(mine), x[1] + max(1, len(mine)), x[2] + sum(b[2] for b in mine))
        assert got == want


def test_empty_sides(spark):
    left, right = sides(4, 60, 1)
    some, none = spark.createDataFrame(left, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert TreeJoin(some, none, "k", None, 4, 2, 2).rows("full").count() == 60
    assert TreeJoin(none, some, "k", None, 4, 2, 2).rows("left").count() == 0
    assert TreeJoin(none, none, "k").rows("full").count() == 0
    with pytest.raises(ValueError, match="no such join"):
        TreeJoin(none, none, "k").rows("cross")


def test_the_contract_on_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    clicks = [(i % 700, rng.choice([None, 1, 1, 1, 2, 3, 900]), rng.choice([None, 0.0, -2.345, 10.005, 1e6])) for i in range(900)]
    sales = [(i, rng.choice([None, 1, 1, 2, 4, 800]), rng.choice([None, 0.5, 99.99])) for i in range(500)]
    spark.createDataFrame([(*c, "clash", 1) for c in clicks], "click_id long, client_id long, value double, id string, crc int").coalesce(1).write.parquet(f"{tmp_path}/clicks.parquet")
    spark.createDataFrame(sales, "sale_id long, client_id long, total double").coalesce(1).write.parquet(f"{tmp_path}/sales.parquet")
    db = duckdb.connect()
    for t in ("clicks", "sales"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    sql = db.sql(hotjoin.ORACLE)
    # copies of an id with several clients: the SQL and the query both take the largest client_id
    mine = [tuple(r[c] for c in sql.columns) for r in hotjoin.op12_hotjoin(spark, str(tmp_path)).collect()]
    assert sorted(map(str, mine)) == sorted(map(str, sql.fetchall()))
