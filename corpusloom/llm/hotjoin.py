"""Equi join of tables with hot keys by splitting joined row lists into a tree of sublist pairs.

A key is hot if its rows of both sides make more than PAIRS pairs, or one side alone has more rows than that. All other keys go through an ordinary
hash join: none of them can fill a task. Of a hot key

1. the rows of either side are dealt out to sublists of about as many rows each: LEAF, or the square root of the key's rows where that is more, so that
   the tree never has more leaves than the key has rows;
2. the tree begins with one node, the pair of both whole lists. In each round every node splits either list into at most FAN sublists, the pairs of
   which are redistributed as nodes of their own, until each is a pair of single sublists. Nodes name sublists by number, so no
   row is copied while the tree grows;
3. at the leaves the pairs meet the rows: `rows` fetches both sublists, each a bounded list, and writes out their pairs; `totals` needs for each row only what
   its partners add up to, so it fetches what a sublist adds up to, and no pair of a hot key is ever written out.

Nothing that grows with the input goes through one task, the driver or a broadcast: hot keys are a table, and Spark broadcasts it only below its own threshold; leaves and
sublists always meet in shuffles.
Hot rows are written once with their sublists, so a lost executor cannot deal them differently.

Null keys match nothing. Repeated rows all take part. An empty side leaves the other without partners. Columns of the two sides stay apart, so clashing names are harmless.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.plans.materialize import forget, written

#: Pairs of a key from which it is hot, rows of a sublist at least, sublists that a list of a node splits into at most.
PAIRS, LEAF, FAN = 1 << 14, 1 << 10, 8


class TreeJoin:
    """left and right joined on left_on = right_on; the columns of the sides travel as structs `left` and `right`."""

    def __init__(self, left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None, pairs: int = PAIRS, leaf: int = LEAF, fan: int = FAN):
        self.fan = fan
        sides = {"left": (left, left_on), "right": (right, right_on or left_on)}
        self.all = {name: df.select(F.col(on).alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")) for name, (df, on) in sides.items()}
        some = {name: df.where("key IS NOT NULL") for name, df in self.all.items()}
        n = [df.groupBy("key").agg(F.count("*").alias(f"n_{name}")) for name, df in some.items()]
        both = n[0].join(n[1], "key", "full").na.fill(0, ["n_left", "n_right"])
        step = F.greatest(F.lit(leaf), F.ceil(F.sqrt(F.col("n_left") + F.col("n_right"))))
        lists = {f"lists_{name}": F.ceil(F.col(f"n_{name}") / step).cast("int") for name in sides}
        hot = both.where((F.col("n_left") * F.col("n_right") > pairs) | (F.greatest("n_left", "n_right") > pairs))
        self.hot = written(hot.withColumns(lists), "tree-hot")
        self.cold = {name: df.join(self.hot, "key", "left_anti") for name, df in some.items()}
        dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("lists")).cast("int")
        self.dealt = {
            name: written(df.join(self.hot.select("key", F.col(f"lists_{name}").alias("lists")), "key").select("key", dealt.alias("list"), "row"), f"tree-{name}") for name, df in some.items()
        }

    def forget(self) -> None:
        """Deletes the written tables; no plan made from this join can run after that."""
        forget(self.hot, *self.dealt.values())

    def leaves(self) -> DataFrame:
        """Rows (key, l, r): the pairs of sublists of hot keys that both sides have, after as many rounds as the longest list takes."""
        widest = self.hot.agg(F.max(F.greatest("lists_left", "lists_right"))).first()[0] or 1
        nodes = self.hot.where("n_left > 0 AND n_right > 0").select("key", F.lit(0).alias("l"), F.col("lists_left").alias("l_end"), F.lit(0).alias("r"), F.col("lists_right").alias("r_end"))
        for _ in range(math.ceil(math.log(widest, self.fan) - 1e-9)):
            for side in ("l", "r"):
                step = F.ceil((F.col(f"{side}_end") - F.col(side)) / self.fan).cast("int")
                starts = F.sequence(F.col(side), F.col(f"{side}_end") - 1, step)
                nodes = nodes.withColumn("step", step).withColumn("at", F.explode(starts))
                nodes = nodes.withColumns({side: F.col("at"), f"{side}_end": F.least(F.col("at") + F.col("step"), f"{side}_end")}).drop("step", "at")
            nodes = nodes.repartition("key", "l", "r")
        return nodes.select("key", "l", "r")

    def matches(self) -> DataFrame:
        """Rows (key, left, right) of the inner join."""
        cold = self.cold["left"].withColumnRenamed("row", "left").join(self.cold["right"].withColumnRenamed("row", "right").hint("shuffle_hash"), "key")
        found = self.leaves()
        for name, at in (("left", "l"), ("right", "r")):
            sublists = self.dealt[name].groupBy("key", F.col("list").alias(at)).agg(F.collect_list("row").alias(f"{name}s")).hint("shuffle_hash")
            found = found.join(sublists, ["key", at])
        pairs = found.select("key", F.explode("lefts").alias("left"), "rights").select("key", "left", F.explode("rights").alias("right"))
        return cold.select("key", "left", "right").unionByName(pairs)

    def alone(self, name: str) -> DataFrame:
        """Rows (key, row) of a side without a partner, those with a null key among them."""
        other = "right" if name == "left" else "left"
        return self.all[name].join(self.all[other].select("key").distinct(), "key", "left_anti")

    def rows(self, how: str = "inner") -> DataFrame:
        """Rows (key, left, right) of the `inner`, `left`, `right` or `full` join; the struct of a missing partner is null."""
        if how not in ("inner", "left", "right", "full"):
            raise ValueError(f"no such join: {how}")
        out = self.matches()
        for name in ("left", "right"):
            if how in (name, "full"):
                found = self.alone(name).withColumnRenamed("row", name)
                out = out.unionByName(found, allowMissingColumns=True)
        return out.select("key", "left", "right")

    def totals(self, side: str, of: Column | str, what: str) -> DataFrame:
        """Rows (of, partners, outer, total), several for one value of `of`, that add up over the rows of a side to their partners in the inner join, their rows
        in the outer join that keeps the side, and the sum of the column `what` of the other side over their partners."""
        other = "right" if side == "left" else "left"
        own, theirs = F.col("row").getField(of) if isinstance(of, str) else of, F.col("row").getField(what)
        none = F.lit(0).cast("long")
        null = self.all[side].where("key IS NULL").select(own.alias("of"), none.alias("partners"), F.lit(1).cast("long").alias("outer"), none.alias("total"))
        met = self.cold[other].select("key", theirs.alias("what"), F.lit(1).alias("one")).hint("shuffle_hash")
        cold = self.cold[side].select("key", own.alias("of")).join(met, "key", "left").groupBy("key", "of")
        cold = cold.agg(F.count("one").alias("partners"), F.count("*").alias("outer"), F.coalesce(F.sum("what"), none).alias("total")).drop("key")
        mine, there = ("l", "r") if side == "left" else ("r", "l")
        sublists = self.dealt[other].groupBy("key", F.col("list").alias(there)).agg(F.count("*").alias("n"), F.sum(theirs).alias("s")).hint("shuffle_hash")
        sums = self.leaves().join(sublists, ["key", there]).groupBy("key", F.col(mine).alias("list")).agg(F.sum("n").alias("partners"), F.sum("s").alias("total")).hint("shuffle_hash")
        hot = self.dealt[side].select("key", "list", own.alias("of")).join(sums, ["key", "list"], "left")
        hot = hot.select("of", F.coalesce("partners", none).alias("partners"), F.greatest(F.coalesce("partners", none), F.lit(1)).alias("outer"), F.coalesce("total", none).alias("total"))
        return null.unionByName(cold).unionByName(hot)


def _rows(df: DataFrame, id_col: str, amount: str) -> DataFrame:
    """The contract's rows of a table: id, client_id and the crc32 of `id:cents`."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    client = F.when(h % 10 < 1, F.call_function("div", h, F.lit(10)) % 1).otherwise(F.col("client_id"))
    cents = F.floor(100 * F.col(amount) + 0.5).cast("string")
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(cents, F.lit("")))
    return df.select(F.col(id_col).alias("id"), client.cast("long").alias("client_id"), F.crc32(text.cast("binary")).alias("crc"))


def op12_hotjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = {"click": _rows(table(spark, sf_dir, "clicks"), "click_id", "value"), "sale": _rows(table(spark, sf_dir, "sales"), "sale_id", "total")}
    join = TreeJoin(sides["click"], sides["sale"], "client_id")
    none, out = F.lit(0).cast("long"), []
    for side, name in (("left", "click"), ("right", "sale")):
        copies = sides[name].select(F.col("id").alias("of"), "client_id", F.lit(1).cast("long").alias("copies"), none.alias("partners"), none.alias("outer"), none.alias("total"))
        sums = join.totals(side, "id", "crc").select("of", F.lit(None).cast("long").alias("client_id"), none.alias("copies"), "partners", "outer", "total")
        found = copies.unionByName(sums).groupBy("of").agg(F.max("client_id").alias("client_id"), *[F.sum(c).alias(c) for c in ("copies", "partners", "outer", "total")])
        kept = F.col("outer") if side == "left" else F.col("partners")
        out.append(found.select(F.lit(name).alias("side"), F.col("of").alias("id"), "client_id", "copies", F.col("partners").alias("inner_rows"), kept.alias("left_rows"), F.col("outer").alias("full_rows"), F.col("total").alias("partner_crc")))
    return out[0].unionByName(out[1])


#: crc32 from its table of 256 remainders, and the full outer join written out.
ORACLE = """WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
a AS (SELECT 'click' AS side, click_id AS id, client_id AS own, value AS amount FROM clicks UNION ALL SELECT 'sale', sale_id, client_id, total FROM sales),
s AS (SELECT side, id, own, CAST(id AS VARCHAR) AS plain, CAST(id AS VARCHAR) || ':' || coalesce(CAST(CAST(floor(100 * amount + 0.5) AS BIGINT) AS VARCHAR), '') AS said FROM a),
h AS (SELECT side, id, own, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(plain, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS h,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(said, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS crc FROM s, t),
k AS (SELECT side, id, CASE WHEN h % 10 < 1 THEN (h // 10) % 1 ELSE own END AS client_id, crc FROM h),
c AS (SELECT * FROM k WHERE side = 'click'), d AS (SELECT * FROM k WHERE side = 'sale'),
j AS (SELECT c.id AS cid, c.crc AS ccrc, d.id AS did, d.crc AS dcrc FROM c FULL JOIN d ON c.client_id = d.client_id),
n AS (SELECT side, id, max(client_id) AS client_id, count(*) AS copies FROM k GROUP BY side, id),
m AS (SELECT 'click' AS side, cid AS id, count(did) AS inner_rows, count(*) AS left_rows, count(*) AS full_rows, coalesce(sum(dcrc), 0) AS partner_crc FROM j WHERE cid IS NOT NULL GROUP BY cid
  UNION ALL SELECT 'sale', did, count(cid), count(cid), count(*), coalesce(sum(ccrc), 0) FROM j WHERE did IS NOT NULL GROUP BY did)
SELECT side, id, CAST(client_id AS BIGINT) AS client_id, copies, inner_rows, left_rows, full_rows, CAST(partner_crc AS BIGINT) AS partner_crc FROM n JOIN m USING (side, id)"""
