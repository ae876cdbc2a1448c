"""Near duplicates by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum: both
agree between two sets with probability equal to their Jaccard similarity, so half the hash
evaluations fill a signature, and as the two values of one permutation are negatively correlated its
variance is slightly lower than that of independent values.

Steps: (1) a signature, band keys and a 128-bit set id per document; (2) documents with equal sets
collapse to a class under the smallest doc_id, and classes that share a doc_id are one component from the start; (3) within every
band bucket all members are paired with a leader, not with each other; (4) pairs whose bit sketches agree are confirmed on full sets;
(5) buckets whose members are not yet in one component get GROWTH times as many further leaders in each round, small ones all at once,
until no bucket has an untested pair between components. So no link between bucket mates is lost, yet a bucket of thousands
of copies costs one pair per member. From the second round on, what is left are mostly texts that are close to a large component without
a link to it, so members carry a print of their set, from which the bucket join itself has a bound of the sets' difference, and only pairs
that the bound lets pass leave it.

Nulls and texts without words have the empty set, are linked with nothing and are their own component.
Rows that repeat a doc_id are one node, linked where any of its texts is; a row with a null doc_id is linked with
nothing and its component is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import WordHashes, in_arrow, slices, table
from corpusloom.plans.components import connected_components
from corpusloom.plans.materialize import forget, release, written

WIDTH = 5
PERMUTATIONS = 192
ROWS = 6
BANDS = 2 * PERMUTATIONS // ROWS
#: A bit of each signature value makes a sketch; pairs whose sketches agree in fewer bits than the threshold gives on average, less so many
#: standard errors, go without the exact comparison.
SLACK = 6.0
SKETCH = 2 * PERMUTATIONS // 64
#: Buckets of so many members at most are compared in full after the first leader.
SMALL = 64
#: Times more leaders in each round.
GROWTH = 8
#: A print is a bitmap of 64 times WORDS bits with one set for each hash of a set of so many shingles at most; of a larger set, for the hashes
#: under a bound that leaves this many at most on average. Its bound is then an estimate, with the sketch's number of standard errors.
PRINT, WORDS = 512, 32

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int = WIDTH, words_of: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased, words end at ASCII white space.

    A text of fewer words than width has its whole word sequence as one shingle; none has no shingle.
    words_of caches hashes of words between texts.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map((WordHashes() if words_of is None else words_of).__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    m = len(h) - n + 1
    total = np.full(m, np.uint64(n))
    for i in range(n):
        total = total * _MIX[i % len(_MIX)] + h[i : i + m]
    return np.unique(_mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every permutation, interleaved; hashes must not be empty."""
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    out[:, 0], out[:, 1] = np.uint64(2**64 - 1), 0
    for at in range(0, len(hashes), 8192):
        x = hashes[None, at : at + 8192] * _A[:, None] + _B[:, None]
        np.minimum(out[:, 0], x.min(axis=1), out=out[:, 0])
        np.maximum(out[:, 1], x.max(axis=1), out=out[:, 1])
    return out.reshape(-1)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key of each band of a signature: ROWS minima or ROWS maxima of different permutations, whose agreements are independent.

    Minimum and maximum of one permutation are in different bands: as they seldom agree together in small sets, they would thin out a band's
    agreements, but two such bands make it likelier that one of them agrees.
    """
    rows = values.reshape(PERMUTATIONS, 2).T.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed(key * _MIX[0] + rows[:, i])
    return key


def _signatures(width: int):
    def run(batches):
        names, cache = ["doc_id", "set_id", "n_shingles", "bands", "sketch"], WordHashes()
        for b in slices(batches):
            ids, n, bands, sketches = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, width, cache)
                n.append(len(s))
                if not len(s):
                    ids.append(None), bands.append(None), sketches.append(None)
                    continue
                v = signature(s)
                ids.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band_keys(v).view(np.int64))
                sketches.append(np.packbits(_mixed(v) >> np.uint64(63) == 1).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=names)

    return run


def set_print(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """(level, bitmap) of a sorted set. Level 0 has all hashes, level k those of which the highest k bits are 0.

    Bits that differ between two bitmaps of a level are at most as many as hashes of that level that one set has and the other has not.
    """
    level = 0
    while len(hashes) >> level > PRINT:
        level += 1
    some = hashes[: np.searchsorted(hashes, np.uint64(1 << (64 - level)))] if level else hashes
    bits = np.zeros(64 * WORDS, bool)
    bits[(some % np.uint64(64 * WORDS)).astype(np.int64)] = True
    return level, np.packbits(bits).view(np.int64)


def _sets(width: int):
    def run(batches):
        cache = WordHashes()
        for b in slices(batches, 128):
            sets = [shingle_set(t, width, cache) for t in b.column("text").to_pylist()]
            told = [set_print(x) for x in sets]
            columns = [
                b.column("doc_id"),
                pa.array([x.tobytes() for x in sets], pa.binary()),
                pa.array([x[0] for x in told], pa.int32()),
                pa.array([x[1] for x in told], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hashes", "level", "print"])

    return run


def _confirmed(percent: int):
    def run(batches):
        last, x = None, None
        for b in slices(batches, 2048):
            keep = []
            for left, right in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist()):
                if left != last:
                    last, x = left, np.frombuffer(left, np.uint64)
                y = np.frombuffer(right, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield b.drop_columns(["set_a", "set_b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirm_pairs(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ca, cb) of doc_ids, with a column for each, whose full shingle sets (doc_id, hashes) reach the similarity."""
    pairs = (
        near.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("set_b")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("set_a")), "a")
        .select("a", "b", "ca", "cb", "set_a", "set_b")
    )
    return in_arrow(pairs, _confirmed(percent), "a long, b long, ca long, cb long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable over links, kept marks that document. Ties
    cannot occur: components are sets. Other columns of docs, whatever their names, are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(in_arrow(docs, _signatures(width), "doc_id long, set_id binary, n_shingles long, bands array<long>, sketch array<long>"), "mm-signed")
    told = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = told.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "bands", "sketch"), "doc_id").alias("s"))
    reps = written(reps.select("set_id", F.col("rep").alias("doc_id"), "s.*"), "mm-reps")
    # classes under one doc_id
    several = told.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi").select("doc_id")
    shared = told.select("doc_id", "set_id").distinct().join(several, "doc_id", "left_semi").join(reps.select("set_id", F.col("doc_id").alias("rep")), "set_id")
    comps = written(connected_components(shared, "doc_id", "rep"), "mm-comps")
    bits = [F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]
    facts = reps.select("doc_id", F.col("n_shingles").alias("size"), *bits)
    bucketed = reps.select("doc_id", F.explode("bands").alias("key"))
    sizes = bucketed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # c: the component of a member so far; size and s0.. are facts of the member
    of = comps.select(F.col("node").alias("doc_id"), F.col("component").alias("c"))
    members = written(bucketed.join(sizes, "key").join(of, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")), "mm-members")
    active = written(members.join(facts, "doc_id"), "mm-active")
    # full sets of all bucket members, once for all rounds, and by a shuffle at every size
    wanted = members.select("doc_id").distinct().hint("merge")
    sets = written(in_arrow(docs.join(wanted, "doc_id", "left_semi"), _sets(width), "doc_id long, hashes binary, level int, print array<long>"), "mm-sets")
    forget(members)
    known, cells = ["doc_id", "c", "size", *(f"s{i}" for i in range(SKETCH))], 1
    while not active.isEmpty():
        # leaders: the member with the smallest id of each of so many cells; later on, all members of small buckets
        cell = F.pmod(F.xxhash64("doc_id", F.lit(cells)), F.lit(cells))
        cell = cell if cells == 1 else F.when(F.col("n") <= SMALL, F.col("doc_id")).otherwise(cell)
        leaders = active.groupBy("key", cell.alias("cell")).agg(F.min(F.struct(*known)).alias("l"))
        leaders = written(leaders.select("key", *[F.col(f"l.{x}").alias(f"l_{x}") for x in known]), "mm-leaders")
        pairs = active.alias("x").join(leaders.alias("y"), (F.col("x.key") == F.col("y.key")) & _alike(percent, cells > 1))
        first = F.col("doc_id") < F.col("l_doc_id")
        pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
        pairs = pairs.select(pick("doc_id", "l_doc_id").alias("a"), pick("l_doc_id", "doc_id").alias("b"), pick("c", "l_c").alias("ca"), pick("l_c", "c").alias("cb"))
        pairs = written(pairs.distinct(), "mm-pairs")
        merged = written(connected_components(confirm_pairs(pairs, sets, percent), "ca", "cb"), "mm-merged")
        to = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
        old = comps.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        new = merged.join(comps.select("node"), "node", "left_anti")
        before, comps = comps, written(old.unionByName(new), "mm-comps")
        # a leader has met all members of its buckets; buckets whose other members share a component are done
        rest = active.drop("n").join(leaders.select("key", F.col("l_doc_id").alias("doc_id")), ["key", "doc_id"], "left_anti")
        rest = rest.join(merged.select(F.col("node").alias("c"), F.col("component").alias("root")), "c", "left").withColumn("c", F.coalesce("root", "c")).drop("root")
        rest = written(rest, "mm-rest")
        still = rest.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
        still = rest.join(still, "key")
        if cells == 1:
            still = still.join(sets.drop("hashes"), "doc_id")
            known += ["level", "print"]
        done, active = active, written(still, "mm-active")
        forget(before, done, leaders, pairs, merged, rest)
        cells *= GROWTH
    out = signed.drop("bands", "sketch").join(reps.select("set_id", F.col("doc_id").alias("rep")), "set_id", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    out = out.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    forget(sets, active)
    release(docs.sparkSession)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("component"))).alias("kept"))


def _alike(percent: int, printed: bool):
    """Condition under which a member and a leader (columns l_) of different components may reach the similarity."""
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"l_s{i}"))) for i in range(SKETCH)), F.lit(0))
    same = 0.5 + percent / 200
    most = int(64 * SKETCH * (1 - same + SLACK * (same * (1 - same) / (64 * SKETCH)) ** 0.5)) + 1
    alike = (F.col("c") != F.col("l_c")) & (F.least("size", "l_size") * 100 >= F.greatest("size", "l_size") * percent) & (differ <= most)
    if not printed:
        return alike
    # hashes of which two sets of these sizes may differ at most, and of a level's hashes on average; a count has its mean as variance at most
    most = (F.col("size") + F.col("l_size")) * F.lit((100 - percent) / (100 + percent)) / F.pow(F.lit(2.0), F.col("level"))
    most = F.when(F.col("level") == 0, most + 0.001).otherwise(most + SLACK * F.sqrt(most) + 1)
    # a loop over the words: so many columns would make a method too long for Java's compiler
    differ = F.aggregate(F.zip_with("print", "l_print", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return alike & ((F.col("level") != F.col("l_level")) | (differ <= most))


def without_near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """The rows of docs, all columns, of the smallest doc_id of each component, one row of it. Rows with a null doc_id stay."""
    kept = written(near_duplicates(docs, percent=percent, width=width).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct(), "mm-kept")
    told = docs.where("doc_id IS NOT NULL")
    one = told.join(kept, told.doc_id == kept.kept_id, "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id IS NULL"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
