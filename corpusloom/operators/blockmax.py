"""Exact top-k search over a postings index of blocks, with bounds from the largest impacts.

The index is one table in two kinds of rows. A range is up to DOCS chunks that one task met in turn; it has a row with the chunks' ids and lengths, and a row for
each of its terms: the block of the term's postings in that range. A chunk's score is a sum over blocks of its own range, so ranges
are searched apart, each by a task that holds only the blocks of the terms asked for.

A ranking takes two passes over these blocks. The first adds up the blocks with the largest impacts only; what the k-th best chunk of a question has of them is the
least that its k-th best score can be. In the second, blocks are added in the order of their largest impacts, and as soon as the rest of them cannot lift a chunk to that
threshold it is left out; a range whose blocks cannot reach it together is not scored at all. Bounds are compared with a margin of one unit of the rounded
score, so ties at the end of a ranking are kept and go to the smaller id.

Questions go out to the tasks in slices of SLICE terms, so what a task and the driver hold is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as tx
from corpusloom.plans.arrow import in_arrow, tidy
from corpusloom.plans.materialize import written

#: Chunks and terms of a range at most (one longer chunk has a range of its own), terms of the questions that go out at once, terms that a scan looks for by name.
DOCS, TERMS, SLICE, FEW = 4096, 1 << 21, 100_000, 500
K1, B, SCALE = 1.2, 0.75, 6
#: The first pass picks chunks when the rest can add less than this share of all; shares of the threshold that the rest can add when the second pass sifts.
SEED, SIFT = 0.4, (0.6, 0.4, 0.25, 0.1)

_BLOCKS = "range long, term string, at binary, tf binary, names array<string>, dl binary, own binary, total long"


@dataclass(frozen=True)
class Postings:
    """The blocks of an index, the number of chunks and their mean number of terms."""

    blocks: DataFrame
    n: int
    avgdl: float


def _blocked(batches, asked: list[str] | None = None):
    """Blocks of the chunks (chunk_id, t) that a task meets; of the terms asked for only, if these are given."""
    task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def out():
        whole = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        n, names, lists = whole.num_rows, whole.column("chunk_id").to_pylist(), whole.column("t").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        del whole, lists  # what follows works in place, on numbers alone
        key = coded.indices.to_numpy().astype(np.int64)
        key *= n
        key += np.repeat(np.arange(n), lengths)
        key.sort()
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        key, tf = key[first], np.diff(first, append=len(key))
        code, at, tf = key // n, (key % n).astype(np.int32), tf.astype(np.int32)
        own = np.bincount(at, minlength=n).astype(np.int32)
        if asked is not None:
            kept = pc.is_in(coded.dictionary, value_set=pa.array(asked, coded.dictionary.type)).to_numpy(zero_copy_only=False)[code]
            code, at, tf = code[kept], at[kept], tf[kept]
        edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
        ends = np.append(edge[1:], len(code))
        cut = lambda x: [x[s:e].tobytes() for s, e in zip(edge, ends)]
        m = len(edge)
        columns = [
            pa.array([task << 32 | made] * (m + 1), pa.int64()), pa.concat_arrays([coded.dictionary.take(pa.array(code[edge])).cast(pa.string()), pa.nulls(1, pa.string())]), pa.array([*cut(at), None], pa.binary()), pa.array([*cut(tf), None], pa.binary()),
            pa.array([None] * m + [names], pa.list_(pa.string())), pa.array([None] * m + [lengths.astype(np.int32).tobytes()], pa.binary()), pa.array([None] * m + [own.tobytes()], pa.binary()),
            pa.array([None] * m + [int(lengths.sum())], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["range", "term", "at", "tf", "names", "dl", "own", "total"])

    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            n = len(part.column("t").flatten())
            if held and (sum(x.num_rows for x in held) + part.num_rows > DOCS or size + n > TERMS):
                yield out()
                tidy()
                made, held, size = made + 1, [], 0
            held.append(part)
            size += n
    if held:
        yield out()


def build(chunks: DataFrame, questions: DataFrame | None = None) -> Postings:
    """The index of chunks (chunk_id, text), or (chunk_id, t) with the terms in order, in one pass without a shuffle. Ids must be unique; a null text has no terms.

    With questions (question_id, question) of up to SLICE terms the index serves these alone, and has no blocks of other terms.
    """
    told = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), (F.col("t") if "t" in chunks.columns else tx.terms(F.col("text"))).alias("t"))
    asked = None
    if questions is not None:
        asked = [r["term"] for r in questions.select(F.explode(tx.terms(F.col("question"))).alias("term")).distinct().limit(SLICE + 1).collect()]
    return of(written(laid_out(told, asked if asked is not None and len(asked) <= SLICE else None), "blocks"))


def laid_out(chunks: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """The blocks of chunks (chunk_id, t), those of a task in the order of their terms, so that a scan for a few terms skips the rest of a file."""
    return in_arrow(chunks.select("chunk_id", "t"), lambda batches: _blocked(batches, asked), _BLOCKS).sortWithinPartitions("term", "range")


def of(blocks: DataFrame) -> Postings:
    """An index from its written blocks."""
    s = blocks.where("term IS NULL").agg(F.sum(F.size("names")).alias("n"), F.sum("total").alias("terms")).first()
    return Postings(blocks, s["n"] or 0, (s["terms"] or 0) / s["n"] if s["n"] else 0.0)


def frequencies(postings: Postings) -> DataFrame:
    """Rows (term, df)."""
    return postings.blocks.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.octet_length("at") / 4).alias("df"))


def _read(group: pa.Table, weight):
    """Of a range: the ids, lengths and numbers of distinct terms of its chunks, and the blocks (places, weights) by term."""
    terms = group.column("term").to_pylist()
    head = terms.index(None)
    ints = lambda x: np.frombuffer(x, np.int32)
    dl, own = (ints(group.column(c)[head].as_py()) for c in ("dl", "own"))
    blocks = {t: (at := ints(a), weight(ints(tf).astype(float), dl[at])) for t, a, tf in zip(terms, group.column("at").to_pylist(), group.column("tf").to_pylist()) if t is not None}
    return np.array(group.column("names")[head].as_py(), object), dl, own, blocks


def _best(names: np.ndarray, at: np.ndarray, scores: np.ndarray, k: int):
    """The first k of a range by rounded score, then id."""
    keys = np.round(scores, SCALE)
    if len(at) > k:
        near = keys >= np.partition(keys, -k)[-k]
        at, scores, keys = at[near], scores[near], keys[near]
    order = sorted(range(len(at)), key=lambda j: (-keys[j], names[at[j]].encode()))[:k]
    return names[at[order]].tolist(), scores[order].tolist()


def _more(at: np.ndarray, acc: np.ndarray, lists: list) -> None:
    """Adds what the blocks give to the chunks at some places."""
    for _, idf, of, w in lists if len(at) else []:
        where = np.minimum(np.searchsorted(of, at), len(of) - 1)
        hit = of[where] == at
        acc[hit] += idf * w[where[hit]]


def _sifted(lists: list, n: int, k: int, least: float | None):
    """Places, scores and the number of chunks that were looked up in all blocks. lists are (idf, (places, weights)); without a threshold only the 2 k chunks to which
    the largest blocks give most are scored."""
    lists = sorted(((idf * w.max(), idf, at, w) for idf, (at, w) in lists), key=lambda x: -x[0])
    rest = np.append(np.cumsum([x[0] for x in lists][::-1])[::-1], 0.0)
    margin = 10.0**-SCALE
    if least is not None and rest[0] < least - margin:
        return np.empty(0, np.int64), np.empty(0), 0
    upto = lambda bound: min(len(lists), int(np.searchsorted(-rest, -bound, side="right")))  # noqa: E731  blocks until the rest adds less
    acc, j = np.zeros(n), upto(SEED * rest[0] if least is None else SIFT[0] * least)
    for _, idf, of, w in lists[:j]:
        acc[of] += idf * w
    at = np.flatnonzero(acc)
    acc = acc[at]
    if least is None:
        if len(at) > 2 * k:
            most = np.argpartition(-acc, 2 * k)[: 2 * k]
            most.sort()
            at, acc = at[most], acc[most]
        _more(at, acc, lists[j:])
        return at, acc, len(at)
    for share in SIFT[1:]:
        stay = acc + rest[j] >= least - margin
        at, acc = at[stay], acc[stay]
        then = max(j, upto(share * least))
        _more(at, acc, lists[j:then])
        j = then
    scored = len(at)
    stay = acc + rest[j] >= least - margin
    at, acc = at[stay], acc[stay]
    _more(at, acc, lists[j:])
    return at, acc, scored


def _searched(asked: dict, k: int, avgdl: float, least: dict | None, report: bool = False):
    weight = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (avgdl or 1.0)))

    def run(group: pa.Table) -> pa.Table:
        names, _, _, blocks = _read(group, weight)
        out: tuple[list, list, list] = ([], [], [])
        for q, terms in asked.items():
            lists = [(idf, blocks[t]) for t, idf in terms if t in blocks]
            if not lists:
                continue
            at, scores, scored = _sifted(lists, len(names), k, None if least is None else least.get(q, 0.0))
            found, scores = ([str(len(np.unique(np.concatenate([b[0] for _, b in lists]))))], [float(scored)]) if report else _best(names, at, scores, k)
            for column, values in zip(out, ([q] * len(found), found, scores)):
                column += values
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["question_id", "chunk_id", "score"])

    return run


def _overlapping(asked: dict, k: int):
    def run(group: pa.Table) -> pa.Table:
        names, _, own, blocks = _read(group, lambda tf, dl: None)
        out: tuple[list, list, list] = ([], [], [])
        for q, terms in asked.items():
            both = np.zeros(len(names))
            for t, _ in terms:
                if t in blocks:
                    both[blocks[t][0]] += 1
            at = np.flatnonzero(both)
            found, scores = _best(names, at, both[at] / (own[at] + len(terms) - both[at]), k)
            for column, values in zip(out, ([q] * len(found), found, scores)):
                column += values
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["question_id", "chunk_id", "score"])

    return run


_FOUND = "question_id string, chunk_id string, score double"


def _by_range(groups, run, kind: str = _FOUND) -> DataFrame:
    """What is found in each range; a worker keeps nothing of a range that it has searched."""

    def tidied(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            tidy()

    return groups.applyInArrow(tidied, kind)


def _needed(postings: Postings, terms: list[str]):
    """The blocks of some terms, range by range with its head."""
    blocks = postings.blocks.select("range", "term", "at", "tf", "names", "dl", "own")
    if len(terms) <= FEW:
        return blocks.where(F.col("term").isin(terms) | F.col("term").isNull()).groupBy("range")
    known = blocks.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return blocks.join(F.broadcast(known), "term", "left_semi").unionByName(blocks.where("term IS NULL")).groupBy("range")


def _slices(postings: Postings, questions: DataFrame):
    """For each slice of the questions: {question: [(term, idf)]}, and the blocks that it asks for, range by range."""
    q = questions.select(F.col("question_id").cast("string").alias("question_id"), F.array_distinct(tx.terms(F.col("question"))).alias("terms"))
    q = written(q.select("question_id", F.explode("terms").alias("term")).distinct(), "asked")
    asked = q.join(frequencies(postings), "term", "left").select("question_id", "term", F.coalesce("df", F.lit(0.0)).alias("df"))
    n = -(-q.count() // SLICE)
    for i in range(n):
        part = asked.where(F.pmod(F.xxhash64("question_id"), F.lit(n)) == i) if n > 1 else asked
        out: dict[str, list] = {}
        for r in part.collect():
            out.setdefault(r["question_id"], []).append((r["term"], float(np.log1p((postings.n - r["df"] + 0.5) / (r["df"] + 0.5)))))
        terms = {t for x in out.values() for t, _ in x}
        if not terms:
            continue
        yield {q: sorted(x) for q, x in out.items()}, _needed(postings, sorted(terms))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.round("score", SCALE).desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "rank", "chunk_id", "score")


def _all(postings: Postings, frames: list[DataFrame]) -> DataFrame:
    out = postings.blocks.sparkSession.createDataFrame([], _FOUND) if not frames else frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _bm25(postings: Postings, questions: DataFrame, k: int, report: bool) -> DataFrame:
    frames = []
    for asked, groups in _slices(postings, questions):
        seeds = _by_range(groups, _searched(asked, k, postings.avgdl, None))
        least = {r["question_id"]: r["score"] for r in _ranked(seeds, k).where(F.col("rank") == k).select("question_id", "score").collect()}
        frames.append(_by_range(groups, _searched(asked, k, postings.avgdl, least, report)))
    return _all(postings, frames)


def bm25(postings: Postings, questions: DataFrame, k: int = 12) -> DataFrame:
    """The k best chunks of each question (question_id, question) by BM25, rows (question_id, rank, chunk_id, score); only scores over 0."""
    return _ranked(_bm25(postings, questions, k, report=False).where("score > 0"), k)


def work(postings: Postings, questions: DataFrame, k: int = 12) -> DataFrame:
    """One row: pairs of a question and a chunk with one of its terms, and how many of them a ranking scores with all blocks."""
    return _bm25(postings, questions, k, report=True).agg(F.sum(F.col("chunk_id").cast("long")).alias("pairs"), F.sum("score").cast("long").alias("scored"))


def _holding(group: pa.Table) -> pa.Table:
    names, _, _, blocks = _read(group, lambda tf, dl: None)
    terms = [t for t, (at, _) in blocks.items() for _ in at]
    ids = [x for at, _ in blocks.values() for x in names[at].tolist()]
    return pa.table([pa.array(terms, pa.string()), pa.array(ids, pa.string())], names=["term", "chunk_id"])


def holders(postings: Postings, terms: list[str]) -> DataFrame:
    """Rows (term, chunk_id) of the chunks that hold one of up to SLICE terms, read from the index, which must serve them."""
    if len(terms) > SLICE:
        raise ValueError(f"{len(terms)} terms are more than go out at once")
    return _by_range(_needed(postings, terms), _holding, "term string, chunk_id string")


def lexical(postings: Postings, questions: DataFrame, k: int = 50) -> DataFrame:
    """Ranking by the Jaccard similarity of term sets: the deterministic stand-in for a model's scores."""
    return _ranked(_all(postings, [_by_range(groups, _overlapping(asked, k)) for asked, groups in _slices(postings, questions)]), k)
