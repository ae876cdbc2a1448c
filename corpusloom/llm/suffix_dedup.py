"""Removal of repeated byte strings across documents, by prefix-free parsing.

A byte is removed if a string of LENGTH bytes covers it that also starts in a document with a smaller
doc_id. Writing out the order of all suffixes of a corpus would cost a row for each byte. Prefix-free
parsing cuts the text at positions that its own bytes choose, so repeated text becomes repeated phrases,
and only the dictionary of phrases and the parse need a suffix order:

1. Coarse phrases begin where a rolling hash hits a trigger value and overlap the next one by
   LENGTH - 1 bytes, so each string of LENGTH bytes starts in exactly one of them. The smallest doc_id
   that has a phrase owns it; every other document's occurrence is a repeat as a whole, and nothing else needs its strings,
   since the smallest document that has a string has it in a phrase of its own. Occurrences meet their owner in a join by phrase, but for popular
   phrases, which would fill a task each: their owners, bounded in number by their share of all occurrences, go out to the tasks, which
   list a document's occurrences in one row.
2. The other strings are cut into fine phrases, the runs of strings whose smallest rolling hash is the same.
   Equal strings have equal smallest hashes, and each string has one, so only hashes that occur in two
   documents can hold a repeat. They are found by 32 bits of each hash, which meet in shards by the hash, after each batch of documents
   has found its own.
3. The parse is the table of fine phrases under such hashes, the dictionary its distinct phrases with the smallest document of each.
   The dictionary goes to shards by hash; a shard orders the suffixes of its phrases by their first LENGTH bytes, and equal ranks give the
   smallest document of each string. The parse joined with that gives the runs: a phrase in another document than its
   owner goes as a whole, in the owner go the strings that a smaller document has.
   Copies of a passage are one row of the dictionary. A hash whose distinct phrases have more than SHARD strings, such as the last bytes of a popular
   passage before texts that differ, is cut again, by the smallest hash of longer strings: of those so long that LENGTH has hardly room for
   two, so that few phrases can share one.

The parse is not put in suffix order: phrases overlap by LENGTH - 1 bytes, so the dictionary's order decides every string of LENGTH bytes, and
the parse's order would only rank equal ones, which the smallest document settles.

The result is exact. A null text is empty. Documents with a null doc_id neither remove nor lose bytes.
Rows that share a doc_id are one document for the comparison: none removes another's bytes, and each row is answered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import in_arrow, slices, table
from corpusloom.plans.materialize import bucketed, forget, written

LENGTH = 50
GRAM = 24
TRIGGER = 128
#: Bytes of a text that are hashed at once, strings of a dictionary shard and most strings of one hash (of more, the phrases are cut again), strings
#: that are written out and put in order at once, strings of a fine phrase.
PIECE, SHARD, SLICE, RUN = 1 << 20, 1 << 20, 1 << 17, 128
#: Coarse phrases with at least one in so many of all occurrences are popular; there are so many of them at most.
POPULAR = 20_000
#: Bytes of text whose keys a shard meets, about: a key for each 14 of them.
KEYS = 16 << 20

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_U = [np.uint64(x) for x in (8, 16, 32, 29)]


def _octets(t: np.ndarray) -> np.ndarray:
    """Eight bytes at each position as one integer, the first byte lowest."""
    x = t.astype(np.uint64)
    x = x[:-1] | (x[1:] << _U[0])
    x = x[:-2] | (x[2:] << _U[1])
    return x[:-4] | (x[4:] << _U[2])


def _scattered(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> _U[2])) * _M[by]
    return x ^ (x >> _U[3])


def minima(t: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Yields (offset, smallest hash of gram bytes in each string of length bytes that starts from there on), piece by piece."""
    wide, steps = length - gram + 1, gram // 8
    for at in range(0, max(0, len(t) - length + 1), PIECE):
        h = _scattered(_octets(t[at : at + PIECE + length - 1]), 0)
        n = len(h) - 8 * (steps - 1)
        m = h[:n]
        for i in range(1, steps):
            m = _scattered(m * _M[1] + h[8 * i : 8 * i + n], 2)
        span = 1
        while 2 * span <= wide:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if rest := wide - span:
            m = np.minimum(m[:-rest], m[rest:])
        yield at, m


def coarse_cuts(t: np.ndarray) -> np.ndarray:
    """Where coarse phrases begin: 0 and each trigger position. Runs of one hash value trigger once."""
    cuts = [np.zeros(1, np.int64)]
    for at in range(0, len(t) - 8, PIECE):
        h = _scattered(_octets(t[at : at + PIECE + 8]), 1)
        hit = ((h[1:] >> _U[2]) % np.uint64(TRIGGER) == 0) & (h[1:] != h[:-1])
        cuts.append(np.flatnonzero(hit) + (at + 1))
    return np.concatenate(cuts)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _coarse(length: int):
    def run(batches):
        for b in slices(batches):
            where, keys, index = [], [], []
            for i, raw in enumerate(_bytes(b.column("text"))):
                cuts = coarse_cuts(np.frombuffer(raw, np.uint8)).tolist()
                last = len(raw) - length
                for k, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(raw)])):
                    if s <= last:
                        keys.append(xxhash.xxh3_128_digest(raw[s : e + length - 1]))
                        where.append(i), index.append(k)
            at = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column("doc_id").take(at), b.column("th").take(at), pa.array(index, pa.int32())], names=["key", "doc_id", "th", "idx"])

    return run


def _owned(t: np.ndarray, foreign: list[int] | None, length: int) -> np.ndarray:
    """Whether each string of a text starts in a coarse phrase that no other document owns."""
    own = np.ones(len(t) - length + 1, bool)
    if foreign:
        cuts = np.append(coarse_cuts(t), len(t))
        for k in foreign:
            own[cuts[k] : cuts[k + 1]] = False
    return own


def _runs(t: np.ndarray, own: np.ndarray, length: int):
    """Yields (starts, ends, smallest hashes) of the fine phrases of a text's own strings, piece by piece."""
    for at, m in minima(t, length):
        o = own[at : at + len(m)]
        edge = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (o[1:] != o[:-1]))))
        ends = np.append(edge[1:], len(m))
        keep = o[edge]
        yield edge[keep] + at, ends[keep] + at, m[edge[keep]]


def _keys(v: np.ndarray, shards: int) -> np.ndarray:
    """Smallest hashes as keys: a shard, and 32 bits that tell most hashes of a shard apart."""
    h = _scattered(v, 1)
    return ((h >> _U[2]) % np.uint64(shards) << _U[2]) | (h & np.uint64(0xFFFFFFFF))


_MET = "shard int, docs binary, prints binary, places binary, twice binary, doc_id long, key long"


def _popular(owners: list):
    """Rows (doc_id, th, places): the occurrences of popular phrases (key, owner) in a text whose document is not the owner, one row for each text of a batch."""
    keys = pa.array([bytes(r["key"]) for r in owners], pa.binary())
    owner_of = np.array([r["owner"] for r in owners], np.int64)

    def run(batches):
        for b in batches:
            found = pc.index_in(b.column("key"), value_set=keys)
            at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            doc, th, idx = (b.column(c).to_numpy(zero_copy_only=False)[at] for c in ("doc_id", "th", "idx"))
            later = doc > owner_of[found.drop_null().to_numpy(zero_copy_only=False)]
            doc, th, idx = doc[later], th[later], idx[later]
            order = np.lexsort((idx, th, doc))
            doc, th, idx = doc[order], th[order], idx[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]))))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(idx, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(doc[first], pa.int64()), pa.array(th[first], pa.int64()), places], names=["doc_id", "th", "places"])

    return run


def _postings(length: int, shards: int):
    """Which keys the documents of a batch have.

    A row for each shard has each key of the batch once, with one of its documents, as a place among the ids that the row's own keys have, and whether
    it has more; so a row's size depends on its keys alone, however many shards there are. Those keys that have more are known to be shared, so these documents need no answer: they follow as rows of doc_id and key. So a shard meets a
    popular key once a batch.
    """

    def run(batches):
        for b in batches:
            own = []
            for raw, foreign in zip(_bytes(b.column("text")), b.column("foreign").to_pylist()):
                t = np.frombuffer(raw, np.uint8)
                own.append(np.unique(_keys(np.concatenate([v for _, _, v in _runs(t, _owned(t, foreign, length), length)]), shards)))
            keys, doc = np.concatenate(own or [np.empty(0, np.uint64)]), np.repeat(np.arange(len(own)), [len(k) for k in own])
            order = np.argsort(keys, kind="stable")
            keys, doc, ids = keys[order], doc[order], b.column("doc_id").to_numpy()
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
            count = np.diff(np.append(first, len(keys)))
            known = np.repeat(count > 1, count)
            key, place, twice = keys[first], doc[first], count > 1
            shard = (key >> _U[2]).astype(np.int64)
            edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
            parts = list(zip(edge, [*edge[1:], len(shard)]))
            cut = lambda x: pa.array([x[s:e].tobytes() for s, e in parts], pa.binary())  # noqa: B023, E731
            none = lambda kind, n: pa.nulls(n, kind)
            names = ["shard", "docs", "prints", "places", "twice", "doc_id", "key"]
            used, places = [], []
            for s, e in parts:
                of, at = np.unique(place[s:e], return_inverse=True)
                used.append(ids[of].tobytes()), places.append(at.astype(np.int16 if len(of) < 1 << 15 else np.int32).tobytes())
            columns = [pa.array(shard[edge] if parts else [], pa.int32()), pa.array(used, pa.binary()), cut(key.astype(np.uint32)), pa.array(places, pa.binary()), cut(twice.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([*columns, none(pa.int64(), len(parts)), none(pa.int64(), len(parts))], names=names)
            n = int(known.sum())
            yield pa.RecordBatch.from_arrays([none(pa.int32(), n), *[none(pa.binary(), n)] * 4, pa.array(ids[doc[known]], pa.int64()), pa.array(keys[known].view(np.int64))], names=names)

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Of a shard: the documents and keys of which another batch, or another document of some batch, has the key too."""
    shard = group.column("shard")[0].as_py()
    read = lambda name, kind: [np.frombuffer(x, kind) for x in group.column(name).to_pylist()]
    prints, twice = np.concatenate(read("prints", np.uint32)), np.concatenate(read("twice", np.uint8)).astype(bool)
    places = [np.frombuffer(x, np.int16 if len(x) == 2 * n else np.int32) for x, n in zip(group.column("places").to_pylist(), map(len, read("prints", np.uint32)))]
    ids = np.concatenate([docs[at] for docs, at in zip(read("docs", np.int64), places)])
    order = np.argsort(prints, kind="stable")
    prints, twice, ids = prints[order], twice[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
    count = np.diff(np.append(first, len(prints)))
    shared = np.repeat((count > 1) | np.logical_or.reduceat(twice, first), count) & ~twice
    return pa.table({"doc_id": ids[shared], "key": prints[shared].astype(np.int64) | (shard << 32)})


_PARSE = "v long, ph binary, doc_id long, th long, start long, phrase binary"


class _Parse:
    """Rows of a parse that are being gathered: of each a hash, the row it comes from, its start, and its bytes."""

    def __init__(self):
        self.v, self.row, self.start, self.phrase = [], [], [], []

    def add(self, raw: bytes, row: int, starts, ends, values, length: int) -> None:
        for s, e, v in zip(starts.tolist(), ends.tolist(), values.view(np.int64).tolist()):
            for x in range(s, e, RUN):
                self.v.append(v), self.row.append(row), self.start.append(x), self.phrase.append(raw[x : min(x + RUN, e) + length - 1])

    def batch(self, b: pa.RecordBatch, doc: str, place: str) -> pa.RecordBatch:
        at = pa.array(self.row, pa.int64())
        keys = pa.array(map(xxhash.xxh3_128_digest, self.phrase), pa.binary())
        columns = [pa.array(self.v, pa.int64()), keys, b.column(doc).take(at), b.column(place).take(at), pa.array(self.start, pa.int64()), pa.array(self.phrase, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["v", "ph", "doc_id", place, "start", "phrase"])


def _fine(length: int, shards: int):
    """Fine phrases under shared hashes, without the strings of coarse phrases that another document owns."""

    def run(batches):
        for b in slices(batches, 256):
            found = _Parse()
            rows = zip(_bytes(b.column("text")), b.column("shared").to_pylist(), b.column("foreign").to_pylist())
            for i, (raw, shared, foreign) in enumerate(rows):
                t, shared = np.frombuffer(raw, np.uint8), np.sort(np.array(shared, np.int64).view(np.uint64))
                for s, e, v in _runs(t, _owned(t, foreign, length), length):
                    key = _keys(v, shards)
                    keep = shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key
                    found.add(raw, i, s[keep], e[keep], v[keep], length)
            yield found.batch(b, "doc_id", "th")

    return run


def _cut_again(length: int):
    """Phrases of the dictionary cut by the smallest hash of strings nearly as long as length; ph becomes their place."""

    def run(batches):
        for b in slices(batches, 1024):
            found = _Parse()
            for i, raw in enumerate(b.column("phrase").to_pylist()):
                t = np.frombuffer(raw, np.uint8)
                for at, m in minima(t, length, length // 8 * 8):
                    edge = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
                    found.add(raw, i, edge + at, np.append(edge[1:], len(m)) + at, m[edge], length)
            b = b.rename_columns(["whole" if c == "ph" else c for c in b.schema.names])
            yield found.batch(b, "owner", "whole")

    return run


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of the suffix at each start among all, by its first length bytes: equal strings, equal ranks. Starts must have length bytes after them."""
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[starts])
    coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(strings), [None, pa.py_buffer(strings)]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()]


def _later(data: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Whether the string at each start has an equal one with a smaller owner. Strings are put in order by slices of about SLICE; equal ones fall into one slice."""
    gone = np.zeros(len(starts), bool)
    slices_ = -(-len(starts) // SLICE)
    if slices_ > 1:
        h = _octets(data)
        deal = ((_scattered(h[starts] * _M[1] + h[starts + length - 8], 2) >> _U[2]) % np.uint64(slices_)).astype(np.int32)
    for i in range(slices_):
        at = np.flatnonzero(deal == i) if slices_ > 1 else np.arange(len(starts))
        if len(at):
            rank = suffix_ranks(data, starts[at], length)
            least = np.full(rank.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, rank, owner[at])
            gone[at] = least[rank] < owner[at]
    return gone


_TOLD = "ph binary, owner long, cuts array<struct<lo: int, hi: int>>"


def _ordered(length: int):
    """Of the phrases of a shard of the dictionary: what is to go from them in their owner's text, as runs of strings."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        owner = group.column("owner").to_numpy()
        _, of_hash, met = np.unique(group.column("v").to_numpy(), return_inverse=True, return_counts=True)
        several = np.flatnonzero(met[of_hash] > 1)  # a phrase alone under its hash shares no string
        cuts: dict[int, list] = {}
        if len(several):
            phrases = group.column("phrase").take(pa.array(several)).to_pylist()
            n = np.fromiter(map(len, phrases), np.int64, len(phrases))
            begin, many = np.cumsum(n) - n, n - length + 1
            first = np.cumsum(many) - many
            of = np.repeat(np.arange(len(n), dtype=np.int32), many)
            starts = begin[of] + np.arange(len(of)) - first[of]
            gone = _later(np.frombuffer(b"".join(phrases), np.uint8), starts, owner[several][of], length)
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (gone[1:] != gone[:-1])
            edge = np.flatnonzero(new)
            ends = np.append(edge[1:], len(of))
            kept = gone[edge]
            for p, lo, hi in zip(of[edge[kept]].tolist(), edge[kept].tolist(), ends[kept].tolist()):
                cuts.setdefault(int(several[p]), []).append({"lo": lo - int(first[p]), "hi": hi - int(first[p])})
        tell = np.flatnonzero(group.column("top").to_numpy() > owner)
        rows = sorted({*tell.tolist(), *cuts})
        at = pa.array(rows, pa.int64())
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.table({"ph": group.column("ph").take(at), "owner": group.column("owner").take(at), "cuts": pa.array([cuts.get(i, []) for i in rows], kind)})

    return run


def _resolved(parse: DataFrame, place: str, length: int, again: bool = True) -> DataFrame:
    """Rows (doc_id, place, lo, hi): strings of the phrases of a parse that start in a smaller document too."""
    words = parse.groupBy("ph").agg(F.min("v").alias("v"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("top"), F.first("phrase").alias("phrase"))
    words = written(words, "pfp-dictionary")
    strings = F.sum(F.length("phrase") - length + 1)
    shards = 1 + 2 * (words.agg(strings).first()[0] or 0) // SHARD
    popular = written(words.groupBy("v").agg(strings.alias("n")).where(f"n > {SHARD}").select("v"), "pfp-popular") if again else None
    cut = popular is not None and not popular.isEmpty()
    plain = words.join(popular, "v", "left_anti") if cut else words
    told = plain.groupBy(F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard")).applyInArrow(_ordered(length), _TOLD)
    if cut:
        hot = words.join(popular, "v", "left_semi")
        finer = written(in_arrow(hot.select("ph", "owner", "phrase"), _cut_again(length), _PARSE.replace("th long", "whole binary")), "pfp-finer")
        runs = _resolved(finer, "whole", length, again=False).groupBy(F.col("whole").alias("ph"))
        runs = runs.agg(F.collect_set(F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))).alias("cuts"))
        told = told.unionByName(hot.select("ph", "owner").join(runs, "ph", "left").select("ph", "owner", F.coalesce("cuts", F.array().cast("array<struct<lo: int, hi: int>>")).alias("cuts")))
    told = written(told, "pfp-told")
    forget(words, *([popular] if again else []))
    n = (F.length("phrase") - length + 1).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("lo"), n.alias("hi")))
    runs = parse.select("ph", "doc_id", place, "start", n.alias("n"), whole.alias("all")).join(told, "ph")
    runs = runs.select("doc_id", place, "start", F.inline(F.when(F.col("doc_id") > F.col("owner"), F.col("all")).otherwise(F.col("cuts"))))
    return runs.select("doc_id", place, (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))


def _cut(length: int, decoded: bool):
    """The final rows: removed spans and the bytes that stay, or the text that stays."""

    def run(batches):
        for b in slices(batches, 256):
            n, spans, kept = [], [], []
            for raw, foreign, runs in zip(_bytes(b.column("text")), b.column("foreign").to_pylist(), b.column("runs").to_pylist()):
                n.append(len(raw))
                if not foreign and not runs:
                    spans.append([]), kept.append(raw)
                    continue
                lows, highs = [r["lo"] for r in runs or ()], [r["hi"] for r in runs or ()]
                if foreign:
                    cuts = np.append(coarse_cuts(np.frombuffer(raw, np.uint8)), len(raw))
                    f = np.array(foreign)
                    lows += cuts[f].tolist()
                    highs += np.minimum(cuts[f + 1], len(raw) - length + 1).tolist()
                at = sorted(zip(lows, highs))
                merged = []
                for s, e in at:
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e + length - 1)
                    else:
                        merged.append([s, e + length - 1])
                spans.append([{"start": s, "end": e} for s, e in merged])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                kept.append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            text = b.column("text")
            b = b.drop_columns(["text", "foreign", "runs"])
            if decoded:  # an untouched text stays as it is, null or empty
                left = pa.array([x.decode("utf-8", "ignore") if s else None for x, s in zip(kept, spans)], pa.string())
                left = pc.if_else(pa.array([bool(s) for s in spans], pa.bool_()), left, text)
            else:
                left = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(spans, kind), left], names=[*b.schema.names, "n_bytes", "spans", "text" if decoded else "kept"])

    return run


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _removed(d: DataFrame, length: int, decoded: bool) -> DataFrame:
    """d, of columns doc_id, text and any others, with n_bytes, spans and kept (or text, if decoded) in place of text."""
    if length < 2 * GRAM:
        raise ValueError("length must be at least 48 bytes")
    takes_part = F.coalesce(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length), F.lit(False))
    texts = bucketed(d.where(takes_part).withColumn("th", F.xxhash64("text")).withColumn("bytes", F.octet_length("text").cast("long")), "pfp-texts", "doc_id")
    told = texts.select("doc_id", "th", "text")
    coarse = written(in_arrow(told, _coarse(length), "key binary, doc_id long, th long, idx int"), "pfp-coarse")
    owned = coarse.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("top"), F.count("*").alias("n")).where("owner < top")
    owned = written(owned.select("key", "owner", "n"), "pfp-owned")
    often = coarse.count() / POPULAR
    popular = owned.where(F.col("n") >= often).select("key", "owner").collect()
    rare = coarse.join(owned.where(F.col("n") < often).select("key", "owner"), "key").where("doc_id > owner").select("doc_id", "th", F.array("idx").alias("places"))
    foreign = rare.unionByName(in_arrow(coarse, _popular(popular), "doc_id long, th long, places array<int>"))
    foreign = written(foreign.groupBy("doc_id").agg(F.collect_set(F.struct("th", "places")).alias("f")), "pfp-foreign")
    forget(coarse, owned)
    its_own = lambda lists: F.filter(lists, lambda x: x["th"] == F.col("th"))
    places = F.flatten(F.transform(its_own("f"), lambda x: x["places"]))
    told = told.join(foreign, "doc_id", "left").withColumn("foreign", places).drop("f")
    # a filter only, so rows of one doc_id may share their hashes, and two hashes a key
    shards = 1 + (texts.agg(F.sum("bytes")).first()[0] or 0) // KEYS
    met = written(in_arrow(told.select("doc_id", "text", "foreign"), _postings(length, shards), _MET), "pfp-keys")
    flags = met.where("shard IS NOT NULL").select("shard", "docs", "prints", "places", "twice").groupBy("shard").applyInArrow(_shared, "doc_id long, key long")
    flags = flags.unionByName(met.where("shard IS NULL").select("doc_id", "key")).groupBy("doc_id").agg(F.collect_set("key").alias("shared"))
    flags = written(flags, "pfp-shared")
    forget(met)
    parse = written(in_arrow(told.join(flags, "doc_id"), _fine(length, shards), _PARSE), "pfp-parse")
    runs = _resolved(parse, "th", length).groupBy("doc_id").agg(F.collect_list(F.struct("th", "lo", "hi")).alias("r"))
    runs = written(runs, "pfp-runs")
    forget(parse, flags)
    out = texts.join(foreign, "doc_id", "left").join(runs, "doc_id", "left")
    out = out.withColumn("foreign", places).withColumn("runs", F.transform(its_own("r"), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))))
    out = out.select(*d.columns, "foreign", "runs")
    idle = d.where(~takes_part).select(*d.columns, F.lit(None).cast("array<int>").alias("foreign"), F.lit(None).cast("array<struct<lo: bigint, hi: bigint>>").alias("runs"))
    kind = [f for f in d.schema.fields if f.name != "text"]
    kind += [T.StructField("n_bytes", T.LongType()), T.StructField("spans", _SPANS), T.StructField("text", T.StringType()) if decoded else T.StructField("kept", T.BinaryType())]
    return in_arrow(out.unionByName(idle), _cut(length, decoded), T.StructType(kind))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (doc_id, n_bytes, spans, kept), one for each row of docs.

    spans are the maximal removed runs as byte offsets, kept is what stays. The text's 64-bit hash
    tells rows of one doc_id apart. Strings are judged on the input, not on what is left.
    length must be at least 48 bytes. Empty tables give empty results; other columns are not read.
    """
    return _removed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), length, decoded=False)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the kept text of each row in its place, and its length in n_chars where there is such a column.

    A character that a cut splits goes as a whole. Rows whose text is removed altogether are dropped; rows that had no text stay.
    """
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    found = _removed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("row")), length, decoded=True)
    found = found.where((F.size("spans") == 0) | (F.length("text") > 0))
    put = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[put[c].alias(c) if c in put else F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
