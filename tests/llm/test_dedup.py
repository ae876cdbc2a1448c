"""Near duplicates, repeated strings and benchmark windows against brute force, with odd rows."""

import hashlib
import random
import re

import pytest

from corpusloom.llm import decontaminate, minhash, suffix_dedup

KIND = "doc_id long, text string, lang string, rank int, key string, words string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, out = say(70), []
    for _ in range(60):
        out.append(say(rng.randint(1, 120)))
    for base in out[:12]:  # near copies at many similarities, and a chain of them
        for _ in range(4):
            words = base.split()
            for _ in range(rng.randint(1, max(1, len(words) // 20))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            base = " ".join(words)
            out.append(base)
    out += [f"{say(9)} {passage} {say(9)}" for _ in range(15)] + out[:8]
    out += [None, "", " \t\n", "A b", "a  B", "x", "é" * 60, "ab" * 3000, "ab" * 3000, "z" * 5000 + say(30), out[0].upper()]
    rng.shuffle(out)
    return [(3 * i + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", 1, "k", "w") for i, t in rows], KIND).repartition(3)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            inter = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_equal_brute_force(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == near_groups(rows)


def test_near_duplicates_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)  # more rounds of leaders
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"n{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_groups(rows)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A  b c d e f"), (3, None), (3, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (3, 0, 3, True), (3, 0, 3, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_under_one_doc_id_are_one_node(spark):
    texts = {x: " ".join(f"{x}{i}" for i in range(20)) for x in "abc"}
    rows = [(3, texts["a"]), (5, texts["a"]), (5, texts["b"]), (9, texts["b"]), (11, texts["c"]), (11, None), (12, texts["c"])]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 11, True), (12, 11, False)}


def test_prints_bound_differences():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (3, 100, 511, 700, 5000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.8], rng.integers(0, 2**64, n // 6, dtype=np.uint64)]))
            (i, a), (j, b) = minhash.set_print(x), minhash.set_print(y)
            if i == j:
                under = lambda s: {int(h) for h in s if i == 0 or int(h) >> (64 - i) == 0}
                differ = sum(int(w).bit_count() for w in (a ^ b).view(np.uint64))
                assert differ <= len(under(x) ^ under(y))


def test_signature_estimates_similarity():
    rng = random.Random(0)
    import numpy as np

    for share in (0.3, 0.75):
        x = [rng.getrandbits(64) for _ in range(4000)]
        both = int(len(x) * share)
        a, b = np.array(x[: (len(x) + both) // 2], np.uint64), np.array(x[(len(x) - both) // 2 :], np.uint64)
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - share) < 0.1


def repeats(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if seen.setdefault(raw[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out


@pytest.mark.parametrize("shard, popular", [(4000, 20_000), (150, 500), (4000, 1)])
def test_repeats_equal_brute_force(docs, rows, monkeypatch, shard, popular):
    """With popular phrases only, with popular and rare ones, and with rare ones only; with and without hashes that are cut again."""
    monkeypatch.setattr(suffix_dedup, "POPULAR", popular)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "SLICE", 100)
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == repeats(rows)


def test_repeats_of_odd_rows(spark):
    long = "0123456789" * 12
    rows = [(5, long), (5, long), (None, long), (7, long), (8, None), (9, long[:49])]
    got = sorted(((r.doc_id, r.n_bytes, len(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 120, 120), (5, 120, 120), (None, 120, 120), (7, 120, 0), (8, 0, 0), (9, 49, 49)], key=str)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_of_one_doc_id_with_several_texts(spark):
    long, other = "0123456789" * 12, "".join(map(chr, range(33, 120)))
    rows = [(5, long), (5, other), (4, other), (6, long + other)]
    got = {(r.doc_id, r.n_bytes, len(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 120, 120), (5, 87, 0), (4, 87, 87), (6, 207, 0)}
    kept = suffix_dedup.without_repeats(spark.createDataFrame([(i, t, 7) for i, t in [*rows, (9, None), (None, "x")]], "doc_id long, text string, n_chars int"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(5, long, 7), (4, other, 7), (9, None, 7), (None, "x", 7)], key=str)


def test_posting_bytes_do_not_grow_with_the_shards(rows):
    import pyarrow as pa

    texts = [t for _, t in rows if t and len(t.encode()) >= 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array([None] * len(texts), pa.list_(pa.int32()))], names=["doc_id", "text", "foreign"])
    size, most = {}, 0
    for shards in (4, 64, 1024, 16_384):
        found = next(suffix_dedup._postings(50, shards)([batch]))
        keys = sum(len(x) // 4 for x in found.column("prints").to_pylist())
        size[shards] = sum(len(x) for c in ("docs", "prints", "places", "twice") for x in found.column(c).to_pylist())
        most = max(most, size[shards] / keys)
    assert most <= 8 + 4 + 2 + 1 and size[16_384] < 2.2 * size[4]


def test_slices_of_a_dictionary_agree(monkeypatch):
    import numpy as np

    rng = random.Random(4)
    data = np.frombuffer(bytes(rng.choices(b"ab", k=60)) * 40 + bytes(rng.choices(b"abc", k=3000)), np.uint8)
    starts = np.arange(len(data) - 50)
    owner = np.array(rng.choices(range(50), k=len(starts)))
    whole = suffix_dedup._later(data, starts, owner, 50)
    monkeypatch.setattr(suffix_dedup, "SLICE", 64)
    assert (suffix_dedup._later(data, starts, owner, 50) == whole).all() and 0 < whole.sum() < len(whole)


def test_suffix_ranks_order_suffixes():
    import numpy as np

    raw = bytes(random.Random(2).choices(b"ab", k=4000))
    starts = np.arange(len(raw) - 50)
    rank = suffix_dedup.suffix_ranks(np.frombuffer(raw, np.uint8), starts)
    assert [raw[s : s + 50] for s in starts[np.argsort(rank, kind="stable")]] == sorted(raw[s : s + 50] for s in starts)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(rows, items):
    out = {}
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(10, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    ids.add(str(item))
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_equals_brute_force(spark, docs, rows):
    texts = [t for _, t in rows if t and len(t.split()) > 25]
    items = [(1, " ".join(texts[0].split()[3:18])), (20, texts[1] + " tail"), (3, "x"), (4, None), (5, "..."), (6, texts[2]), (6, texts[3][:80]), (7, "É" * 60), (8, "ab a ab a ab a ab a ab a ab")]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == leaks(rows, items)


def test_decontamination_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.decontaminate(docs, none).collect()} == {0}
    assert decontaminate.decontaminate(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert [r.n_hit for r in decontaminate.decontaminate(odd, spark.createDataFrame([(1, "A B")], "item_id long, text string")).collect()] == [2, 2, 2]


def test_proximity(spark):
    d = spark.createDataFrame([(1, "k b x a z"), (2, "a " + "y " * 50 + "b k"), (3, "a b")], "doc_id long, text string").withColumn("th", __import__("pyspark.sql.functions", fromlist=["x"]).xxhash64("text"))
    from pyspark.sql import functions as F

    tokens = decontaminate.item_terms(spark.createDataFrame([(1, "a b k")], "item_id long, text string"))
    terms = tokens.select("term").distinct().withColumn("tid", F.xxhash64("term"))
    postings = decontaminate.build_index(d, terms)
    known = tokens.join(terms, "term").join(postings.groupBy("tid").agg(F.count("*").alias("freq")), "tid")
    assert {r.doc_id for r in decontaminate.proximity_matches(postings, known, reach=5).collect()} == {1}
