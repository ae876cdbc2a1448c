"""Tokens, languages, chat, shards, URLs, archives and media: round trips, the public library, brute force."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import bpe, chat, langid, media, sharding, urlfilter, warc

SF = "/root/testdata/sf0.001"
ODD = ["", "A", "<|endoftext|>x<|startoftext|>", "ΑΣ ΟΔΟΣ İß", "a" * 5000, "ab" * 400, "don't WE'LL 12½", "\x1c\x1f\x85\u2028|\ufeff", "é́ﬁ中文👍🏽", "!" * 300, "\\### Assistant: </turn> ok", "a\x00b"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None, "A"])] + [(None, "null id"), (3, "again")], "doc_id long, text string")


def test_bpe_equals_the_library(documents, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d in (documents.select("doc_id", "text"), odd):
        texts = {(r.doc_id, hashlib.sha1((r.text or "").encode()).hexdigest()): r.text or "" for r in d.collect()}
        want = sorted((str(k[0]), tuple((ids := t.encode(x, add_special_tokens=False).ids)), t.decode(ids, skip_special_tokens=False)) for k, x in texts.items())
        got = sorted({(str(r.doc_id), tuple(r.ids), r.decoded) for r in bpe.encode_decode(d).collect()})
        assert got == want


def test_bpe_of_random_strings():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e, rng = Tokenizer.from_file(path), bpe.Encoder(bpe.Lexicon(path, ["zzyzx", "中文字"])), random.Random(3)
    for _ in range(1500):
        x = "".join(rng.choice(" \t\n\x1c\x85\xa0aAbBzyx'sS!.,<|>éß\u0301Σ中文字①½012👍") for _ in range(rng.randint(0, 70)))
        assert list(e.encode(x)) == t.encode(x, add_special_tokens=False).ids


def test_automaton_numbers_words():
    rng = random.Random(1)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randint(1, 6))) for _ in range(300)})
    a = bpe.Automaton(bpe.compile_automaton(words))
    assert [a.number(w) for w in words] == list(range(len(words)))
    assert {a.number(w + b"d") for w in words} == {-1}


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(d, per_lang=60).join(d.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_of_odd_rows(spark, documents, odd):
    from pyspark.sql import functions as F

    train = documents.select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.identify(train.unionByName(odd.where("doc_id <> 3").select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang")))).collect()}
    assert got[10**6].lang_pred == "und" and got[10**6 + 9].lang_pred == "und" and got[10**6 + len(ODD)].lang_pred == "und"
    assert got[10**6 + 1].lang_pred in {"de", "en", "es", "fr"} and 0 <= got[10**6 + 1].score <= 1
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def _piece_probabilities(m, pieces):
    out = {}
    for p in pieces:
        at = np.array([1])
        for letter in m.trie.letters(p):
            at = m.trie.step(at, np.array([letter]))
        out[p] = m.prob[at[0], 0] if at[0] else 0.0
    return out


def test_forward_sums_all_segmentations():
    from functools import cache

    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab"]
    m = langid.fit({"x": {"ab": 3, "ba": 1, "aab": 2}}, pieces)
    prob = _piece_probabilities(m, pieces)

    @cache
    def total(s):
        return 1.0 if not s else sum(prob.get(s[:i], 0.0) * total(s[i:]) for i in range(1, min(4, len(s)) + 1)) + (langid.UNKNOWN * total(s[1:]) if s[0] == "z" else 0)

    words = ["ab", "abab", "b", "abba" * 6, "abba" * 9 + "z", "ba" * 40 + "a", "abz" * 33]
    assert np.allclose(np.exp(langid.word_scores(m, words))[:, 0], [total("▁" + w) for w in words], rtol=1e-9, atol=0)
    for w in ("abba" * 6, "ab" * 200, "ba" * 7000):  # the same in logarithms, and over stretches
        assert np.allclose(langid._long_score(m, m.trie.letters("▁" + w)), langid.word_scores(m, [w])[0])
    whole, stretched = m.trie.letters("▁" + "abab" * 40), langid.STRETCH
    want = langid._long_score(m, whole)
    try:
        langid.STRETCH = 7
        assert np.allclose(langid._long_score(m, whole), want)
    finally:
        langid.STRETCH = stretched


def test_fit_equals_brute_force(monkeypatch):
    pieces, words = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab"], {"ab": 3, "ba": 1, "aab": 2, "abbabab": 4}

    def cuts(s):
        if not s:
            yield ()
        for p in pieces:
            if s.startswith(p):
                for rest in cuts(s[len(p) :]):
                    yield (p, *rest)

    prob = dict.fromkeys(pieces, 1 / len(pieces))
    for _ in range(langid.ROUNDS):
        used = dict.fromkeys(pieces, 0.0)
        for w, n in words.items():
            ways = [(c, np.prod([prob[p] for p in c])) for c in cuts("▁" + w)]
            for c, x in ways:
                for p in c:
                    used[p] += n * x / sum(y for _, y in ways)
        sums = sum(used.values()) + langid.SMOOTH * len(pieces)
        prob = {p: (used[p] + langid.SMOOTH) / sums for p in pieces}
    for long in (langid.LONG, 4):  # also with words that count as long
        monkeypatch.setattr(langid, "LONG", long)
        monkeypatch.setattr(langid, "_SHORT", ((1, long),))
        got = _piece_probabilities(langid.fit({"x": words}, pieces), pieces)
        assert np.allclose([got[p] for p in pieces], [prob[p] for p in pieces])


def test_languages_of_one_script_without_spaces(spark):
    rng = random.Random(4)
    often = {"p": (6, 3, 2, 1), "q": (1, 2, 3, 6)}
    rows = [(i, "".join(rng.choices("天地人水", often[l], k=rng.randint(40, 900))), l) for i, l in enumerate("pq" * 60)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert len(got) > 20
    told = {i: l for i, _, l in rows}
    assert sum(told[r.doc_id] == r.lang_pred for r in got) / len(got) > 0.9


def test_trie_is_sparse():
    pieces = [chr(0x4E00 + i) + chr(0x4E00 + i * 7 % 3000) for i in range(3000)] + [chr(0x4E00 + i) for i in range(3000)]
    t, ends = langid.trie(pieces)
    assert len(t.owner) < 5 * len(pieces)
    node = np.ones(len(pieces), np.int64)
    letters = [t.letters(p) for p in pieces]
    for d in range(2):
        node = np.where([len(x) > d for x in letters], t.step(node, np.array([x[d] if len(x) > d else 0 for x in letters])), node)
    assert (node == ends).all() and len(set(ends.tolist())) == len(pieces)


def test_chat_round_trip(spark):
    rng = random.Random(2)
    say = lambda: "".join(rng.choice(["### ", "</turn>", "\n", "\\", ": ", "a", "é", "<", "#", "Assistant"]) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b\\", ""]), rng.choice([say(), None])) for c in range(30) for t in range(rng.randint(1, 6))]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in range(30):
        turns = [(r, t or "") for k, _, r, t in sorted(rows, key=lambda x: x[:2]) if k == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_control_ids_come_from_the_template_only(spark):
    rows = [(1, 0, "user", "### x: </turn>\n"), (1, 1, "assistant", "</turn>\n### ")]
    _, first = chat.coder()
    ids = [i for r in chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() for i in r.ids]
    assert [i for i in ids if i >= first] == [first, first + 1, first + 2] * 2


def test_sharding(spark):
    rng = random.Random(4)
    texts = [None, "", *["x" * rng.randint(1, 300) + str(rng.randrange(40)) for _ in range(900)]]
    rows = [(i, rng.choice(texts)) for i in range(2500)] + [(5, "again"), (None, "no id")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == len(rows)
    assert (got.groupby(["size", "text_crc32"])["shard"].nunique() == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    groups = {}
    for _, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 1
    heap = [0] * 16
    for s in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + s)
    loads = got.groupby("shard")["size"].sum()
    assert sorted(loads.reindex(range(16), fill_value=0)) == sorted(heap)
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deal_equals_the_heap():
    rng = random.Random(0)
    for _ in range(200):
        loads = [rng.randint(0, 50) for _ in range(rng.randint(1, 16))]
        size, count = rng.randint(1, 9), rng.randint(0, 300)
        heap, want = [(x, i) for i, x in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(count):
            load, i = heap[0]
            want[i] += 1
            heapq.heapreplace(heap, (load + size, i))
        assert sharding.deal(list(loads), size, count) == want


def test_url_rules(spark):
    urls = ["http://A.example.NET/en/x?y#z", "https://example.com/de/", "x://net", "x://a.net/", "http://b.org/fr/1", "http://b.org/frx", "no scheme", None, "http://u@example.net:80/en/", "a://b://net/x", "http://net.com/net/"]
    want = [("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("net", "", None, "allow"), ("a.net", "/", "net/", "block"), ("b.org", "/fr/1", "org/fr/", "allow"),
            ("b.org", "/frx", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("u@example.net:80", "/en/", None, "allow"), ("b:", "//net/x", None, "allow"), ("net.com", "/net/", None, "allow")]
    got = sorted(urlfilter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), urlfilter.CONTRACT_RULES).collect())
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == want


def test_pattern_rules_run_only_for_their_tokens():
    calls = []

    class Spy:
        def match(self, url):
            calls.append(url)
            return None

    rule = urlfilter.pattern_rule("ads", "block", r".*/ads/.*", ("ads",))
    object.__setattr__(rule, "compiled", Spy())
    index = urlfilter.RuleIndex([rule, *urlfilter.CONTRACT_RULES])
    index.judge("a.com", "/news/1")
    assert calls == []
    index.judge("a.com", "/ads/1")
    assert calls == ["a.com/ads/1"]


def test_archives_round_trip(spark):
    big = "<p>é" * 90
    rows = [(1, "http://a/\r\nX: y", big), (2, "http://b", "short"), (3, None, None), (4, "http://c", big), (5, "u", "short"), (None, "n", big), (7, "v", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[page].record_type, got[page].refers_to) == (("revisit", 1) if page == 4 else ("response", None))
        assert page == 4 or bytes(got[page].payload) == raw
    assert warc.read_archives(warc.write_archives(pages.where("page_id > 99"))).count() == 0


def test_damaged_archives_fail():
    one = warc.record(1, "u", b"x" * 500)
    assert len(list(warc.records(one + warc.record(2, "v", b"")))) == 2
    for bad in (one[:-5], one[:40] + b"\0\0\0" + one[43:], zlib.compress(b"x")):
        with pytest.raises(warc.WarcError):
            list(warc.records(bad))


def test_media_round_trip(spark, documents, odd):
    for d in (documents.select("doc_id", "text"), odd):
        texts = {}
        for r in d.collect():
            texts.setdefault(r.doc_id, set()).add(hashlib.sha256(media.padded((r.text or "").encode())).hexdigest())
        for r in media.read_media(media.to_media(d)).collect():
            assert r.payload_sha256 in texts[r.doc_id] and r.payload_bytes % 64 == 0


def test_foreign_huffman_tables_decode():
    payload = media.padded(bytes(random.Random(1).choices(range(256), k=900)))
    frames = media.jpeg_frames(payload, 15, 120, 8)
    values = media.jpeg_coefficients(frames)[0]
    slow = [media._decoded_bits(p.replace(b"\xff\0", b"\xff"), 1, media._huffman(media._SINGLE), media._huffman(media._SINGLE)) for f in frames for p in media._SPLIT.split(f[f.index(b"\xff\xda") + 10 : f.rindex(b"\xff\xd9")])]
    assert (np.concatenate(slow) == values).all()


def test_shots_are_found():
    a, b = np.array([100] + [1] * 15), np.array([1] * 15 + [100])
    assert media.shots(np.array([a] * 6 + [b] * 5 + [a] * 4)) == [(0, 6), (6, 11), (11, 15)]
    assert media.shots(np.array([a] * 7)) == [(0, 7)]
