"""Archives of other origin, stored media by an independent decoder, pattern rules by SQL, and odd tables for the operators of one row at a time."""

import base64
import gzip
import hashlib
import math
import struct
import zlib

import duckdb
import pytest

from corpusloom.llm import bpe, chat, langid, media, sharding, urlfilter, warc
from corpusloom.plans.materialize import written


def member(kind, block, **head):
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{len(block)}-{kind}>", "Content-Length": len(block)} | {k.replace("_", "-"): v for k, v in head.items()}
    return gzip.compress(b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n")


def sha1(raw):
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_archives_of_other_origin(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    web = {"Content_Type": "application/http; msgtype=response"}
    content = (
        member("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields")
        + member("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request")
        + member("response", http, **web, WARC_Block_Digest=sha1(http), WARC_Payload_Digest=sha1(b"hello"), WARC_Target_URI="http://a/")
        + member("metadata", b"a: b", WARC_Block_Digest="xxh3:77")
        + member("resource", b"plain", WARC_Payload_Digest="sha256:" + hashlib.sha256(b"plain").hexdigest())
        + member("revisit", http[:-5], **web, WARC_Payload_Digest=sha1(b"hello"), WARC_Refers_To=f"<urn:uuid:{len(http)}-response>")
        + member("revisit", b"", **web, WARC_Payload_Digest=sha1(b"gone"), WARC_Refers_To="<urn:uuid:none>")
    )
    (tmp_path / "x.warc.gz").write_bytes(content)
    read = written(warc.read_archives(warc.archive_files(spark, str(tmp_path))), "test-read")
    got = [(r.record_type, r.payload_bytes, r.payload_digest) for r in warc.resolved(read).collect()]
    hello, plain = (hashlib.sha256(x).hexdigest() for x in (b"hello", b"plain"))
    want = [("warcinfo", None, None), ("request", None, None), ("response", 5, hello), ("metadata", None, None), ("resource", 5, plain), ("revisit", 5, hello), ("revisit", None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    for bad in (member("response", http, **web, WARC_Block_Digest=sha1(b"other")), member("response", http, **web, WARC_Payload_Digest=sha1(b"other")), member("resource", b"x", WARC_Block_Digest="sha1:??")):
        with pytest.raises(warc.WarcError):
            list(warc.records(bad))
    with pytest.raises(warc.WarcError):
        list(warc.records(gzip.compress(b"WARC/1.0\r\nX: \xff\r\n\r\n")))


def test_repeated_page_ids_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200, 9), (1, "u", "x" * 200, 9), (2, "v", "x" * 200, 9), (None, "w", "x" * 200, 9)], "page_id long, url string, html string, digest int")
    read = written(warc.read_archives(warc.write_archives(pages)), "test-pages")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolved(read).collect()), key=str)
    assert got == sorted([(1, "response", None, 200), (1, "response", None, 200), (2, "revisit", 1, 200), (None, "response", None, 200)], key=str)


def plain_jpeg(frame):
    """Coefficients of a baseline JPEG of one component, and its pixels by the definition of the transform."""
    at, quant, tables, data = 2, None, {}, None
    while data is None:
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        if marker == 0xDB:
            quant = list(body[1:65])
        elif marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
        elif marker == 0xC4:
            code, k, found = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    found[format(code, f"0{length}b")] = body[k]
                    code, k = code + 1, k + 1
                code *= 2
            tables[body[0] >> 4] = found
        elif marker == 0xDA:
            data = frame[at + 2 + n : -2]
        at += 2 + n
    out, part, i = [], b"", 0
    parts = []
    while i < len(data):
        if data[i] == 0xFF and data[i + 1] == 0:
            part, i = part + b"\xff", i + 2
        elif data[i] == 0xFF:
            parts.append(part)
            part, i = b"", i + 2
        else:
            part, i = part + data[i : i + 1], i + 1
    for p in [*parts, part]:
        bits, values, pos = "".join(f"{x:08b}" for x in p), [], 0
        while len(values) < 64:
            codes = tables[1 if values else 0]
            n = next(n for n in range(1, 17) if bits[pos : pos + n] in codes)
            run, size = divmod(codes[bits[pos : pos + n]], 16)
            pos += n
            v = int(bits[pos : pos + size] or "0", 2)
            values += [0] * run + [v if bits[pos : pos + 1] == "1" else v - 2**size + 1]
            pos += size
        out.append(values)
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    scale = lambda u: math.sqrt(0.125) if u == 0 else 0.5

    def pixel(values, y, x):
        return 128 + sum(scale(v) * scale(u) * q * c * math.cos((2 * y + 1) * v * math.pi / 16) * math.cos((2 * x + 1) * u * math.pi / 16) for (v, u), c, q in zip(order, values, quant))

    return out, width * height, [[pixel(v, y, x) for y in range(8) for x in range(8)] for v in out[:3]]


def test_stored_media_by_another_decoder(spark):
    texts = ["", "short", "é" * 200, "words and more " * 400, "\x00\x7f" * 64, "ab" * 1024]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate([*texts, None, texts[1]])], "doc_id long, text string, media string")
    stored = media.stored(media.to_media(docs))
    plan = media.read_media(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FileScan parquet" in plan  # what is read comes from the table
    files = {r.doc_id: (r.n_bytes, bytes(r.media)) for r in stored.collect()}
    got = {r.doc_id: r for r in media.read_media(stored).collect()}
    for i, t in enumerate([*texts, None, texts[1]]):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        n, file = files[i]
        r = got[i]
        assert (n, r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(file), hashlib.sha256(file).hexdigest())
        assert file[:4] == b"RIFF" and struct.unpack_from("<I", file, 4)[0] == len(file) - 8
        frames, rate, blocks = media.read_avi(file)
        assert [(c.first_frame, c.end_frame) for c in r.clips][-1][1] == len(frames) and r.clips[0].first_frame == 0 and r.clips[-1].end_s == len(frames) / rate
        payload = b""
        for f in frames[:2]:
            values, size, pixels = plain_jpeg(f)
            assert size == 64 * len(values)
            payload += bytes(x - 256 for v in values for x in v)
            histogram = media.decode_video(media.write_avi(bytes(x - 256 for x in values[0])))[3][0]
            mine = [0] * media.BINS
            for x in pixels[0]:
                mine[min(media.BINS - 1, max(0, int(x * media.BINS // 256)))] += 1
            assert sum(abs(a - b) for a, b in zip(histogram, mine)) <= 2  # a pixel on the edge of a bin may fall on either side
        assert payload[: len(padded)] == padded[: len(payload)]
    assert got[1].media_sha256 == got[len(texts) + 1].media_sha256
    assert media.read_media(media.to_media(docs.where("doc_id < 0"))).count() == 0
    assert media.clip_rows(media.read_media(stored)).where("doc_id = 0").count() == 1


def test_pattern_rules_equal_sql(spark, tmp_path):
    urls = ["https://m.a.com/x/1", "https://blog.a.com/en/12.html", "https://blog.a.com/en/12.html.bak", "http://a.com/login", "http://a.com/x/login/", "http://a.com/loginx", "http://m.a.net/x", "http://a.com/cart.php?q", "http://a.com", None, "m./x", "http://m./", "http://a.com/search/cart", "http://a.com/cart/search"]
    pages = spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = urlfilter.op1_urlfilter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "pattern").collect()
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duckdb.sql(f"SELECT page_id, host, path, rule, verdict, pattern FROM ({urlfilter.ORACLE})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert [r.verdict for r in sorted(got)[:8]] == ["block", "block", "allow", "block", "block", "allow", "block", "block"]


def test_odd_tables(spark):
    clash = "doc_id long, text string, ids int, size int, shard string, lang string, score string, row string, media string, n int, h int"
    row = lambda i, t: (i, t, 1, 2, "s", None, "x", "r", "m", 3, 4)
    d = spark.createDataFrame([row(1, "a b"), row(1, "a b"), row(None, None), row(3, "")], clash)
    assert bpe.encode_decode(d).count() == langid.identify(d).count() == sharding.shard(d).count() == media.read_media(media.to_media(d)).count() == 4
    assert langid.keep_identified(d).count() == 0
    empty = d.where("doc_id = 99")
    assert bpe.encode_decode(empty).count() == langid.identify(empty).count() == sharding.shard(empty).count() == langid.keep_identified(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, host string")
    assert urlfilter.filter_urls(pages, urlfilter.CONTRACT_RULES).count() == 0


def test_odd_conversations(spark):
    kind = "conv_id long, turn long, role string, text string, ids string, start int"
    rows = [(1, 0, "user", "hi", "x", 1), (1, 0, "user", "hi", "x", 1), (1, 1, None, "y", "x", 1), (None, 0, "user", "z", "x", 1), (2, 0, "assistant", "long </turn> " * 40_000, "x", 1)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, kind))).collect()}
    assert got[1].n_turns == 3 and got[2].loss_chars == 13 * 40_000 and got[None].n_turns == 1
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], kind))).count() == 0


def test_chat_sql_states_the_same_rows(spark, tmp_path):
    """The SQL counterpart on control strings, nulls, repeated turns and a long text."""
    said = ["\\### Assistant: </turn> ok", None, "", "a\\", "</turn>\n### user: x", "é\U0001f986" * 3, "word " * 50_000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)]
    rows += [(2, 0, None, "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y"), (2, None, "a:b", "###"), (None, 0, "assistant", "n"), (3, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(repr, (tuple(r) for r in chat.op6_chat(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(map(repr, con.execute(chat.ORACLE).fetchall())) and len(got) == 5
