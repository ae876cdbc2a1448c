"""WARC archives: writing with payload deduplication, and a sequential reader.

Archives are rows (archive, content) of a table in the shared folder, which any store that Spark reaches
can hold; files of other origin enter by Spark's binaryFile source, whose rows have the same form. Each record is
one gzip member. The reader inflates members piece by piece, frames records by Content-Length and
verifies block and payload digests by the algorithm that they name (others than ALGORITHMS go unverified); damage, and headers that are not
UTF-8, raise WarcError with the archive and offset. Records of all types are read: warcinfo, request, metadata and others have no page and no
payload, a resource's payload is its block. A revisit is resolved against the response that it refers to; where that is
in no archive, it has what its own header states, in SHA-256 or not at all.

A payload of at least LEAST bytes that an earlier page, one with a smaller page_id, has already is not stored
again: its record is a revisit that names the earlier page and keeps the payload's size and digest. Null html
is an empty payload. Rows with a null page_id are always responses. Repeated rows are revisits of themselves
only if their page_id is larger, so repeated page_ids are all responses. Empty tables give no archives and no records; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import in_arrow, slices, table
from corpusloom.plans.materialize import written

LEAST = 100
#: Compressed bytes from which an archive is closed; bytes that the reader inflates at once.
ARCHIVE, PIECE = 1 << 20, 1 << 16
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class WarcError(ValueError):
    pass


#: Digest names and their lengths in bytes.
ALGORITHMS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def stated(label: str | None) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a digest header in base 32 or hex, null for algorithms that are not known."""
    name, _, value = (label or "").strip().partition(":")
    name, value = name.lower().replace("-", ""), value.strip()
    n = ALGORITHMS.get(name)
    if n is None:
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * n else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        raw = b""
    if len(raw) != n:
        raise WarcError(f"{label!r} is no digest")
    return name, raw


def _agrees(label: str | None, raw: bytes) -> bool:
    told = stated(label)
    return told is None or hashlib.new(told[0], raw).digest() == told[1]


def _digest(raw: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(raw).digest()).decode()


def _record_id(page_id) -> str:
    """A record's name: that of its page, and one of its own where the page has no id."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "Content-Type": "application/http;msgtype=response",
        "WARC-Block-Digest": _digest(block),
        "WARC-Payload-Digest": _digest(payload),
        "X-Payload-Length": str(len(payload)),
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if refers_to is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = _record_id(refers_to)
        head["X-Refers-To-Page"] = str(refers_to)
    head["Content-Length"] = str(len(block))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """What a response carries after its HTTP head, or a resource's block; other records have no payload of their own."""
    kind, http = headers.get("warc-type"), headers.get("content-type", "").startswith("application/http")
    if kind == "response" and http:
        return block.partition(b"\r\n\r\n")[2]
    return block if kind in ("response", "resource") else None


def records(content: bytes, archive: str = ""):
    """Yields (headers, block) of each record of an archive, in order."""
    view, at = memoryview(content), 0
    while at < len(view):
        start, inflate, parts = at, zlib.decompressobj(31), []
        try:
            while not inflate.eof:
                piece = view[at : at + PIECE]
                if not piece:
                    raise WarcError(f"{archive}: the record at {start} is cut off")
                parts.append(inflate.decompress(piece))
                at += len(piece)
        except zlib.error as e:
            raise WarcError(f"{archive}: the record at {start} is damaged: {e}") from e
        at -= len(inflate.unused_data)
        raw = b"".join(parts)
        head, sep, rest = raw.partition(b"\r\n\r\n")
        try:
            lines = head.decode("utf-8").split("\r\n")
        except UnicodeDecodeError as e:
            raise WarcError(f"{archive}: the headers of the record at {start} are not UTF-8") from e
        if not sep or not lines[0].startswith("WARC/"):
            raise WarcError(f"{archive}: no record at {start}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        n = int(told) if (told := headers.get("content-length", "")).isdecimal() else -1
        if n < 0 or rest[n:] != b"\r\n\r\n":
            raise WarcError(f"{archive}: Content-Length of the record at {start} does not frame it")
        block = rest[:n]
        if not _agrees(headers.get("warc-block-digest"), block):
            raise WarcError(f"{archive}: the block digest of the record at {start} does not match")
        payload = payload_of(headers, block)
        if payload is not None and "warc-segment-number" not in headers:
            if not _agrees(headers.get("warc-payload-digest"), payload):
                raise WarcError(f"{archive}: the payload digest of the record at {start} does not match")
        yield headers, block


def _archived(batches):
    parts, size = [], 0

    def closed():
        content = b"".join(parts)
        return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha256(content).hexdigest()[:24]}.warc.gz"]), pa.array([content], pa.binary())], names=["archive", "content"])

    for b in slices(batches, 256):
        for page, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
            parts.append(record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers))
            size += len(parts[-1])
            if size >= ARCHIVE:
                yield closed()
                parts, size = [], 0
    if parts:
        yield closed()


def write_archives(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); returns the table of archives (archive, content)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # short payloads have keys of their own, so only repeats can meet in numbers; a popular digest's rows are split by Spark, since nothing above the join needs them together
    long = F.coalesce(F.col("page_id").isNotNull() & (F.octet_length("html") >= least), F.lit(False))
    keyed = p.withColumn("key", F.when(long, F.sha2("html", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url", "html").cast("string"))))
    first = keyed.where(long).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = keyed.join(first, "key", "left").select("page_id", "url", "html", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))
    return written(in_arrow(told, _archived, "archive string, content binary"), "warc-archives")


_ROW = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, target_id string, payload binary"


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,18}", value) else None


def _read(payloads: bool):
    names = [x.split()[0] for x in _ROW.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for b in batches:
            for archive, content in zip(b.column("archive").to_pylist(), b.column("content").to_pylist()):
                rows: list[list] = [[] for _ in names]
                for head, block in records(content, archive):
                    payload, target = payload_of(head, block), head.get("warc-refers-to")
                    if payload is not None:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    else:
                        told = stated(head.get("warc-payload-digest"))
                        size, digest = _number(head.get("x-payload-length")), told[1].hex() if told and told[0] == "sha256" else None
                    row = (_number(head.get("x-page-id")), head.get("warc-target-uri"), head.get("warc-type"), size, digest, _number(head.get("x-refers-to-page")), head.get("warc-record-id"), target, payload if payloads else None)
                    for column, value in zip(rows, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    return run


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows (page_id, url, record_type, payload_bytes, payload_digest, refers_to, record_id, target_id, payload) of archives (archive, content).

    One row for each record, of any type. target_id is the record that it refers to; payload is null without payloads, and for records that have none.
    """
    return in_arrow(archives.select("archive", "content"), _read(payloads), _ROW)


def resolved(read: DataFrame) -> DataFrame:
    """read, with each revisit's size, digest and page taken from the response that it refers to, where there is one.

    read should be a written table, as it is read twice. Of several responses under one record id the one with the smallest page_id counts.
    """
    told = F.struct("page_id", "payload_bytes", "payload_digest")
    first = read.where("record_type = 'response' AND record_id IS NOT NULL").groupBy(F.col("record_id").alias("target_id")).agg(F.min(told).alias("told"))
    again = read.where("record_type = 'revisit'").join(first, "target_id", "left")
    of = lambda c, own: F.coalesce(F.col(f"told.{c}"), F.col(own))
    again = again.withColumns({"payload_bytes": of("payload_bytes", "payload_bytes"), "payload_digest": of("payload_digest", "payload_digest"), "refers_to": of("page_id", "refers_to")})
    return read.where("record_type IS NULL OR record_type <> 'revisit'").unionByName(again.drop("told"))


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files under a path of any store, as the table that read_archives takes. A file is a row, so it must fit a task's memory."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.col("path").alias("archive"), "content")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = written(read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False).drop("payload", "url"), "warc-read")
    return resolved(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, CAST(octet_length(raw) AS BIGINT) AS payload_bytes, sha256(raw) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id > first THEN first END AS refers_to
FROM f
"""
