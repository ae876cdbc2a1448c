"""Media columns: AVI files with motion-JPEG frames.

Bytes become media without loss by going where JPEG keeps integers exactly: 64 payload bytes are the quantised
coefficients of one 8x8 block, each raised by 256, so that all have the magnitude category 9 and a Huffman table of
one code holds. Blocks are restart intervals of 80 bytes of entropy-coded data; FRAME blocks at most make an intra frame,
frames go into an AVI file with an index. The reader parses the RIFF chunks and the index, checks both
against each other, and decodes frames: any baseline stream of one component by its Huffman tables,
and streams in the form above by unpacking all blocks at once.

Shots are detected on histograms of the decoded pixels: a cut lies where the difference between neighbouring frames
exceeds the mean of the last differences by DEVIATIONS of their standard deviation, and FLOOR. Clips are the
runs between cuts, with their times. Blocks that fill up the last frame count in no histogram where the file states its payload's.
A frame holds 2,048 payload bytes, so a shot has that many at least, or what the last frame holds.

Null text is an empty payload of 64 zero bytes; payloads are padded with zero bytes to a multiple of 64.
Every row is handled by itself, so equal texts give equal values and repeated rows are repeated.

Long texts are long files, each a row of its own batch where it must. Empty tables give empty results; of docs only the id and the text are read, and read_media
keeps what other columns its table has.

to_media makes the media column, stored writes it as a compressed table into the shared folder, and read_media reads that by the stored bytes alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import in_arrow, slices, table
from corpusloom.plans.materialize import written

#: How the stored column is compressed.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
BLOCK, FRAME, RATE = 64, 32, 25
BINS, MEMORY, DEVIATIONS, FLOOR = 16, 8, 2.5, 0.1
_RAISED = 256


class MediaError(ValueError):
    pass


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


# ---- JPEG ----

_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_u = np.arange(8)
_DCT = np.cos((2 * _u[:, None] + 1) * _u[None, :] * np.pi / 16) * np.where(_u == 0, np.sqrt(0.125), 0.5)[None, :]
#: coefficients in zigzag order -> 64 pixels
_IDCT = np.kron(_DCT, _DCT).T[_ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _prologue(width: int, height: int) -> bytes:
    one = bytes([1, *[0] * 15, 9])  # one code of one bit, for category 9 after no zeros
    return b"".join([
        b"\xff\xd8", _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + one), _segment(0xC4, b"\x10" + one), _segment(0xDD, b"\0\1"), _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ])


def _packed(values: np.ndarray) -> np.ndarray:
    """Ten-bit values, rows of 64, as rows of 80 bytes."""
    q = values.reshape(-1, 16, 4).astype(np.uint64)
    q = q[:, :, 0] << np.uint64(30) | q[:, :, 1] << np.uint64(20) | q[:, :, 2] << np.uint64(10) | q[:, :, 3]
    return np.stack([(q >> np.uint64(s)).astype(np.uint8) for s in (32, 24, 16, 8, 0)], axis=2).reshape(-1, 80)


def _unpacked(raw: np.ndarray) -> np.ndarray:
    q = raw.reshape(-1, 16, 5).astype(np.int64)
    q = q[:, :, 0] << 32 | q[:, :, 1] << 24 | q[:, :, 2] << 16 | q[:, :, 3] << 8 | q[:, :, 4]
    return np.stack([(q >> s) & 1023 for s in (30, 20, 10, 0)], axis=2).reshape(-1, 64)


_RST = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
_SPLIT = re.compile(rb"\xff[\xd0-\xd7]")


def jpeg_frames(payload: bytes, per_frame: int, width: int, height: int) -> list[bytes]:
    """Frames of per_frame blocks; the last is filled with zero coefficients bytes."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    if extra := -len(blocks) % per_frame:
        blocks = np.concatenate([blocks, np.zeros((extra, BLOCK), np.uint8)])
    raw, head, frames = _packed(blocks.astype(np.uint16) + _RAISED).tobytes(), _prologue(width, height), []
    for at in range(0, len(blocks), per_frame):
        parts = [head]
        for i in range(per_frame):
            parts.append(raw[80 * (at + i) : 80 * (at + i + 1)].replace(b"\xff", b"\xff\0"))
            parts.append(_RST[i % 8])
        parts[-1] = b"\xff\xd9"
        frames.append(b"".join(parts))
    return frames


def _huffman(body: bytes) -> dict[tuple[int, int], int]:
    codes, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            codes[length, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return codes


def _decoded_bits(data: bytes, blocks: int, dc: dict, ac: dict) -> np.ndarray:
    """The coefficients of one restart interval, bit by bit, for any Huffman tables."""
    bits, at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def take(n: int) -> int:
        nonlocal at
        if at + n > len(bits):
            raise MediaError("a scan ends early")
        value = 0
        for b in bits[at : at + n]:
            value = value << 1 | b
        at += n
        return value

    def symbol(codes: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise MediaError("no such code")

    def number(size: int) -> int:
        v = take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    out, pred = np.zeros((blocks, 64), np.int64), 0
    for row in out:
        pred += number(symbol(dc))
        row[0], k = pred, 1
        while k < 64:
            run, size = divmod(symbol(ac), 16)
            if not size:
                if run != 15:
                    break
                k += 16
                continue
            k += run
            if k > 63:
                raise MediaError("too many coefficients")
            row[k] = number(size)
            k += 1
    return out


_SINGLE = bytes([1, *[0] * 15, 9])


@lru_cache(maxsize=256)
def _header(head: bytes) -> tuple[np.ndarray, bytes, bytes, int, int]:
    """Quantisers, Huffman tables, restart interval and number of blocks of the segments before the scan's data."""
    at, quant, tables, interval, size, which = 2, {}, {}, 0, None, 0
    while True:
        marker = head[at + 1]
        body = head[at + 4 : at + 2 + struct.unpack_from(">H", head, at + 2)[0]]
        at += 4 + len(body)
        if marker == 0xDB:
            for i in range(0, len(body), 65):
                quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 65], np.uint8).astype(np.int64)
        elif marker == 0xC0:
            height, width, parts = struct.unpack_from(">HHB", body, 1)
            if parts != 1:
                raise MediaError("frames of one component only")
            size, which = (width, height), body[8]
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i]] = body[i + 1 : i + 17 + n]
                i += 17 + n
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            blocks = -(-size[0] // 8) * -(-size[1] // 8)
            return quant[which], tables[body[2] >> 4], tables[16 | body[2] & 15], interval or blocks, blocks


def _scan(frame: bytes) -> tuple[tuple, list[bytes]]:
    """The header's values and the restart intervals' data of a baseline JPEG."""
    if frame[:2] != b"\xff\xd8":
        raise MediaError("not a JPEG")
    start = frame.index(b"\xff\xda")
    start += 2 + struct.unpack_from(">H", frame, start + 2)[0]
    head = _header(frame[:start])
    parts = _SPLIT.split(frame[start : frame.rindex(b"\xff\xd9")])
    if len(parts) != -(-head[4] // head[3]):
        raise MediaError("restart intervals are missing")
    return head, [p.replace(b"\xff\0", b"\xff") for p in parts]


def jpeg_coefficients(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Coefficients (blocks, 64) of all frames in zigzag order, the quantisers of each block, and each frame's blocks."""
    scans = [_scan(f) for f in frames]
    sizes = [head[4] for head, _ in scans]
    quant = np.repeat(np.array([head[0] for head, _ in scans]), sizes, axis=0)
    if all(head[3] == 1 and head[1] == head[2] == _SINGLE for head, _ in scans):
        parts = [p for _, own in scans for p in own]
        raw = b"".join(parts)
        if len(raw) == 80 * len(parts) and set(map(len, parts)) <= {80}:
            values = _unpacked(np.frombuffer(raw, np.uint8))
            if (values >> 8 == 1).all():
                return values, quant, sizes
    rows = []
    for (_, dc, ac, interval, blocks), parts in scans:
        dc, ac = _huffman(dc), _huffman(ac)
        rows += [_decoded_bits(p, min(interval, blocks - i * interval), dc, ac) for i, p in enumerate(parts)]
    return np.concatenate(rows), quant, sizes


# ---- AVI ----


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """A payload, a positive multiple of 64 bytes, as an AVI file."""
    blocks = len(payload) // BLOCK
    per = min(blocks, FRAME)
    width, height = (64, 32) if per == FRAME else (8 * per, 8)
    frames = jpeg_frames(payload, per, width, height)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    note = _chunk(b"LIST", b"INFO" + _chunk(b"IBLK", struct.pack("<Q", blocks)))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        chunk = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(chunk)
        at += len(chunk)
    return _chunk(b"RIFF", b"AVI " + hdrl + note + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _chunks(raw: bytes, at: int, end: int):
    while at + 8 <= end:
        name, n = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if at + 8 + n > end:
            raise MediaError(f"the chunk {name!r} is cut off")
        yield name, at + 8, n
        at += 8 + n + n % 2


def read_avi(raw: bytes) -> tuple[list[bytes], float, int | None]:
    """Frames by the file's index, frames per second, and the number of blocks that carry payload, where it is stated."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise MediaError("not an AVI file")
    rate, movi, index, found, blocks = 0.0, None, None, {}, None
    for name, at, n in _chunks(raw, 12, 8 + struct.unpack_from("<I", raw, 4)[0]):
        kind = raw[at : at + 4] if name == b"LIST" else None
        if kind == b"hdrl":
            for inner, a, _ in _chunks(raw, at + 4, at + n):
                if inner == b"avih":
                    rate = 1e6 / max(1, struct.unpack_from("<I", raw, a)[0])
        elif kind == b"INFO":
            for inner, a, _ in _chunks(raw, at + 4, at + n):
                if inner == b"IBLK":
                    blocks = struct.unpack_from("<Q", raw, a)[0]
        elif kind == b"movi":
            movi = at
            found = {a - 8 - at: (a, m) for inner, a, m in _chunks(raw, at + 4, at + n) if inner[2:] in (b"dc", b"db")}
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", raw, at + 16 * i) for i in range(n // 16)]
    if movi is None:
        raise MediaError("no frames")
    if index is None:
        return [raw[a : a + m] for a, m in found.values()], rate, blocks
    frames = []
    for _, _, offset, n in index:
        a, m = found.get(offset) or found.get(offset - movi) or (0, -1)
        if m != n:
            raise MediaError("index and frames do not agree")
        frames.append(raw[a : a + m])
    return frames, rate, blocks


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges between cuts.

    A step is judged by the last MEMORY steps that were no cuts, of its own shot and, at its beginning, of those before; with fewer than two of
    them by FLOOR alone. So a cut may stand after any frame, and a shot may have one.
    """
    if not len(histograms):
        return []
    share = histograms / np.maximum(1, histograms.sum(axis=1, keepdims=True))
    steps = (np.abs(np.diff(share, axis=0)).sum(axis=1) / 2).tolist()
    cuts, calm = [0], []
    for i, d in enumerate(steps):
        last = calm[-MEMORY:]
        bound = FLOOR
        if len(last) >= 2:
            mean = sum(last) / len(last)
            bound = max(FLOOR, mean + DEVIATIONS * (sum((x - mean) ** 2 for x in last) / len(last)) ** 0.5)
        if d > bound:
            cuts.append(i + 1)
        else:
            calm.append(d)
    return list(zip(cuts, [*cuts[1:], len(histograms)]))


def decode_video(raw: bytes) -> tuple[bytes, list[tuple[int, int]], float, np.ndarray]:
    """Payload bytes, shots, frames per second and histogram of each frame of a stored file."""
    frames, rate, blocks = read_avi(raw)
    coefficients, quant, sizes = jpeg_coefficients(frames)
    pixels = (coefficients * quant).astype(np.float32) @ _IDCT
    bins = np.clip((pixels + 128) * (BINS / 256), 0, BINS - 1).astype(np.int64)
    bins += np.repeat(np.arange(len(sizes)) * BINS, sizes)[:, None]
    bins = bins[:blocks]
    histograms = np.bincount(bins.ravel(), minlength=len(sizes) * BINS).reshape(len(sizes), BINS)
    payload = (coefficients - _RAISED).astype(np.uint8).tobytes()
    return payload if blocks is None else payload[: BLOCK * blocks], shots(histograms), rate, histograms


def _encoded(batches):
    for b in slices(batches, 64):
        raws = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, raws), pa.int64()), pa.array([write_avi(padded(x)) for x in raws], pa.binary())], names=["doc_id", "n_bytes", "media"])


_CLIP = pa.struct([("first_frame", pa.int64()), ("end_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())])


def _described(batches):
    for b in slices(batches, 64):
        sizes, hashes, tails, lengths, names, clips = [], [], [], [], [], []
        for file in b.column("media").to_pylist():
            if file is None:
                for column in (sizes, hashes, tails, lengths, names, clips):
                    column.append(None)
                continue
            payload, found, rate, _ = decode_video(file)
            sizes.append(len(payload)), hashes.append(hashlib.sha256(payload).hexdigest()), tails.append(zlib.crc32(payload[-BLOCK:]))
            lengths.append(len(file)), names.append(hashlib.sha256(file).hexdigest())
            clips.append([{"first_frame": s, "end_frame": e, "start_s": s / rate, "end_s": e / rate} for s, e in found])
        rest = b.drop_columns(["media"])
        long = pa.int64()
        columns = [pa.array(sizes, long), pa.array(hashes, pa.string()), pa.array(tails, long), pa.array(lengths, long), pa.array(names, pa.string()), pa.array(clips, pa.list_(_CLIP))]
        yield pa.RecordBatch.from_arrays([*rest.columns, *columns], names=[*rest.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media), one for each row of docs: the media column, to be written where it is kept, or read at once."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(d, _encoded, f"doc_id {dict(d.dtypes)['doc_id']}, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """media, a table with a column media of stored files, with what these hold in that column's place: payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and clips. A null file has nulls; a damaged one raises MediaError."""
    rest = T.StructType([f for f in media.schema.fields if f.name != "media"])
    clip = T.StructType([T.StructField("first_frame", T.LongType()), T.StructField("end_frame", T.LongType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])
    kinds = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "clips": T.ArrayType(clip)}
    return in_arrow(media, _described, T.StructType([*rest.fields, *(T.StructField(n, k) for n, k in kinds.items())]))


def clip_rows(media: DataFrame) -> DataFrame:
    """Timed clip rows (doc_id, clip, first_frame, end_frame, start_s, end_s) of read_media's output."""
    return media.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")


def stored(media: DataFrame) -> DataFrame:
    """The media column written as a table in the shared folder and read from there; quantised bytes still compress, so pages are packed tightly."""
    return written(media, "media", **PACKED)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_media(stored(to_media(table(spark, sf_dir, "documents"))))
    feature = F.concat(F.lit("clips="), F.concat_ws(",", F.transform("clips", lambda c: F.concat(c["first_frame"].cast("string"), F.lit("-"), c["end_frame"].cast("string")))))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
