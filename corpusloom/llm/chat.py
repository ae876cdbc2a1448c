"""Chat formatting by token-level assembly.

Each segment, a role or a text, is encoded by itself with an ordinary byte-level vocabulary and never sees
its neighbours; reserved ids beyond the vocabulary are spliced between segments and stand for the control strings.
So no text can forge a control token. In the formatted string the control strings `### `, `: ` after a role
and `</turn>` mark turns; where they, or the escape sign, occur in a role or text, an escape sign goes in front, which
reading takes off again. Token offsets and the loss mask come from prefix sums of segment lengths.

Turns are output rows; a conversation is sorted within its partition and streamed, never held. Rows are ordered by
turn, then role, then text, nulls first; repeated rows are repeated turns. A null text or role is empty. Rows
with a null conv_id are one conversation without an id.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import slices, table

CONTROLS = ["### ", ": ", "</turn>\n"]
ESCAPE = "\\"
# fixed values: the strings that a reader takes for control, wherever they stand
_HEAD, _COLON, _END = 0, 1, 2
_TEXT_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_FORMATTED = re.compile(r"### ((?:[^\\:]|\\.)*?): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)

_coders: dict[str, tuple] = {}


def coder(path: str | None = None):
    """The encoding of a rank file and the first reserved id, kept per worker."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _coders:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _coders[path] = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
    return _coders[path]


def escaped(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _TEXT_CONTROL).sub(lambda m: ESCAPE + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(ids, coding, first: int) -> str:
    """The formatted string of ids, reserved ones as their control strings."""
    out, at = [], 0
    ids = np.asarray(ids)
    for i in np.flatnonzero(ids >= first).tolist():
        out += [coding.decode(ids[at:i].tolist()), CONTROLS[ids[i] - first]]
        at = i + 1
    return "".join([*out, coding.decode(ids[at:].tolist())])


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted string; raises ValueError where it is not whole turns."""
    turns, at = [], 0
    while at < len(text):
        m = _FORMATTED.match(text, at)
        if not m:
            raise ValueError("not a formatted conversation")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return turns


def _assembled(path: str | None):
    def run(batches):
        coding, first = coder(path)
        conv, base = object(), 0
        for b in slices(batches, 1024):
            roles, texts = ([x or "" for x in b.column(c).to_pylist()] for c in ("role", "text"))
            head = coding.encode_ordinary_batch([escaped(r, True) for r in roles], num_threads=1)
            body = coding.encode_ordinary_batch([escaped(t) for t in texts], num_threads=1)
            ids = [[first + _HEAD, *h, first + _COLON, *t, first + _END] for h, t in zip(head, body)]
            starts, lows, highs = [], [], []
            for c, r, h, t, whole in zip(b.column("conv_id").to_pylist(), roles, head, body, ids):
                if c != conv:
                    conv, base = c, 0
                starts.append(base)
                low = base + len(h) + 2
                lows.append(low if r == "assistant" else None)
                highs.append(low + len(t) if r == "assistant" else None)
                base += len(whole)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(starts, long), pa.array(ids, pa.list_(pa.int32())), pa.array(lows, long), pa.array(highs, long)], names=["conv_id", "turn", "start", "ids", "loss_start", "loss_end"])

    return run


def format_turns(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (conv_id, turn, start, ids, loss_start, loss_end), one for each turn, a conversation's turns in order in one partition.

    start is the turn's token offset in its conversation, the loss mask covers tokens loss_start to
    loss_end of it, null for roles other than `assistant`.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_assembled(path), "conv_id long, turn long, start long, ids array<int>, loss_start long, loss_end long")


def _digested(path: str | None):
    def run(batches):
        coding, first = coder(path)
        conv, state = None, None
        rows: list[tuple] = []

        def done():
            n, turns, chars, loss, total = state
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
            rows.clear()
            return out

        for b in slices(batches, 1024):
            columns = [b.column(c).to_pylist() for c in ("conv_id", "start", "ids", "loss_start", "loss_end")]
            for c, start, ids, low, high in zip(*columns):
                if state is None or c != conv:
                    if state:
                        done()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = formatted(ids, coding, first)
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8"))
                state[4] += len(text)
                if low is not None:
                    said = unescaped(coding.decode(ids[low - start : high - start]))
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8"))
            if rows:
                yield flush()
        if state:
            done()
            yield flush()

    return run


def read_back(output: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from format_turns's output, as it is laid out."""
    return output.mapInArrow(_digested(path), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.unionByName(extra)))


_ROW = "row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)"
#: The contract's columns from the rows themselves: escaping only adds characters to formatted_chars, and reading takes them off again.
ORACLE = rf"""WITH a AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
n AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, {_ROW} AS k FROM a),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY k) AS turns, coalesce(string_agg(t, '' ORDER BY k) FILTER (r = 'assistant'), '') AS loss,
  sum(length('### : </turn>' || chr(10)) + length(regexp_replace(r, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(t, '(\\|###|</turn>)', '\\\1', 'g'))) AS chars FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c"""
