"""Token counts of texts by byte-level BPE, without a shuffle.

Pre-tokens are looked up in two tiers on the map side. The first is a compact hash table of the lengths of frequent pre-tokens that the driver
broadcasts: those the vocabulary itself was given as one entry, and any that a caller adds. It is three flat arrays and the
pre-tokens' bytes, its size is that of the vocabulary and does not grow with the corpus. What it lacks is merged by the library, pre-token by
pre-token, and a worker keeps the lengths it has seen in a cache that is emptied when full and ends with the task.

Special strings inside a text are one token each, as the library has it by default. A text with characters that this
Python has no class for (newer than its Unicode tables) is encoded whole by the library, since the pattern below may split it elsewhere.

Null texts are empty and have no tokens. Long texts are split into pre-tokens bit by bit. Repeated rows are counted each, empty
tables give empty results, columns other than the two named are not read.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm.bpe import byte_symbols
from corpusloom.llm.common import in_arrow, slices, table

#: Characters of a text whose pre-tokens are listed at once; entries of a worker's cache, and the longest pre-token that it keeps.
PIECE, CACHE, LONG = 1 << 20, 200_000, 64
_SPACE = "\t-\r \x85\xa0  -     　"
# fixed value: the pre-token pattern of byte-level BPE, with white space spelled out
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def newer_characters() -> frozenset[str]:
    """Characters that the pattern's tables have and this Python's do not."""
    known = regex.compile(r"[^\p{Cn}]")
    return frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and known.match(c))


class LengthTable:
    """pre-token -> number of tokens: open addressing over numpy arrays, with the bytes for an exact comparison."""

    def __init__(self, lengths: dict[bytes, int]):
        words = sorted(lengths)
        self.mask = (1 << max(4, (2 * len(words)).bit_length())) - 1
        self.slots = np.zeros(self.mask + 1, np.uint32)
        self.ends = np.cumsum([0, *map(len, words)]).astype(np.uint32)
        self.blob = b"".join(words)
        self.lengths = np.array([lengths[w] for w in words], np.uint16)
        for i, w in enumerate(words):
            at = xxhash.xxh3_64_intdigest(w) & self.mask
            while self.slots[at]:
                at = (at + 1) & self.mask
            self.slots[at] = i + 1

    def find(self, word: bytes) -> int:
        """The length of word, -1 if the table lacks it."""
        at = xxhash.xxh3_64_intdigest(word) & self.mask
        while i := int(self.slots[at]):
            if self.blob[self.ends[i - 1] : self.ends[i]] == word:
                return int(self.lengths[i - 1])
            at = (at + 1) & self.mask
        return -1


def _checked(path: str) -> list[str]:
    """The special strings of a tokenizer file, if it is one of plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    pre, added = file["pre_tokenizer"] or {}, file["added_tokens"]
    plain = file["model"]["type"] == "BPE" and not file["normalizer"] and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
    if not plain or any(a["single_word"] or a["lstrip"] or a["rstrip"] or not a["special"] for a in added):
        raise ValueError(f"{path} is not a file of plain byte-level BPE")
    return [a["content"] for a in added]


class Counter:
    """Counts tokens with a table of frequent pre-tokens and a cache of others."""

    def __init__(self, path: str, newer: frozenset[str], frequent: LengthTable | None = None):
        special = _checked(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.newer, self.cache = newer, _Cache(self.library.model, frequent)

    def _ordinary(self, text: str) -> int:
        get = self.cache.__getitem__
        if len(text) <= PIECE:
            return sum(map(get, PRETOKEN.findall(text)))
        return sum(get(m.group()) for m in PRETOKEN.finditer(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not text.isascii() and not self.newer.isdisjoint(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.special is None or not self.special.search(text):
            return self._ordinary(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._ordinary, parts))


class _Cache(dict):
    def __init__(self, model, frequent: LengthTable | None):
        super().__init__()
        self.model, self.frequent, self.symbols = model, frequent, byte_symbols()

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8")
        n = self.frequent.find(raw) if self.frequent else -1
        if n < 0:
            n = len(self.model.tokenize("".join(map(self.symbols.__getitem__, raw))))
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= LONG:
            self[word] = n
        return n


def frequent_lengths(path: str, words: list[str] = ()) -> LengthTable:
    """Lengths of the vocabulary's entries that are whole pre-tokens, and of the pre-tokens of further words."""
    counter = Counter(path, frozenset())
    back = {c: b for b, c in enumerate(byte_symbols())}
    found = {}
    for entry in counter.library.get_vocab(with_added_tokens=False):
        try:
            word = bytes(map(back.__getitem__, entry)).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if PRETOKEN.fullmatch(word):
            found[word.encode("utf-8")] = counter.cache[word]
    for word in words:
        found |= {p.encode("utf-8"): counter.cache[p] for p in PRETOKEN.findall(word)}
    return LengthTable(found)


def count_tokens(docs: DataFrame, limit: int = 512, path: str | None = None, words: list[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of docs, in one pass.

    path names a tokenizer file of byte-level BPE that all workers can read; words are further frequent words for the broadcast table.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    shared = docs.sparkSession.sparkContext.broadcast((newer_characters(), frequent_lengths(path, words)))

    def run(batches):
        counter = Counter(path, *shared.value)  # with a cache that ends with the task
        for b in slices(batches, 1024):
            n = [counter.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = in_arrow(d, run, f"doc_id {dict(d.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
