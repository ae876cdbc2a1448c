"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon.

The word-final entries of the vocabulary, the words frequent enough to have earned an id, and any further
words a caller names are compiled with their ids into a minimal acyclic automaton: equal suffixes share
states, each edge carries the number of words that precede it, so the sum along a word's path is its
number and selects its ids. The automaton is a flat file that workers map into memory. Words that
it lacks are merged exactly, pair by pair in rank order.

Texts are normalised as the tokenizer file says (NFC, white space, lower case character by character), special
tokens are cut out of the raw text before that. Null texts are empty and have no ids. Repeated and
very long texts need no special case: words over LONG symbols merge with a heap in n log n.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import json
import mmap
import tempfile
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import in_arrow, slices, table

LONG = 48
_NONE = 1 << 62
#: Entries of a worker's cache of words and what stands between white space, about 200 bytes each; emptied when full. A task of 16 MB has some 330,000 of them.
CACHE = 400_000
_SPACE = "\t-\r \x85\xa0  -     　"
# fixed value: the word pattern of the tokenizer file, with white space spelled out
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_ODD = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in kept else next(rest)) for b in range(256)]


def compile_automaton(words: list[bytes]) -> bytes:
    """The minimal automaton of sorted distinct words: header, then per state its first edge, per edge label, target and count."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    counts: list[int] = []

    def frozen(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            counts.append(node[0] + sum(counts[t] for _, t in node[1]))
        return register[key]

    path: list[list] = [[False, []]]  # the unfinished states of the last word; an edge is added when its target is frozen
    labels: list[int] = []

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((labels.pop(), frozen(node)))

    last = b""
    for word in words:
        if word <= last and last:
            raise ValueError("words must be sorted and distinct")
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        for byte in word[common:]:
            path.append([False, []])
            labels.append(byte)
        path[-1][0] = True
        last = word
    close(0)
    root = frozen(path[0])
    first, label, target, before = [], [], [], []
    for final, edges in states:
        first.append(len(label))
        seen = int(final)
        for byte, to in edges:
            label.append(byte), target.append(to), before.append(seen)
            seen += counts[to]
    first.append(len(label))
    head = np.array([len(states), len(label), root], "<u4")
    body = [head, np.array(first, "<u4"), np.array([f for f, _ in states], "<u4"), np.array(target, "<u4"), np.array(before, "<u4")]
    return b"".join(x.tobytes() for x in body) + bytes(label)


class Automaton:
    """A compiled automaton, mapped from a file that needs no name once it is open."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(compiled)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        states, edges, self.root = view[:12].cast("I")
        words = view[12 : 12 + 4 * (2 * states + 1 + 2 * edges)].cast("I")
        self.first, self.final = words[: states + 1], words[states + 1 : 2 * states + 1]
        self.target, self.before = words[2 * states + 1 : 2 * states + 1 + edges], words[2 * states + 1 + edges :]
        self.label = view[12 + 4 * (2 * states + 1 + 2 * edges) :]

    def number(self, word: bytes) -> int:
        """The word's place among the compiled words, -1 for others."""
        state, n, first, label = self.root, 0, self.first, self.label
        for byte in word:
            lo, hi = first[state], first[state + 1]
            at = bisect.bisect_left(label, byte, lo, hi)
            if at == hi or label[at] != byte:
                return -1
            n += self.before[at]
            state = self.target[at]
        return n if self.final[state] else -1


class Lexicon:
    """What workers need of a tokenizer file: symbols, merges, special tokens and the automaton with its ids."""

    def __init__(self, path: str, words: list[str] = ()):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = model["vocab"]
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = token
        symbols = byte_symbols()
        self.plain = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        if len(self.tokens) > 1 << 17:
            raise ValueError("ids must stay under 131072")
        #: pair of ids -> rank and new id, both as one integer, so the least of them is the next merge
        self.steps: dict[int, int] = {}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            self.steps.setdefault(vocab[a] << 17 | vocab[b], rank << 17 | vocab[a + b])
        byte_of = {s: b for b, s in enumerate(symbols)}
        frequent = {bytes(byte_of[c] for c in t.removesuffix(self.suffix)) for t in vocab if t.endswith(self.suffix) and len(t) > len(self.suffix)}
        frequent |= {w.encode("utf-8") for w in words}
        ordered = sorted(frequent)
        outputs = [self.merged(w) for w in ordered]
        self.compiled = compile_automaton(ordered)
        self.out_at = array("I", [0])
        self.out = array("I")
        for ids in outputs:
            self.out.extend(ids)
            self.out_at.append(len(self.out))

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word by merging its bytes in rank order."""
        ids = [self.plain[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if len(ids) > LONG:
            return self._merged_by_heap(ids)
        get = self.steps.get
        steps = [get(a << 17 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while steps:
            best = min(steps)
            if best == _NONE:
                break
            i = steps.index(best)
            new = ids[i] = best & 0x1FFFF
            del ids[i + 1], steps[i]
            if i:
                steps[i - 1] = get(ids[i - 1] << 17 | new, _NONE)
            if i < len(steps):
                steps[i] = get(new << 17 | ids[i + 1], _NONE)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.steps.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(step >> 17, i, a, b, step & 0x1FFFF) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (step := get(a << 17 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (step := get(new << 17 | ids[k])) is not None:
                    heapq.heappush(heap, (step >> 17, i, new, ids[k], step & 0x1FFFF))
            if (h := before[i]) >= 0 and (step := get(ids[h] << 17 | new)) is not None:
                heapq.heappush(heap, (step >> 17, h, ids[h], new, step & 0x1FFFF))
        return [x for x in ids if x >= 0]


class _Words(dict):
    """The ids of words, and of what stands between white space, which words never cross: bytes of unsigned 32-bit integers, as these are joined fast and keep no integer objects alive."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.automaton = lexicon, Automaton(lexicon.compiled)

    def _ids(self, word: str) -> bytes:
        raw, lexicon = word.encode("utf-8", "surrogatepass"), self.lexicon
        n = self.automaton.number(raw)
        return (lexicon.out[lexicon.out_at[n] : lexicon.out_at[n + 1]] if n >= 0 else array("I", lexicon.merged(raw))).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        words = [chunk] if chunk.isascii() and chunk.isalpha() else WORDS.findall(chunk)
        ids = self._ids(words[0]) if len(words) == 1 else b"".join(map(self.__getitem__, words))
        if len(chunk) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.words = _Words(lexicon)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(lexicon.special, key=len, reverse=True))) + ")") if lexicon.special else None

    def _ordinary(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split takes four more control characters for white space than the pattern does
        parts = WORDS.findall(text) if _ODD.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, parts))

    def encode(self, text: str | None) -> array:
        """The ids of a whole text."""
        if not text:
            return array("I")
        if self.split is None or not any(s in text for s in self.lexicon.special):
            return array("I", self._ordinary(text))
        ids = array("I")
        for part in self.split.split(text):
            if part in self.lexicon.special:
                ids.append(self.lexicon.special[part])
            elif part:
                ids.frombytes(self._ordinary(part))
        return ids

    def decode(self, ids) -> str:
        """The text of ids: the file has no decoder, so tokens are joined by single spaces."""
        return " ".join(map(self.lexicon.tokens.__getitem__, ids))


def _coded(shared, rows: int):
    def run(batches):
        encoder = Encoder(shared.value)  # with caches that end with the task
        for b in slices(batches, rows):
            ids = [encoder.encode(t) for t in b.column("text").to_pylist()]
            flat = np.concatenate([np.frombuffer(x, np.uint32) for x in ids] or [np.empty(0, np.uint32)])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
            decoded = [encoder.decode(x) for x in ids]
            hashes = [hashlib.sha256(np.frombuffer(x, np.uint32).astype("<u4").tobytes()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "ids_sha256", "decoded"])

    return run


def lexicon_for(spark: SparkSession, path: str | None = None, words: list[str] = ()):
    """A broadcast lexicon; its size is that of the vocabulary file and does not grow with the corpus."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return spark.sparkContext.broadcast(Lexicon(path, words))


def encode_decode(docs: DataFrame, path: str | None = None, words: list[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids, ids_sha256, decoded), one for each row of docs, in one pass without a shuffle.

    ids are those of the whole text, ids_sha256 hashes them as little-endian unsigned 32-bit integers,
    decoded is the text made of the ids again. words are further frequent words for the automaton.
    """
    shared = lexicon_for(docs.sparkSession, path, words)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    return in_arrow(d, _coded(shared, 128), f"doc_id {kind}, ids array<int>, ids_sha256 string, decoded string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
