"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every vocabulary piece. A text's probability is the sum over all
segmentations of it into pieces; as pieces do not cross white space, that is a product over words, and the
forward algorithm sums the segmentations of a word. Words of a slice of documents are scored once each,
all words of a length class at a time. The piece probabilities come from expectation maximisation:
forward-backward counts over the words of a bounded sample of labelled rows.

A null text or one without a letter gets `und` with score 0. Where no labelled row exists, every text does.
Ties go to the language that sorts first. Nothing but the text enters a prediction; repeated rows and clashing
column names do no harm, as only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm.common import in_arrow, slices, table

#: The bound of the training sample: so many rows per language, those with the smallest hash of doc_id.
SAMPLE = 250
ROUNDS = 4
SMOOTH = 0.02
#: Probability of a character that no piece covers.
UNKNOWN = 1e-7
#: So many bytes of text per language at most enter it, unless the first text alone has more.
SAMPLE_BYTES = 4 << 20
#: Longer words are scored with rescaling, and those over WIDE letters one by one in logarithms, STRETCH letters at a time. Where the fit meets
#: a word of more than STRETCH letters, it takes each stretch as a word.
LONG, WIDE, STRETCH = 32, 512, 1 << 13
#: Words whose scores a task keeps.
CACHE = 100_000
MARK = "▁"
UND = "und"


def vocabulary(path: str | None = None) -> list[str]:
    """The ordinary pieces of a public piece vocabulary."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@dataclass
class Trie:
    """A trie over an alphabet as a double array: the edge of a node by a letter is in slot base[node] + letter, if that slot's owner is the node.

    Its size is that of the edges and the alphabet, not of their product. Node 0 is dead, node 1 the root; letter 0 is any character
    outside the alphabet.
    """

    alphabet: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    depth: int
    size: int

    def letters(self, text: str) -> np.ndarray:
        """Alphabet places of a text's characters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The children of nodes by letters; letters under 1 have none."""
        slot = self.base[node] + np.maximum(letter, 0)
        return np.where((self.owner[slot] == node) & (letter > 0), self.target[slot], 0)


@dataclass
class Model:
    """Languages, the trie of pieces, and each language's probability of the piece that ends at a node."""

    langs: list[str]
    trie: Trie
    prob: np.ndarray


def trie(pieces: list[str]) -> tuple[Trie, np.ndarray]:
    """The trie of pieces and the node of each."""
    alphabet = np.array(sorted({ord(c) for p in pieces for c in p} or {ord(MARK)}), np.uint32)
    place = {chr(c): i + 1 for i, c in enumerate(alphabet)}
    nodes: list[dict[int, int]] = [{}, {}]
    ends = []
    for p in pieces:
        at = 1
        for c in p:
            at = nodes[at].setdefault(place[c], len(nodes))
            if at == len(nodes):
                nodes.append({})
        ends.append(at)
    # slots before the first are for letters that no edge has; nodes of many edges come first
    wide, size = len(alphabet) + 1, 4 * (len(alphabet) + 1)
    owner, target = np.zeros(size, np.int32), np.zeros(size, np.int32)
    base, free = np.full(len(nodes), wide, np.int64), 2 * wide
    for i in sorted(range(1, len(nodes)), key=lambda i: -len(nodes[i])):
        if not (edges := nodes[i]):
            continue
        letters = np.fromiter(edges, np.int64, len(edges))
        at, span = None, 64
        while at is None:
            while free < len(owner) and owner[free]:
                free += 1
            while free + span + 2 * wide > len(owner):
                owner, target = np.concatenate([owner, np.zeros_like(owner)]), np.concatenate([target, np.zeros_like(target)])
            # the first base, of a span of them, where no edge meets another node's
            bases = np.arange(span) + (free - letters.min())
            fits = np.ones(span, bool)
            for c in letters:
                fits &= owner[bases + c] == 0
            at, span = (int(bases[fits.argmax()]) if fits.any() else None), 4 * span
        base[i] = at
        owner[at + letters], target[at + letters] = i, np.fromiter(edges.values(), np.int64, len(edges))
    used = int(base.max()) + wide
    owner, target = owner[:used], target[:used]
    table = Trie(alphabet, base, owner, target, max(map(len, pieces), default=1), len(nodes))
    return table, np.array(ends, np.int64)


_SHORT = ((1, 4), (5, 7), (8, 10), (11, 14), (15, 20), (21, LONG))
_LONGER = ((LONG + 1, 64), (65, 128), (129, 256), (257, WIDE))


def _classes(text: np.ndarray, n: np.ndarray, bounds=None):
    """Words by length class: their places and a matrix of letters, padded with -1. text holds the letters of all words, n their lengths."""
    begin = np.cumsum(n) - n
    for lo, hi in bounds or _SHORT:
        rows = np.flatnonzero((n >= lo) & (n <= hi))
        step = 16384 * LONG // max(hi, LONG)
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            spot = np.arange(n[own].max())
            inside = spot < n[own, None]
            yield own, np.where(inside, text[np.where(inside, begin[own, None] + spot, 0)], -1), n[own]


def _edges(trie: Trie, m: np.ndarray, i: int):
    """Yields (end, node) of the pieces that may begin at position i, for all words at once."""
    node = np.ones(len(m), np.int64)
    for j in range(i, min(m.shape[1], i + trie.depth)):
        node = trie.step(node, m[:, j])
        if not node.any():
            break
        yield j + 1, node


def _forward(trie: Trie, m: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]."""
    alpha = np.zeros((m.shape[1] + 1, len(m), prob.shape[1]))
    alpha[0] = 1
    for i in range(m.shape[1]):
        bare = m[:, i] == 0
        if bare.any():
            alpha[i + 1, bare] += alpha[i, bare] * UNKNOWN
        for end, node in _edges(trie, m, i):
            alpha[end] += alpha[i] * prob[node]
    return alpha


def _scaled(trie: Trie, m: np.ndarray, n: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word, in each language, by the same sums rescaled at every eighth position."""
    alpha, log = np.zeros((m.shape[1] + 1, len(m), prob.shape[1])), np.zeros((len(m), prob.shape[1]))
    out = np.empty_like(log)
    alpha[0] = 1
    for i in range(m.shape[1] + 1):
        if (done := n == i).any():
            out[done] = log[done] + np.log(np.maximum(alpha[i, done], 1e-300))
        if i == m.shape[1]:
            break
        if i % 8 == 0:
            top = alpha[i : i + trie.depth].max(axis=0)
            top[top == 0] = 1
            alpha[i : i + trie.depth] /= top
            log += np.log(top)
        bare = m[:, i] == 0
        if bare.any():
            alpha[i + 1, bare] += alpha[i, bare] * UNKNOWN
        for end, node in _edges(trie, m, i):
            alpha[end] += alpha[i] * prob[node]
    return out


def _long_edges(trie: Trie, letters: np.ndarray, prob: np.ndarray):
    """Nodes and log probabilities of the pieces of each length (row) that end at each position (1 to n) of a long word."""
    n = len(letters)
    depth = min(trie.depth, n)
    nodes = np.zeros((depth, n + 1), np.int64)
    node = np.ones(n, np.int64)
    for d in range(depth):
        node = trie.step(node[: n - d], letters[d:])
        nodes[d, d + 1 :] = node
    with np.errstate(divide="ignore"):
        logs = np.log(prob[nodes])
    logs[0, 1:][letters == 0] = np.log(UNKNOWN)
    return nodes, logs


def _long_counts(trie: Trie, letters: np.ndarray, prob: np.ndarray, weight: float, total: np.ndarray) -> None:
    """Adds the expected piece counts of a long word, under one language's probabilities, to total."""
    nodes, logs = _long_edges(trie, letters, prob)
    n = len(letters)
    there = _long_on(logs, np.zeros((1, 1)))[:, 0]
    # the same sums from the end: a piece of length d + 1 that starts at i ends at i + d + 1
    back = np.full_like(logs, -np.inf)
    for d in range(len(logs)):
        back[d, d + 1 :] = logs[d, d + 1 :][::-1]
    left = _long_on(back, np.zeros((1, 1)))[::-1, 0]
    for d in range(len(logs)):
        with np.errstate(invalid="ignore"):
            flow = np.exp(there[: n - d] + logs[d, d + 1 :, 0] + left[d + 1 :] - there[n])
        total += np.bincount(nodes[d, d + 1 :], weight * np.nan_to_num(flow), len(total))


def _long_score(model: Model, letters: np.ndarray) -> np.ndarray:
    """Log probability of a long word in each language, piece of it by piece, so that memory stays bounded."""
    depth, sums = model.trie.depth, np.zeros((1, len(model.langs)))
    for at in range(0, len(letters), STRETCH):
        # the pieces that end in this stretch, and the sums before it that they need
        before = min(at, depth - 1)
        _, logs = _long_edges(model.trie, letters[at - before : at + STRETCH], model.prob)
        sums = _long_on(logs, sums[len(sums) - 1 - before :])
    return sums[-1]


def _long_on(logs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Forward sums of a stretch whose first ones are known."""
    depth, n = logs.shape[0], logs.shape[1] - 1
    sums = np.full((n + 1, logs.shape[2]), -np.inf)
    sums[: len(known)] = known
    for j in range(len(known), n + 1):
        k = min(depth, j)
        x = logs[:k, j] + sums[j - k : j][::-1]
        top = np.maximum(x.max(axis=0), -1e300)
        sums[j] = top + np.log(np.maximum(np.exp(x - top).sum(axis=0), 1e-300))
    return sums


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), len(model.langs)))
    if not words:
        return out
    text = model.trie.letters(MARK + MARK.join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    for own, m, n in _classes(text, sizes):
        alpha = _forward(model.trie, m, model.prob)
        out[own] = np.log(np.maximum(alpha[n, np.arange(len(own))], 1e-300))
    for own, m, n in _classes(text, sizes, _LONGER):
        out[own] = _scaled(model.trie, m, n, model.prob)
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes > WIDE):
        out[i] = _long_score(model, text[ends[i] - sizes[i] : ends[i]])
    return out


def fit(counts: dict[str, dict[str, int]], pieces: list[str]) -> Model:
    """Expectation maximisation of piece probabilities from word counts per language, long words included.

    Pieces that no language uses are dropped from the trie at the end; single characters always stay, so that every text has a segmentation.
    """
    langs = sorted(counts)
    seen = {c for words in counts.values() for w in words for c in w} | {MARK}
    pieces = sorted({p for p in pieces if set(p) <= seen} | seen)
    table, ends = trie(pieces)
    used = np.zeros((len(pieces), len(langs)))
    for l, lang in enumerate(langs):
        words = list(counts[lang])
        weight = np.array([counts[lang][w] for w in words], float)
        text, sizes = table.letters("".join(MARK + w for w in words)), np.fromiter(map(len, words), np.int64, len(words)) + 1
        long, starts = np.flatnonzero(sizes > LONG), np.cumsum(sizes) - sizes
        prob = np.zeros((table.size, 1))
        prob[ends, 0] = 1 / len(pieces)
        for _ in range(ROUNDS):
            total = np.zeros(table.size)
            for own, m, n in _classes(text, sizes):
                alpha = _forward(table, m, prob)[:, :, 0]
                z = np.maximum(alpha[n, np.arange(len(own))], 1e-300)
                beta = np.zeros_like(alpha)
                beta[n, np.arange(len(own))] = weight[own] / z
                for i in range(m.shape[1] - 1, -1, -1):
                    for end, node in _edges(table, m, i):
                        flow = prob[node, 0] * beta[end]
                        total += np.bincount(node, alpha[i] * flow, table.size)
                        beta[i] += flow
            for i in long:
                for at in range(0, sizes[i], STRETCH):
                    _long_counts(table, text[starts[i] + at : starts[i] + min(at + STRETCH, sizes[i])], prob, weight[i], total)
            total[0] = 0
            prob[ends, 0] = (total[ends] + SMOOTH) / (total[ends].sum() + SMOOTH * len(pieces))
        used[:, l] = total[ends]
    keep = (used.max(axis=1, initial=0) > 0.01) | np.fromiter((len(p) == 1 for p in pieces), bool, len(pieces))
    kept = [p for p, k in zip(pieces, keep) if k]
    table, ends = trie(kept)
    prob = np.zeros((table.size, len(langs)))
    prob[ends] = (used[keep] + SMOOTH) / (used[keep].sum(axis=0) + SMOOTH * len(kept)) if langs else 0
    return Model(langs, table, prob)


def training_counts(docs: DataFrame, learn: Column, per_lang: int = SAMPLE) -> dict[str, dict[str, int]]:
    """Word counts per language of the sample: of the per_lang rows with the smallest hashes of doc_id, whole texts, those up to which
    there are SAMPLE_BYTES of text, and the first in any case. Repeated rows of a picked doc_id all count.

    The ids are picked first and fetch the texts by a broadcast, which the bound keeps small, so no text is shuffled.
    """
    told = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "bytes")
    picked = told.select("doc_id", "lang", F.octet_length("text").cast("long").alias("bytes")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang)
    picked = picked.withColumn("all", F.sum("bytes").over(Window.partitionBy("lang").orderBy("n"))).where((F.col("all") <= SAMPLE_BYTES) | (F.col("n") == 1))
    sample = told.join(F.broadcast(picked.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+")).alias("w")).where("w <> ''")
    counts: dict[str, dict[str, int]] = {}
    for row in words.groupBy("lang", "w").count().collect():
        counts.setdefault(row["lang"], {})[row["w"]] = row["count"]
    return counts


_LETTER = str.isalpha


class _Places(dict):
    """Word -> its place, in order of appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _predict(shared, keep: float | None):
    """Rows with lang_pred and score in place of text; with keep the rows, text and all, whose language has a score of at least that."""

    def run(batches):
        model = shared.value
        place = _Places()
        known = np.empty((CACHE, len(model.langs)))
        for b in slices(batches, 256):
            if len(place) > CACHE // 2:
                place = _Places()
            old = len(place)
            ids, sizes, letter = [], [], []
            for text in b.column("text").to_pylist():
                letter.append(bool(text) and any(map(_LETTER, text)))
                words = text.lower().split() if letter[-1] else ()
                ids.extend(map(place.__getitem__, words))
                sizes.append(len(words))
            langs, scores = [UND] * len(sizes), [0.0] * len(sizes)
            if ids and model.langs:
                if len(place) > len(known):
                    known = np.concatenate([known, np.empty((len(place), len(model.langs)))])
                known[old : len(place)] = word_scores(model, list(islice(place, old, None)))
                sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(known[ids], axis=0)])
                ends = np.cumsum(sizes)
                logs = sums[ends] - sums[ends - np.array(sizes)]
                top = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for i in np.flatnonzero(letter):
                    langs[i], scores[i] = model.langs[top[i]], float(share[i])
            if keep is not None:
                yield b.filter(pa.array([l != UND and x >= keep for l, x in zip(langs, scores)], pa.bool_()))
                continue
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["text"]).columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(c for c in b.schema.names if c != "text"), "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _predicted(rows: DataFrame, docs: DataFrame, path: str | None, per_lang: int, keep: float | None = None) -> DataFrame:
    """rows, which have a column text, with lang_pred and score in its place, or those that keep lets pass; learned from docs."""
    model = fit(training_counts(docs, ~held_out(F.col("doc_id")), per_lang), vocabulary(path))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    kind = kind if keep is None else rows.schema
    return in_arrow(rows, _predict(shared, keep), kind)


def identify(docs: DataFrame, path: str | None = None, per_lang: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of docs (doc_id, text, lang).

    Learns from labelled rows whose crc32(doc_id) mod 3 is not 1; score is the share of the predicted
    language in the probability of all.
    """
    d = docs.select("doc_id", "text", "lang")
    return _predicted(d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), d, path, per_lang)


def keep_identified(docs: DataFrame, least: float = 0.5, path: str | None = None, per_lang: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose text has a language with a share of at least least."""
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    found = _predicted(rows, docs.select("doc_id", "text", "lang"), path, per_lang, keep=least)
    return found.select(*["text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
