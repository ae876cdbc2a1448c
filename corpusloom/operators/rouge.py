"""Answer scores: ROUGE-N, ROUGE-L and ROUGE-Lsum with and without stems, METEOR without synonyms, by Arrow functions; paired comparison."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.stem import stem
from corpusloom.operators import resample

_TOKENS = re.compile("[a-z0-9]+")


def fmeasure(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def rouge_n(pairs: DataFrame, n: int = 1, stems: bool = False) -> DataFrame:
    """Rows (id, precision, recall, fmeasure) of pairs (id, reference, prediction), by clipped counts of n-grams."""
    kind = T.StructType([T.StructField(c, T.DoubleType()) for c in ("precision", "recall", "fmeasure")])

    @F.pandas_udf(kind)
    def clipped(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
        grams = lambda t: Counter(zip(*[t[i:] for i in range(n)]))
        rows = []
        for r, p in zip(reference, prediction):
            a, b = grams(_tokens(r, stems)), grams(_tokens(p, stems))
            rows.append(_scores((a & b).total(), b.total(), a.total()))
        return pd.DataFrame(rows, columns=kind.names)

    return pairs.select("id", clipped("reference", "prediction").alias("s")).select("id", "s.*")


def _tokens(text: str | None, stems: bool = False) -> list[str]:
    """Runs of letters and digits of the lower-cased text; with stems, those of over three characters as their stems."""
    found = _TOKENS.findall((text or "").lower())
    return [stem(t) if len(t) > 3 else t for t in found] if stems else found


def _lcs_rows(a: list[str], b: list[str]) -> list[list[int]]:
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        rows.append(row)
    return rows


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & where.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _scores(hit: int, n_prediction: int, n_reference: int) -> tuple[float, float, float]:
    p, r = hit / n_prediction if n_prediction else 0.0, hit / n_reference if n_reference else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def _union_lcs(reference: list[str], others: list[list[str]]) -> set[int]:
    used = set()
    for other in others:
        rows, i, j = _lcs_rows(reference, other), len(reference), len(other)
        while i and j:
            if reference[i - 1] == other[j - 1]:
                used.add(i - 1)
                i, j = i - 1, j - 1
            elif rows[i][j - 1] > rows[i - 1][j]:
                j -= 1
            else:
                i -= 1
    return used


def _lsum(reference: str, prediction: str, stems: bool = False) -> tuple[float, float, float]:
    refs, preds = ([_tokens(s, stems) for s in (t or "").split("\n") if s] for t in (reference, prediction))
    n_ref, n_pred = sum(map(len, refs)), sum(map(len, preds))
    left, right = {}, {}
    for side, counts in ((refs, left), (preds, right)):
        for s in side:
            for w in s:
                counts[w] = counts.get(w, 0) + 1
    hits = 0
    for r in refs:
        for i in sorted(_union_lcs(r, preds)):
            if left.get(r[i], 0) > 0 and right.get(r[i], 0) > 0:
                hits += 1
                left[r[i]] -= 1
                right[r[i]] -= 1
    return _scores(hits, n_pred, n_ref)


def _meteor_exact(reference: str, prediction: str) -> float:
    """METEOR with exact matches only: no stems, no synonyms."""
    r, p = ((t or "").lower().split() for t in (reference, prediction))
    free: dict[str, list[int]] = {}
    for i in range(len(r) - 1, -1, -1):
        free.setdefault(r[i], []).append(i)
    match = [(i, free[w].pop()) for i, w in enumerate(p) if free.get(w)]
    if not match:
        return 0.0
    precision, recall = len(match) / len(p), len(match) / len(r)
    mean = precision * recall / (0.9 * precision + 0.1 * recall)
    breaks = 1 + sum(1 for x, y in zip(match, match[1:]) if y[0] != x[0] + 1 or y[1] != x[1] + 1)
    return mean * (1 - 0.5 * (breaks / len(match)) ** 3)


def aligned(prediction: list[str], reference: list[str], stages) -> list[tuple[int, int]]:
    """Pairs of places of equal words, stage by stage: a stage maps words to what has to agree. From the end on, each word takes the last one left that agrees with it."""
    left, right, found = list(range(len(prediction))), list(range(len(reference))), []
    for view in stages:
        free: dict[str, list[int]] = {}
        for j in right:
            free.setdefault(view(reference[j]), []).append(j)
        taken = [(i, free[key].pop()) for i in reversed(left) if free.get(key := view(prediction[i]))]
        found += taken
        used, met = {i for i, _ in taken}, {j for _, j in taken}
        left, right = [i for i in left if i not in used], [j for j in right if j not in met]
    return sorted(found)


def _meteor_stem(reference: str, prediction: str) -> float:
    """METEOR with matches of forms, then of stems; synonyms are left out. Chunks are runs of matches that follow each other on both sides."""
    r, p = ((t or "").lower().split() for t in (reference, prediction))
    match = aligned(p, r, (str, stem))
    if not match:
        return 0.0
    precision, recall = len(match) / len(p), len(match) / len(r)
    chunks = 1 + sum(y != (x[0] + 1, x[1] + 1) for x, y in zip(match, match[1:]))
    return precision * recall / (0.9 * precision + 0.1 * recall) * (1 - 0.5 * (chunks / len(match)) ** 3)


_SCORES = ["rouge_l", "rouge_l_precision", "rouge_l_recall", "rouge_lsum", "meteor_exact"]


def answer_scores(pairs: DataFrame, stems: bool = False) -> DataFrame:
    """Rows (id, rouge_l, rouge_l_precision, rouge_l_recall, rouge_lsum, meteor_exact) of pairs (id, reference, prediction), lines as sentences; with stems, meteor_stem
    stands for meteor_exact and ROUGE compares stems."""
    names = [*_SCORES[:-1], "meteor_stem"] if stems else _SCORES
    meteor = _meteor_stem if stems else _meteor_exact

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def scores(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
        out = []
        for r, p in zip(reference, prediction):
            a, b = _tokens(r, stems), _tokens(p, stems)
            precision, recall, f = _scores(lcs_length(a, b), len(b), len(a))
            out.append((f, precision, recall, _lsum(r, p, stems)[2], meteor(r, p)))
        return pd.DataFrame(out, columns=names)

    return pairs.select("id", scores("reference", "prediction").alias("s")).select("id", "s.*")


def multi_reference(scores: DataFrame, column: str = "fmeasure") -> DataFrame:
    """The best score of an id over its references."""
    return scores.groupBy("id").agg(F.max(column).alias(column))


def bootstrap(pairs: DataFrame, seed: str, resamples: int = 10_000) -> DataFrame:
    """One row (n, delta, low, high): the mean paired difference of pairs (id, base, new) and its 95 percent interval, see `resample`."""
    return resample.interval(pairs, seed, resamples)


def generation_gate(meteor_delta: float, meteor_low: float, rouge_delta: float, runtime_ratio: float) -> list[str]:
    """The rules of a generation comparison that fail; none means it may replace its base."""
    rules = [("METEOR_DELTA", meteor_delta >= 0.002), ("METEOR_INTERVAL", meteor_low > 0), ("ROUGE_L_REGRESSION", rouge_delta >= -0.002), ("RUNTIME", runtime_ratio <= 1.25)]
    return [name for name, ok in rules if not (ok and math.isfinite(meteor_delta + meteor_low + rouge_delta + runtime_ratio))]


def retrieval_gate(recall_delta: float, recall_low: float, mrr_delta: float, set_delta: float, same_universe: bool) -> list[str]:
    rules = [("RECALL_DELTA", recall_delta > 0), ("RECALL_INTERVAL", recall_low > 0), ("MRR_REGRESSION", mrr_delta >= 0), ("SET_REGRESSION", set_delta >= 0), ("UNIVERSE", same_universe)]
    return [name for name, ok in rules if not ok]
