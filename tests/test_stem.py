"""Stems by the published examples, and scores that rest on them by plain versions."""

import itertools
import random

import pytest

from corpusloom.functions.stem import stem
from corpusloom.operators import rouge

# fixed values: the examples of the published algorithm, each with its stem, and the irregular and short forms
EXAMPLES = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll died die dying die skies sky news news innings inning succeed succeed enjoy enjoy say say by by as as""".split()


@pytest.mark.parametrize("word, want", list(zip(EXAMPLES[::2], EXAMPLES[1::2])))
def test_examples(word, want):
    assert stem(word) == want


def plain_alignment(p, r, stages):
    """From the end on, place by place."""
    left, right, out = list(enumerate(p)), list(enumerate(r)), []
    for view in stages:
        for i in range(len(left) - 1, -1, -1):
            for j in range(len(right) - 1, -1, -1):
                if view(left[i][1]) == view(right[j][1]):
                    out.append((left.pop(i)[0], right.pop(j)[0]))
                    break
    return sorted(out)


def test_alignment_equals_the_plain_one():
    rng = random.Random(2)
    words = ["run", "runs", "running", "cat", "cats", "the", "of"]
    for _ in range(300):
        p, r = rng.choices(words, k=rng.randint(0, 9)), rng.choices(words, k=rng.randint(0, 9))
        assert rouge.aligned(p, r, (str, stem)) == plain_alignment(p, r, (str, stem))


def test_scores_with_stems(spark):
    rows = [("a", "the cats are running fast", "a cat runs fast"), ("b", None, "x"), ("c", "same words here", "same words here"), ("d", "one", "")]
    pairs = spark.createDataFrame(rows, "id string, reference string, prediction string")
    with_stems = {r["id"]: r for r in rouge.answer_scores(pairs, stems=True).collect()}
    # tokens of three characters keep their form: the cat are run fast, a cat run fast share cat run fast of "cats" -> cat, "running" -> run, "runs" -> run
    assert with_stems["a"]["rouge_l"] == pytest.approx(2 * (3 / 4) * (3 / 5) / (3 / 4 + 3 / 5))
    match = [(1, 1), (2, 3), (3, 4)]
    precision, recall = 3 / 4, 3 / 5
    assert with_stems["a"]["meteor_stem"] == pytest.approx(precision * recall / (0.9 * precision + 0.1 * recall) * (1 - 0.5 * (2 / 3) ** 3)) and len(match) == 3
    assert with_stems["b"]["rouge_l"] == with_stems["d"]["meteor_stem"] == 0.0 and with_stems["c"]["rouge_lsum"] == 1.0
    assert {r["id"]: round(r["fmeasure"], 6) for r in rouge.rouge_n(pairs, 1, stems=True).collect()}["a"] == round(2 * 0.75 * 0.6 / 1.35, 6)
    plain = {r["id"]: r for r in rouge.answer_scores(pairs).collect()}
    assert plain["a"]["rouge_l"] == pytest.approx(2 * (1 / 4) * (1 / 5) / (1 / 4 + 1 / 5)) and "meteor_exact" in plain["a"].asDict()


def test_least_chunks_are_never_more_than_alignments_can_have():
    """With words that occur once the alignment is the only one, so its chunks are the fewest."""
    for p in itertools.permutations("abcd"):
        assert sorted(rouge.aligned(list(p), list("abcd"), (str, stem))) == sorted((i, "abcd".index(w)) for i, w in enumerate(p))
