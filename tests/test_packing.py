"""Packed sequences: nothing lost or split, masks and ends, the same whatever the partitions; the plan against packing row by row."""

import random
from collections import Counter

import pytest

from corpusloom.operators import packing

KIND = "example_id string, prompt array<int>, target array<int>"


def examples(n=400, seed=0):
    rng = random.Random(seed)
    return [(f"e{i}", [rng.randrange(1000) for _ in range(rng.randint(0, 80))] or None, [rng.randrange(1000) for _ in range(rng.randint(1, 20))], "clash") for i in range(n)]


def test_no_token_is_lost_or_split(spark):
    rows, length = examples(), 64
    made = packing.trimmed(spark.createDataFrame([r[:3] for r in rows], KIND), length)
    got = packing.packed(made, length).orderBy("sequence").collect()
    assert [r["sequence"] for r in got] == list(range(len(got)))
    want = {}
    for e, p, t, _ in rows:
        p = (p or [])[-(length - len(t)) :]
        want[e] = (p + t, [-100] * len(p) + t)
    found = {}
    for r in got:
        assert len(r["ids"]) == len(r["labels"]) == r["ends"][-1] <= length
        for e, s, x in zip(r["example_ids"], [0, *r["ends"]], r["ends"]):
            assert e not in found
            found[e] = (r["ids"][s:x], r["labels"][s:x])
    assert found == want
    again = packing.packed(made.repartition(7), length).orderBy("sequence").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in got]
    row = packing.report(packing.packed(made, length), length).first()
    assert row["examples"] == 400 and row["tokens"] == sum(len(x[0]) for x in want.values()) and row["fill"] > 0.93
    assert row["loss_tokens"] == sum(len(r[2]) for r in rows)


def one_by_one(sizes, length):
    """Each sequence takes the longest rows that fit, one after the other."""
    left, out = Counter(sizes), []
    while left:
        room, taken = length, []
        while fits := [n for n in left if n <= room]:
            taken.append(max(fits))
            room -= taken[-1]
            left -= Counter(taken[-1:])
        out.append(tuple(taken))
    return out


def test_runs_equal_packing_one_by_one():
    rng = random.Random(3)
    for _ in range(200):
        length = rng.randint(1, 30)
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
        sequences = {}
        for n, first, rows, sequence, per, slot in packing.runs(dict(Counter(sizes)), length):
            for k in range(rows):
                sequences.setdefault(sequence + k // per, {})[slot + k % per] = n
        made = [tuple(s[i] for i in range(len(s))) for _, s in sorted(sequences.items())]
        assert made == one_by_one(sizes, length) and sorted(sequences) == list(range(len(made)))


def test_odd_rows(spark):
    for bad in (("a", [1], []), ("a", [1], None), ("a", None, [1] * 8)):
        with pytest.raises(Exception, match="GENERATOR_TARGET"):
            packing.trimmed(spark.createDataFrame([bad], KIND), 8).collect()
    twice = packing.trimmed(spark.createDataFrame([("a", [1], [2])] * 2, KIND), 8)
    with pytest.raises(ValueError, match="unique"):
        packing.packed(twice, 8)
    none = packing.packed(packing.trimmed(spark.createDataFrame([], KIND), 8), 8)
    assert none.count() == 0 and packing.report(none, 8).first()["fill"] is None
