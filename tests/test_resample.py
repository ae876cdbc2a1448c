"""Parallel resampling against the plain loop over one generator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import resample
from corpusloom.plans.numbering import numbered


def plain(values, seed, resamples):
    rng = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(seed.encode()).digest(), "big")))
    return np.array([values[rng.integers(0, len(values), len(values))].mean(axis=0) for _ in range(resamples)])


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_means_equal_the_loop(spark, n):
    rng = np.random.default_rng(n)
    values = rng.normal(size=(n, 2))
    ids = [f"{i:05d}" for i in range(n)]
    df = spark.createDataFrame([(ids[i], float(values[i, 0]), float(values[i, 1])) for i in rng.permutation(n)], "id string, a double, b double").repartition(3)
    got = np.array([[r["a"], r["b"]] for r in resample.resampled(df, ["a", "b"], "s", 300).orderBy("resample").collect()])
    assert np.allclose(got, plain(values, "s", 300), rtol=0, atol=1e-12)
    row = resample.interval(df.select("id", F.lit(0.0).alias("base"), F.col("a").alias("new")), "s", 300).first()
    want = np.quantile(plain(values[:, :1], "s", 300), [0.025, 0.975])
    assert row["n"] == n and np.allclose([row["delta"], row["low"], row["high"]], [values[:, 0].mean(), *want], atol=1e-12)
    rows = {r["score"]: (r["low"], r["mid"], r["high"]) for r in resample.aggregated(df, ["a", "b"], "s", 200).collect()}
    both = np.percentile(plain(values, "s", 200), [2.5, 50, 97.5], axis=0)
    assert np.allclose(rows["a"], both[:, 0], atol=1e-12) and np.allclose(rows["b"], both[:, 1], atol=1e-12)


def test_slices_and_blocks_make_the_same_draws():
    """Draws of slices put together are those of one generator, skipped ones included."""
    n = 3_000_000_019  # so large that many draws are skipped
    rng = np.random.Generator(resample._generator("x"))
    slices = np.concatenate([resample._drawn("x", p, n) for p in range(2)])
    assert len(slices) < 2 * resample.DRAWS * 0.75
    assert (slices[:2_000_000] == rng.integers(0, n, 2_000_000)).all()
    rng.integers(0, n, len(slices) - 2_000_010)
    values = np.arange(10.0)
    run = resample._summed("y", 10, 50, 1)
    whole = run([_batch(0, 0, values)])
    halves = [b for first in (0, 5) for b in run([_batch(0, first, values[first : first + 5])])]
    total = np.zeros(50)
    for b in halves:
        np.add.at(total, b.column("resample").to_numpy(), b.column("sums").flatten().to_numpy())
    assert (total == next(iter(whole)).column("sums").flatten().to_numpy()).all()


def _batch(part, first, values):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"slice": [part], "before": [0], "first": [first], "raw": [values.astype("<f8").tobytes()]})


def test_odd_tables(spark):
    none = spark.createDataFrame([], "id string, base double, new double")
    assert resample.interval(none, "s", 10).count() == 0
    with pytest.raises(ValueError, match="nulls"):
        resample.interval(spark.createDataFrame([("a", None, 1.0)], "id string, base double, new double"), "s", 10).collect()


def test_numbers_without_a_single_task(spark):
    rows = [(i * 7919 % 1000, f"x{i}") for i in range(1000)] + [(None, "null"), (5, "x5")]
    df = spark.createDataFrame(rows, "k long, id string").repartition(6)
    got = numbered(df, F.col("k"), F.col("id"), name="place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1002))
    assert [(r["k"], r["id"]) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
