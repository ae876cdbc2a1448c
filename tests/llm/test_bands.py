"""Bands of small sets agree as often as the similarity says."""

import numpy as np
import pyarrow as pa

from corpusloom.llm import minhash


def test_bands_of_small_sets_agree_independently():
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(1500):  # 4 and 3 shingles, similarity 0.75
        words = [f"w{x}" for x in rng.integers(0, 10**9, 8)]
        texts += [" ".join(words), " ".join(words[:7])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    bands = np.array([x for b in minhash._signatures(minhash.WIDTH)([batch]) for x in b.column("bands").to_pylist()])
    agree = bands[0::2] == bands[1::2]
    assert agree.mean() > 0.9 * 0.75**minhash.ROWS
    assert agree.any(axis=1).all()
