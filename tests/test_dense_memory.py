"""A pair of blocks is scored in slices, so its memory does not grow with the product of their rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
from corpusloom.operators import dense


def test_no_block_is_multiplied_whole():
    n = 4096
    m = np.random.default_rng(2).normal(size=(n, 4))
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    ids = [str(i) for i in range(n)]
    pair = pa.RecordBatch.from_pylist([{"ids": ids, "vectors": m.tobytes(), "rows": n, "error": 0.0, "qids": ids, "qvectors": m.tobytes()}] * 2)
    tracemalloc.start()
    found = [b.num_rows for b in dense._met(3, True, "<f8")(iter([pair]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] == found[1] >= 3 * n
    assert peak < n * n * 8 / 2  # half of the scores of all pairs
