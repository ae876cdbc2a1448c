"""Small helpers that several operators of this package share."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.arrow import in_arrow  # noqa: F401  the operators take it from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """bytes -> 64-bit hash. Only a cache: emptied when it holds LIMIT words, so memory stays bounded. Words over LONG bytes are not kept."""

    LIMIT, LONG = 200_000, 64

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value


def slices(batches, rows: int = 512):
    """Record batches cut into pieces of few rows, so that one piece's work arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def binary_lists(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())
