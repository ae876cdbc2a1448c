"""Rows for Python workers in batches limited by bytes, and workers that give freed memory back.

Workers outlive their tasks, and an executor's memory is shared by the stages of a job, so nothing a task gathered may stay. Without the limit a batch has 10,000 rows, however long.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to a Python worker at once; a longer row goes alone.
BATCH = 8 << 20


def limit_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session are limited by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def tidy() -> None:
    """Gives freed memory back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def in_arrow(df: DataFrame, run, kind) -> DataFrame:
    """df.mapInArrow in batches limited by bytes. When a task ends, its worker gives the freed memory back to the machine."""
    limit_batches(df.sparkSession)

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(tidied, kind)
