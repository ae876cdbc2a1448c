"""Resumable batches. The model has no unbounded input; a restart takes up what is not yet done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remaining(work: DataFrame, done: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """The rows of work whose key and fingerprint are not among done."""
    return work.join(done.select(key, fingerprint).distinct(), [key, fingerprint], "left_anti")


def run_resumable(spark, source: str, schema: str, sink: str, checkpoint: str, transform) -> None:
    """Takes all files of source that no earlier run has taken, and appends transform's rows to sink; exactly once by the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(source)
    out = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    out.awaitTermination()


def with_fingerprint(df: DataFrame, columns: list[str], name: str = "fingerprint") -> DataFrame:
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256))
