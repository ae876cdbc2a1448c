"""Cutting lineage through the shared folder of the cluster.

Every written table goes to ``spark.checkpoint.dir``. Where the session has none, a local session (tests, notebooks) gets a folder
under the system's temporary directory once; on a cluster that is an error, as executors could not see each other's files.
``localCheckpoint`` is never used: its blocks live on one executor and die with it.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, or a fresh temporary one where it is unset and the session is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = getattr(spark, "_corpusloom_dir", None)
        if not where:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
            spark._corpusloom_dir = where
    return where.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df as Parquet into the shared folder, with the writer's options, and returns the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.options(**options).parquet(path)
    release(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._corpusloom_path = path
    return table


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """df dealt out by key once and written so that later joins and groupings by key need no shuffle of it.

    The number of buckets is that of shuffle partitions, with which the other side of a join agrees by itself.
    """
    spark = df.sparkSession
    n, name, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{label}_{uuid.uuid4().hex}".replace("-", "_"), fresh_path(spark, label)
    df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).saveAsTable(name)
    release(spark)
    table = spark.table(name)
    table._corpusloom_path, table._corpusloom_name = path, name
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `written` or `bucketed` that no later plan reads, so that a long job holds few of them at a time."""
    for table in tables:
        spark = table.sparkSession
        if hasattr(table, "_corpusloom_name"):
            spark.sql(f"DROP TABLE IF EXISTS {table._corpusloom_name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(table._corpusloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished steps; they stay until the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
