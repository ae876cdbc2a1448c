"""Global row numbers without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.plans.materialize import written

#: Bits of monotonically_increasing_id that count the rows of a partition.
_LOCAL = 33


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """df with name, its place from 0 in the order given. Rows are dealt out by ranges of the order and sorted there, so rows that tie in all of it share a task; end it with an id.

    The table is written once, since a range's bounds come from a sample. Only the counts of partitions meet in one task.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    table = written(dealt, "numbered")
    part = F.shiftright("_m", _LOCAL)
    counts = table.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    starts = counts.select("_p", before.alias("_s"))
    told = table.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return told.withColumn(name, F.col("_s") + F.col("_m").bitwiseAND((1 << _LOCAL) - 1)).drop("_p", "_s", "_m")
