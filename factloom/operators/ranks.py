"""Row numbers over a whole relation without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import checkpointed


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number from 1 in ``order``, which must be total: ranges of the order are counted, then numbered one by one.

    Only the counts, a row per range, meet in one task.
    """
    parts = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    joined = parts.join(F.broadcast(starts), "_range")  # a row per range: no more than there are shuffle partitions
    return joined.withColumn(name, F.col("_start") + within).drop("_range", "_start")
