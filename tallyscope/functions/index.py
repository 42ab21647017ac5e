"""Consecutive 0-based row indexes in a sort order, without a global window or RDDs.

The frame is range-partitioned on the order key and checkpointed (so partition
ids are stable), rows are numbered inside their partition, and each partition's
offset comes from a per-partition count table (one row per partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def consecutive_index(df: DataFrame, order: list[str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = partitions or max(1, spark.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(parts, *order).withColumn("_ipid", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("_ipid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_ipid", (F.coalesce(F.sum("_n").over(
        Window.orderBy("_ipid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_ipid").orderBy(*order)) - 1
    # The offsets table has one row per partition, so broadcasting it is bounded.
    return (ranged.withColumn("_loc", local).join(F.broadcast(offsets), "_ipid")
            .withColumn(name, (F.col("_off") + F.col("_loc")).cast("long")).drop("_ipid", "_loc", "_off"))
