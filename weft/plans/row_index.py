"""Places of rows in a global order, without a window over all rows or all rows of a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft import checkpoints


def ordered_index(df: DataFrame, *order: str | Column, by: tuple[str, ...] = (), name: str = "row_idx") -> DataFrame:
    """Adds each row's 0-based place in the order, within ``by``; the order should end in a tie-break.

    Rows are sorted by range, which Spark deals out evenly whatever the groups' sizes, and written; a row's place is
    its place in its partition after the rows of the partitions before it.
    """
    checkpoints.ensure(df.sparkSession)
    inner = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the low bits count a partition's rows
    d = df.orderBy(*by, *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", inner).checkpoint()
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    d = d.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_start") + F.col("_at")).drop("_part", "_start")
    if not by:
        return d.withColumnRenamed("_at", name)
    first = d.groupBy(*by).agg(F.min("_at").alias("_first"))
    return d.join(first, list(by)).withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first")
