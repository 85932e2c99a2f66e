"""A global row number without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgate.session import materialize


def global_rank(df: DataFrame, key: str | list[str | Column], rank: str = "rank") -> DataFrame:
    """df with `rank`, 1 for the smallest key, which is a column or a list of them. Keys must be distinct.

    Rows are shuffled once, into ranges of the key, sorted there and written with their number in their range; a table with one row per range gives the offsets.
    """
    keys = key if isinstance(key, list) else [key]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # The lower 33 bits of that id count the rows of a task, from 0.
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialize(placed.withColumns({"_part": F.spark_partition_id(), "_at": at}), "ranked")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(rank, F.col("_off") + F.col("_at") + 1).drop("_part", "_at", "_off")
