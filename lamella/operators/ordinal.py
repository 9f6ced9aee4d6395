"""Numbering of rows over a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.operators.shared import stored


def with_ordinal(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the number of each row (from 0) in an order, which must be total to give the same numbers again.

    Rows are dealt by ranges of the order; numbers inside a range start after the counts of the ranges before. Only
    these counts, one for each partition, meet in one place.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    numbered = ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_range")
    return numbered.withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")
