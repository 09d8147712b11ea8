"""Consecutive numbers over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from inkwell.functions.checkpoint import checkpointed


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """Add ``out``: each row's place from 1 in the order of a column, nulls first; equal values in any order.

    Rows are range-sorted and numbered within their task; only one count per task meets in one place.
    """
    rows = checkpointed(df.repartitionByRange(F.col(order).asc()).withColumn("__part", F.spark_partition_id()))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", before).drop("__n")
    local = F.row_number().over(W.partitionBy("__part").orderBy(order))
    return rows.withColumn("__local", local).join(F.broadcast(sizes), "__part").withColumn(out, (F.col("__before") + F.col("__local")).cast("long")).drop("__part", "__before", "__local")
