"""Global running sums and ranks without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.plans.durable import durable

BUCKETS = 4096


def running_sum(df: DataFrame, size: str, order: list[str], out: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over all rows before this one, in an order that is fixed by a hash of ``order``.

    Rows are spread over ``buckets`` hash ranges. Only one sum per range (at most ``buckets`` rows) passes through
    one task; within a range an ordinary partitioned window does the rest.
    """
    bucketed = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = bucketed.groupBy("_b").agg(F.sum(size).alias("_s"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(7), *order), *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.join(F.broadcast(starts), "_b")  # at most `buckets` rows
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .drop("_b", "_start")
    )


def sum_below(df: DataFrame, value: str, size: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows with a smaller ``value``; values must be distinct.

    Rows are cut into ranges of the value and written, so that the ranges stay what they are; one sum per range passes
    through one task, and an ordinary window does the rest within each range.
    """
    placed = durable(df.repartitionByRange(value).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_p").agg(F.sum(size).alias("_s")).select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    # a row a range
    return placed.join(F.broadcast(starts), "_p").withColumn(out, F.col("_start") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_p", "_start")
