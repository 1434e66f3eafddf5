"""Running totals and places in an order, by sorted ranges: a group with a third of all rows is no single task.

Rows are cut into ranges of (group, order), each sorted in a task of its own; a range's totals are added to the
ranges of the same group after it. Only one row for each group and range is put in order as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def in_ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with ``_p``, the number of its range, as a scratch table: ranges of one group ascend in ``order``."""
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    return scratch(ranged.withColumn("_p", F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df (of in_ranges) with ``name``: the sum of ``value`` over the rows of its group before it, by order."""
    df = df.withColumn("_v", value)
    totals = df.groupBy(*by, "_p").agg(F.sum("_v").alias("_own"))
    ahead = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_ahead", F.sum("_own").over(ahead)).select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), "_ahead")
    here = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(df.schema["_v"].dataType)
    on = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    out = df.withColumn("_here", F.coalesce(F.sum("_v").over(here), zero)).join(totals, on)
    return out.withColumn(name, F.col("_here") + F.coalesce("_ahead", zero)).drop("_v", "_here", "_ahead", "_q", *[f"_b{i}" for i in range(len(by))])


def before(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df (of in_ranges) with ``name``: the value of the row before it in its group, by order; null for the first."""
    last = df.groupBy(*by, "_p").agg(F.max_by(F.struct(F.col(value)), F.struct(*order)).alias("_last"))
    last = last.withColumn("_prev", F.lag("_last").over(Window.partitionBy(*by).orderBy("_p")))
    last = last.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), F.col(f"_prev.{value}").alias("_prev"))
    here = Window.partitionBy(*by, "_p").orderBy(*order)
    on = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    out = df.withColumn("_i", F.row_number().over(here)).withColumn("_lag", F.lag(value).over(here)).join(last, on)
    return out.withColumn(name, F.when(F.col("_i") == 1, F.col("_prev")).otherwise(F.col("_lag"))).drop("_i", "_lag", "_prev", "_q", *[f"_b{i}" for i in range(len(by))])
