"""Counts, rates and latency quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_ranges, running


def live_counts(entities: DataFrame, collections: DataFrame) -> DataFrame:
    """One row: collections, entities, vectors and patches of the live entities (one row an id)."""
    patches = F.sum(F.coalesce(F.size("patches"), F.lit(0))) if "patches" in entities.columns else F.lit(0)
    live = entities.where(~F.coalesce(F.col("deleted"), F.lit(False))).agg(
        F.count("*").alias("entities"), F.count_if(F.size("vector") > 0).alias("vectors"), F.coalesce(patches, F.lit(0)).cast("long").alias("patches")
    )
    return live.crossJoin(collections.agg(F.count("*").alias("collections")))  # one row each


def rate(events: DataFrame, ts: str, group: list[str]) -> DataFrame:
    """Events a second between the first and the last of each group; a group at one instant has its count."""
    span = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    return events.groupBy(*group).agg(F.count("*").alias("n"), span.alias("span_s")).withColumn("qps", F.when(F.col("span_s") > 0, F.col("n") / F.col("span_s")).otherwise(F.col("n").cast("double")))


def pick(values: DataFrame, value: str, group: list[str], places: dict[str, Column]) -> DataFrame:
    """group and, by name, the value at a 0-based place of the group's sorted values; a place is a Column of their count ``n``.

    Values are sorted in ranges, so a group with most of the rows is no single task.
    """
    own = in_ranges(values.where(F.col(value).isNotNull()).select(*group, value), group, [value])
    ranked = running(own, group, [value], F.lit(1).cast("long"), "_i")
    n = own.groupBy(*group).agg(F.count("*").alias("n"))
    for name, place in places.items():
        n = n.withColumn(f"_at_{name}", place)
    on = None
    for c in group:
        one = F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        on = one if on is None else on & one
    both = ranked.join(n.select(*[F.col(c).alias(f"_g_{c}") for c in group], *[f"_at_{m}" for m in places]), on)
    hit = both.where(F.greatest(*[(F.col("_i") == F.col(f"_at_{m}")).cast("int") for m in places], F.lit(0)) == 1)
    return hit.groupBy(*group).agg(*[F.max(F.when(F.col("_i") == F.col(f"_at_{m}"), F.col(value))).alias(m) for m in places])


def latency(events: DataFrame, value: str, group: list[str], order: list[str], last: int = 512) -> DataFrame:
    """p50 and p99 of each group's last 512 values: the sorted values at n / 2 and at max(int(0.99 n) - 1, 0)."""
    recent = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    own = events.withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= last).drop("_r")
    n = F.col("n")
    return pick(own, value, group, {"p50": F.floor(n / 2), "p99": F.greatest(F.floor(n * 99 / 100) - 1, F.lit(0))})


def quantile_by_rank(events: DataFrame, value: str, group: list[str], p: float, name: str) -> DataFrame:
    """The sorted values at int((n - 1) p)."""
    return pick(events, value, group, {name: F.floor((F.col("n") - 1) * p)})
