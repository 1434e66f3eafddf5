"""One ranking from several scores: percentiles with averaged ties, inverse normal, weighted mean."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import range_of
from ..session import scratch

# Coefficients of algorithm AS 241 (PPND16) for the inverse normal distribution.
_CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(x: Column, pair) -> Column:
    def horner(cs):
        out = F.lit(cs[-1])
        for c in cs[-2::-1]:
            out = out * x + F.lit(c)
        return out

    return horner(pair[0]) / horner(pair[1])


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1, to about 1e-15."""
    q = p - F.lit(0.5)
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(r - F.lit(1.6), _MIDDLE)).otherwise(_ratio(r - F.lit(5.0), _TAIL))
    return F.when(F.abs(q) <= 0.425, q * _ratio(F.lit(0.180625) - q * q, _CENTRAL)).otherwise(F.when(q < 0, -tail).otherwise(tail))


def value_places(long: DataFrame, rows_per_part: int = 1_000_000) -> DataFrame:
    """``long`` (g, name, v and others) with n, better and ties of each row in its (g, name); larger v is better, null comes last.

    Values are cut into ranges of about ``rows_per_part`` rows that are ranked one by one and joined by the ranges'
    totals, so a group with a third of all rows is no single task. A range of one value (or of the missing ones) needs
    no order: its rows are spread.
    """
    rows = long.count()
    part = F.lit(0)
    if rows > rows_per_part:
        cuts = min(512, -(-rows // rows_per_part) * 2)
        quantiles = F.percentile_approx("v", [i / cuts for i in range(1, cuts)], 8 * cuts).alias("q")
        for r in long.groupBy("name").agg(quantiles).collect():  # one row for each kind of score
            q = sorted({x for x in r["q"] or [] if math.isfinite(x)})
            part = F.when(F.col("name") == r["name"], range_of(F.col("v"), q)).otherwise(part)
    long = long.withColumn("part", F.when(F.col("v").isNotNull(), part).otherwise(-1))
    totals = long.groupBy("g", "name", "part").agg(F.count("*").alias("own"), (F.min("v").eqNullSafe(F.max("v"))).alias("flat"))
    over = Window.partitionBy("g", "name")
    totals = totals.withColumn("n", F.sum("own").over(over)).withColumn(
        "above", F.coalesce(F.sum("own").over(over.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    on = [F.col(c) == F.col(f"_{c}") for c in ("g", "name", "part")]
    both = long.join(totals.select(*[F.col(c).alias(f"_{c}") for c in ("g", "name", "part")], "own", "flat", "n", "above"), on)
    both = both.withColumn("_salt", F.when(F.col("flat"), F.spark_partition_id()).otherwise(-1))
    inner = Window.partitionBy("g", "name", "part", "_salt").orderBy(F.desc("v"))
    within, same = F.rank().over(inner) - 1, F.count("*").over(inner.rangeBetween(Window.currentRow, Window.currentRow))
    return (
        both.withColumn("_within", within).withColumn("_same", same)
        .withColumn("better", F.col("above") + F.when(F.col("flat"), 0).otherwise(F.col("_within")))
        .withColumn("ties", F.when(F.col("flat"), F.col("own")).otherwise(F.col("_same")))
        .select(*long.drop("part").columns, "n", "better", "ties")
    )


def fuse_percentiles(fused: DataFrame, weights: dict[str, float] | None = None, rows_per_part: int = 1_000_000) -> DataFrame:
    """qid, id, score and, of each channel, the place (1 = best, ties share the best one).

    Channels: vec_score (a distance), key_score, rrf. A channel's score is missing where its rank is
    null or 0, or the score null or not a number; missing ones tie behind all others. The percentile of
    a score with ``better`` ones before it and t equal ones among n is (n - better - (t - 1) / 2 - 0.5) / n;
    its normal quantile is averaged by ``weights`` (default 1 each).

    Repeated rows of (qid, id) count once (the largest by value if they differ). Null qid or id: dropped.
    Infinite values rank as such. An empty table gives an empty table; further columns are not read.
    """
    weights = {"vec": 1.0, "key": 1.0, "rrf": 1.0} | (weights or {})
    scored = lambda rank, score: F.when((F.coalesce(F.col(rank), F.lit(0)) > 0) & ~F.isnan(score), F.col(score))
    rows = (
        fused.where("qid is not null and id is not null")
        .select("qid", "id", (-scored("vec_rank", "vec_score")).alias("vec"), scored("key_rank", "key_score").alias("key"), F.when(~F.isnan("rrf"), F.col("rrf")).alias("rrf"))
        .groupBy("qid", "id")
        .agg(F.max(F.struct("vec", "key", "rrf")).alias("s"))
    )
    names = ["vec", "key", "rrf"]
    rows = scratch(rows.select("qid", "id", *[(F.col(f"s.{n}") + F.lit(0.0)).alias(n) for n in names]), "scores")
    long = rows.select(
        F.col("qid").alias("g"), "id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])).alias("x")
    ).select("g", "id", "x.name", "x.v")
    p = (F.col("n") - F.col("better") - (F.col("ties") - 1) / 2 - 0.5) / F.col("n")
    each = value_places(long, rows_per_part).select("g", "id", "name", "better", inverse_normal(p).alias("z"))
    pick = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    wide = each.groupBy(F.col("g").alias("qid"), "id").agg(*[pick(n, "z").alias(f"{n}_z") for n in names], *[(pick(n, "better") + 1).alias(f"{n}_place") for n in names])
    score = sum((F.col(f"{n}_z") * float(weights[n]) for n in names), F.lit(0.0)) / F.lit(sum(weights.values()))
    return wide.select("qid", "id", score.alias("score"), *[f"{n}_place" for n in names])


def placed(fused: DataFrame, **kw) -> DataFrame:
    """fuse_percentiles with ``place``: 1 and the number of candidates with a larger score (to nine digits)."""
    out = scratch(fuse_percentiles(fused, **kw), "fused")
    one = out.withColumnRenamed("qid", "g").withColumn("name", F.lit("all")).withColumn("v", F.round("score", 9))
    got = value_places(one, kw.get("rows_per_part", 1_000_000))
    return got.select(F.col("g").alias("qid"), "id", F.col("v").alias("score"), (F.col("better") + 1).alias("place"), "vec_place", "key_place", "rrf_place")


def ranked(fused: DataFrame, **kw) -> DataFrame:
    """The candidates of each request in one order: by score, then smaller id, with their position."""
    tie = Window.partitionBy("qid", "score").orderBy("id")
    return placed(fused, **kw).withColumn("position", F.col("place") - 1 + F.row_number().over(tie)).drop("place")


def leaders(fused: DataFrame, first: int = 3, **kw) -> DataFrame:
    """(qid, id) of the candidates among the ``first`` by every channel, taken from the head of the fused order.

    With weights above 0 only a candidate that is better in some channel can have a larger score, and in each of the
    three at most ``first`` - 1 are better than such a leader: it is among the first 3 (first - 1) + 1 of the order.
    """
    head = placed(fused, **kw).where(F.col("place") <= 3 * (first - 1) + 1)
    return head.where((F.col("vec_place") <= first) & (F.col("key_place") <= first) & (F.col("rrf_place") <= first)).select("qid", "id")
