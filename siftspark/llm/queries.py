"""The queries of this subpackage over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import knn, live
from ..session import scratch
from . import bpe, distinctive, forest, lookalike, mixing, neardup, ngrams, peaks, percentile
from .oracle import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored terms that occur at least three times in a live text record and in 2 to 12 of them."""
    scored = distinctive.distinctive_terms(table(spark, sf_dir, "entities"))
    return scored.where("score > 0 and tf >= 3 and df between 2 and 12").select("id", "term")


@query
def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every term of every live text record."""
    return distinctive.distinctive_terms(table(spark, sf_dir, "entities")).withColumn("score", F.round("score", 6))


@query
def p1_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most distinctive terms of each record."""
    return distinctive.top_terms(table(spark, sf_dir, "entities")).select("id", "rank", "term", F.round("score", 5).alias("score"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the groups of at least 15 that all records confirm."""
    members, _ = peaks.checked_groups(forest.vector_table(table(spark, sf_dir, "entities")))
    return members.where("sound").select("id", "group_id")


@query
def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical members of each group, whatever its size, and whether all records confirm it."""
    members, _ = peaks.checked_groups(forest.vector_table(table(spark, sf_dir, "entities")))
    return peaks.typical(members)


@query
def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each live record with a usable vector, the group's size and the record's mean cosine with the others."""
    members, _ = peaks.checked_groups(forest.vector_table(table(spark, sf_dir, "entities")))
    return members.select("id", "group_id", "size", F.round("mean", 6).alias("mean"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of live text records of different documents with nearly the same content."""
    return neardup.near_duplicates(table(spark, sf_dir, "entities"))


@query
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class, group and number of links of each live text record."""
    return neardup.near_groups(table(spark, sf_dir, "entities"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate among the first three by each score, from the head of the fused order."""
    return percentile.leaders(table(spark, sf_dir, "fused"))


@query
def p5_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order of each request's candidates."""
    return percentile.ranked(table(spark, sf_dir, "fused")).select("qid", "id", "position", "score")


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a cosine of at least 0.955, one among the five nearest of the other."""
    return forest.close_pairs(forest.vector_table(table(spark, sf_dir, "entities")), 0.955, probes=2)


@query
def p6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every record whose id is divisible by 20, among all records."""
    vectors = forest.vector_table(table(spark, sf_dir, "entities"))
    return forest.nearest(vectors, 5, every=20).withColumn("cosine", F.round("cosine", 6))


@query
def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records asked as in p6_nearest, and whether 95 of 100 of their exact five nearest are found.

    The exact ones come from the block scan of all records; a neighbour as near as the fifth counts as found.
    """
    vectors = forest.vector_table(table(spark, sf_dir, "entities"))
    found = forest.nearest(vectors, 5, every=20)
    unit = live.live_rows(table(spark, sf_dir, "entities"), [F.col("vector").cast("array<double>").alias("vector")])
    unit = scratch(unit.where(live.usable_vector(F.col("vector"), 64)).select("id", V.normalize(F.col("vector")).alias("vector")), "unit")
    truth = knn.flat_top_k(unit.where("id % 20 = 0").withColumnRenamed("id", "qid"), unit, 6).where("qid <> id")
    fifth = truth.groupBy("qid").agg(F.sort_array(F.collect_list("dist")).alias("d")).select("qid", F.element_at("d", F.least(F.lit(5), F.size("d"))).alias("far"), F.least(F.lit(5), F.size("d")).alias("wanted"))
    hits = found.join(fifth, F.col("id") == F.col("qid")).where(F.round(1 - F.col("cosine"), 6) <= F.col("far") + 1e-6).groupBy("qid").agg(F.count("*").alias("n"))
    each = fifth.join(hits, "qid", "left").select("wanted", F.least(F.coalesce("n", F.lit(0)), F.col("wanted")).alias("got"))
    return each.agg(F.count("*").alias("asked"), (F.sum("got") >= F.sum("wanted") * 0.95).alias("reached"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and tags in one record only, or in more than a quarter of all."""
    return ngrams.value_frequencies(table(spark, sf_dir, "entities")).where("mark is not null").select("kind", "value", "mark")


@query
def p7_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every term and tag."""
    return ngrams.value_frequencies(table(spark, sf_dir, "entities"))


@query
def p7_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every run of one to three terms."""
    return ngrams.term_ngrams(table(spark, sf_dir, "entities"), 3)


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(table(spark, sf_dir, "documents"))


@query
def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document decoded from its ids."""
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))


@query
def p8_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document by the end of its last token."""
    return bpe.token_table(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("bytes"))


@query
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in the mixture, with its shard and place."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.mixture_report(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose texts differ but look the same."""
    return lookalike.look_pairs(table(spark, sf_dir, "documents"))


@query
def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of each text."""
    return lookalike.canonical(table(spark, sf_dir, "documents"))


@query
def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of texts that look the same, for each document."""
    return lookalike.look_classes(table(spark, sf_dir, "documents"))
