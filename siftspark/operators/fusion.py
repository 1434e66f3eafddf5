"""Reciprocal-rank fusion, recall and the normal form of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_K = 60


def assign_ranks(scored: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def positive_or(c: Column, default) -> Column:
    """c where it is greater than 0, else the default."""
    return F.when(c > 0, c).otherwise(F.lit(default))


def rrf_fuse(vector: DataFrame, keyword: DataFrame, params: DataFrame | None = None, k: int = DEFAULT_K, vector_weight: float = 1.0, keyword_weight: float = 1.0) -> DataFrame:
    """(qid, id, rrf, vec_rank, key_rank, vec_score, key_score) of two rankings (qid, id, rank, score).

    rrf = sum of weight / (k + rank) over the channels that have the id. An absent channel has rank 0 and
    score 0. ``params`` (qid, rrf_k, vector_weight, keyword_weight) goes before the arguments; k <= 0
    means 60, a weight <= 0 or null means 1. One shuffle: the channels are one table, summed by (qid, id).
    An id that a channel names twice counts with its best rank.
    """
    both = vector.select("qid", "id", F.lit(0).alias("ch"), "rank", F.col("score").cast("double").alias("score")).unionByName(
        keyword.select("qid", "id", F.lit(1).alias("ch"), "rank", F.col("score").cast("double").alias("score"))
    )
    # Asked for, not left to the planner: a union of two rankings that happen to lie by qid isn't taken as partitioned.
    both = both.repartition("qid", "id")
    pick = lambda ch, f, c: f(F.when(F.col("ch") == ch, F.col(c)))
    wide = both.groupBy("qid", "id").agg(
        pick(0, F.min, "rank").alias("vr"), pick(1, F.min, "rank").alias("kr"), pick(0, F.max, "score").alias("vs"), pick(1, F.max, "score").alias("ks")
    )
    if params is not None:
        wide = wide.join(params.select("qid", "rrf_k", "vector_weight", "keyword_weight"), "qid")
        kk, vw, kw = positive_or(F.col("rrf_k"), DEFAULT_K), positive_or(F.col("vector_weight"), 1.0), positive_or(F.col("keyword_weight"), 1.0)
    else:
        kk, vw, kw = F.lit(k if k > 0 else DEFAULT_K), F.lit(vector_weight if vector_weight > 0 else 1.0), F.lit(keyword_weight if keyword_weight > 0 else 1.0)
    part = lambda w, r: F.coalesce(w / (kk + F.col(r)), F.lit(0.0))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind)
    return wide.select(
        "qid", "id", (part(vw, "vr") + part(kw, "kr")).alias("rrf"),
        zero("vr", "int").alias("vec_rank"), zero("kr", "int").alias("key_rank"), zero("vs", "double").alias("vec_score"), zero("ks", "double").alias("key_score"),
    )


def recall_at_k(truth: DataFrame, found: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """(qid, recall) for every qid of truth: the share of its first k (qid, id, rank) that are among the first k found.

    k <= 0 gives 0. ``asked`` (qid): queries that have a row even if their truth is empty, with recall 1.
    """
    if k <= 0:
        return (truth if asked is None else asked).select("qid").distinct().withColumn("recall", F.lit(0.0))
    t = truth.where(F.col("rank") <= k).select("qid", "id").distinct()
    f = found.where(F.col("rank") <= k).select("qid", "id").distinct().withColumn("hit", F.lit(1))
    out = t.join(f, ["qid", "id"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
    if asked is None:
        return out
    return asked.select("qid").distinct().join(out, "qid", "left").select("qid", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def recall_lists(truth: list, found: list, k: int) -> float:
    """Recall of two lists; an empty truth is met in full."""
    if k <= 0:
        return 0.0
    truth, found = truth[:k], set(found[:k])
    return sum(t in found for t in truth) / len(truth) if truth else 1.0


def plan_channels(query: str | None, has_vector: bool, modality: str | None, cross_modal: bool) -> tuple[list[str], str]:
    """The channels that a request uses and a note where one is closed."""
    out = []
    note = ""
    if has_vector or query:
        if modality == "image" and query and not has_vector and not cross_modal:
            note = "no cross-modal embedder: images are searched by caption and tags"
        else:
            out.append("vector")
            if modality == "image" and query and cross_modal:
                out.append("cross_modal")
    if query:
        out.append("keyword")
    if "vector" in out and "keyword" in out:
        out.append("rrf")
    return out, note


def normalize_requests(requests: DataFrame, collections: DataFrame | None = None, top_k: int = 12, most: int = 200) -> DataFrame:
    """Requests with defaults in place, and ``error``: 40400 for an unknown collection, 40001 without query, else null.

    collection: ``default`` if null or empty; top_k: 12 unless 1..200; metric and index: cosine and hnsw unless
    valid; rrf_k, weights: positive_or 60, 1, 1. An empty modality is null.
    """
    tk = F.col("top_k")
    out = requests.select(
        "qid",
        F.when(F.coalesce("collection", F.lit("")) == "", "default").otherwise(F.col("collection")).alias("collection"),
        F.coalesce("query", F.lit("")).alias("query"),
        F.when((tk > 0) & (tk <= most), tk).otherwise(top_k).alias("top_k"),
        F.when(F.col("metric").isin("cosine", "l2"), F.col("metric")).otherwise("cosine").alias("metric"),
        F.when(F.col("index_type").isin("hnsw", "flat"), F.col("index_type")).otherwise("hnsw").alias("index_type"),
        positive_or(F.col("rrf_k"), DEFAULT_K).alias("rrf_k"),
        positive_or(F.col("vector_weight"), 1.0).alias("vector_weight"),
        positive_or(F.col("keyword_weight"), 1.0).alias("keyword_weight"),
        F.when(F.col("modality") != "", F.col("modality")).alias("modality"),
        F.coalesce("filter", F.lit("")).alias("filter"),
    )
    error = F.when(F.trim("query") == "", 40001)
    if collections is not None:
        known = collections.select(F.col("name").alias("collection")).distinct().withColumn("_known", F.lit(True))
        out = out.join(known, "collection", "left")
        error = F.when(F.col("_known").isNull(), 40400).otherwise(error)
    return out.withColumn("error", error).drop("_known")
