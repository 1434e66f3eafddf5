"""The keyword index as tables, and BM25 search over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_terms, term_bag
from ..session import scratch
from .knn import first_k, query_blocks
from .live import top_k

K1, B = 1.5, 0.75


def document_terms(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, ts (terms) of every row, also of rows without terms."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(term_bag(text), F.array().cast("array<string>")).alias("ts"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf, dl) from document_terms; a document's terms fold before the shuffle."""
    return docs.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n (documents) and avgdl (1 if there are none)."""
    return docs.agg(F.count("*").alias("n"), F.sum(F.size("ts")).alias("total")).select(
        "n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(1.0).alias("avgdl")
    )


def document_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25_scores(docs: DataFrame, queries: DataFrame, deleted: DataFrame | None = None, stats_include_deleted: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, score) of every document with a term of the query.

    ``docs``: document_terms. ``queries``: qid, query; repeated terms of a query count once.
    ``deleted``: ids that are never found; n and avgdl include them unless stats_include_deleted is
    False, document frequencies never do. Queries and documents without terms have no rows.
    Only postings of asked terms are read on: the terms of the queries are joined before anything is counted,
    so the index is scanned once and its shuffle is as large as its part that was asked for.
    """
    alive = docs if deleted is None else docs.join(deleted.select("id").distinct(), "id", "left_anti")
    stats = corpus_stats(docs if stats_include_deleted else alive)
    asked = queries.select("qid", F.explode(distinct_terms(F.col("query"))).alias("term"))
    wanted = asked.select("term").distinct()
    post = alive.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(wanted, "term", "left_semi")
    post = post.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    rare = post.groupBy("term").agg(F.count("*").alias("df"))
    scored = post.join(rare, "term").crossJoin(F.broadcast(stats))  # one row
    scored = scored.select("term", "id", (idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("s"))
    return asked.join(scored, "term").groupBy("qid", "id").agg(F.sum("s").alias("score"))


QUERY_BLOCK = 32_768  # queries collected and scored at a time
QUERY_TILE, DOC_TILE = 256, 2048  # of the scores that a task holds


def bm25_top_k(
    docs: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6, deleted: DataFrame | None = None, stats_include_deleted: bool = True, k1: float = K1, b: float = B
) -> DataFrame:
    """(qid, id, score, rank): the k best documents of each query by score (to ``digits``), ties by id; k <= 0 means 10.

    The scores are those of bm25_scores(). There, every pair of a query and a document with a common term is a
    row; here a task scores its documents against the queries in tiles and sends the k best of each query on. A column
    ``k`` of the queries goes before the argument. The terms of queries and their document frequencies are joined where
    they lie; the driver collects them in blocks of QUERY_BLOCK queries, each one scan of the documents.
    """
    spark = docs.sparkSession
    k = k if k > 0 else 10
    alive = docs if deleted is None else docs.join(deleted.select("id").distinct(), "id", "left_anti")
    n, avgdl = corpus_stats(docs if stats_include_deleted else alive).first()
    own_k = F.greatest(F.coalesce(F.col("k").cast("int"), F.lit(k)), F.lit(1)) if "k" in queries.columns else F.lit(k)
    asked = queries.where("qid is not null").select("qid", own_k.alias("k"), F.explode(distinct_terms(F.col("query"))).alias("term"))
    df = alive.select(F.explode(F.array_distinct("ts")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    known = asked.join(df, "term").groupBy("qid", "k").agg(F.collect_list(F.struct("term", "df")).alias("ts"))  # the terms of one query
    known = scratch(known, "asked")
    out = None
    for part in query_blocks(known, "qid", QUERY_BLOCK):
        part.sort(key=lambda r: (-r["k"], r["qid"]))
        dfs = {t["term"]: t["df"] for r in part for t in r["ts"]}
        words = sorted(dfs)
        at = {t: i for i, t in enumerate(words)}
        idfs = np.array([float(np.log((n - dfs[t] + 0.5) / (dfs[t] + 0.5) + 1)) for t in words])
        tiles = []
        for lo in range(0, len(part), QUERY_TILE):
            own = part[lo : lo + QUERY_TILE]
            pairs = sorted((at[t["term"]], i) for i, r in enumerate(own) for t in r["ts"])
            fan = np.bincount([p[0] for p in pairs], minlength=len(words))
            tiles.append((np.array([r["qid"] for r in own], np.int64), np.array([r["k"] for r in own], np.int64), fan, np.array([p[1] for p in pairs], np.int64)))
        shared = spark.sparkContext.broadcast((words, idfs, tiles))
        got = alive.select(F.col("id").cast("long").alias("id"), "ts").mapInArrow(_score(shared, digits, avgdl, k1, b), "qid long, id long, score double")
        out = got if out is None else out.unionByName(got)
    top = top_k(out, ["qid"], [F.desc("score"), F.asc("id")], k)
    return top if "k" not in queries.columns else top.join(known.select("qid", F.col("k").alias("_k")), "qid").where(F.col("rank") <= F.col("_k")).drop("_k")


def _score(shared, digits: int, avgdl: float, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, tiles = shared.value
        known = pa.array(words, pa.string())
        # Scores negated: smaller is better.
        best = [(np.full((len(t[0]), 0), np.inf), np.zeros((len(t[0]), 0), np.int64)) for t in tiles]
        for whole in batches:
            for lo in range(0, whole.num_rows, DOC_TILE):
                part = whole.slice(lo, DOC_TILE)
                ids, lists = np.asarray(part.column(0)), part.column(1)
                code = pc.index_in(lists.flatten(), value_set=known)
                doc = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
                dl = np.bincount(doc, minlength=len(ids))
                hit = np.asarray(code.is_valid())
                key, tf = np.unique(doc[hit] * len(words) + np.asarray(code.drop_null()).astype(np.int64), return_counts=True)
                if not len(key):
                    continue
                d, t = key // len(words), key % len(words)
                w = weights[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[d] / avgdl))
                for m, (qids, ks, fan, of) in enumerate(tiles):
                    many = fan[t]
                    if not many.sum():
                        continue
                    begin = np.cumsum(fan) - fan
                    q = of[np.arange(many.sum()) + np.repeat(begin[t] - (np.cumsum(many) - many), many)]
                    score = np.bincount(q * len(ids) + np.repeat(d, many), np.repeat(w, many), len(qids) * len(ids)).reshape(len(qids), len(ids))
                    s, i = np.where(score > 0, -np.round(score, digits), np.inf), np.broadcast_to(ids, score.shape)
                    k = int(ks.max())
                    for _ in range(2):  # of these documents, then of all so far
                        if s.shape[1] > k:
                            top = first_k(s, i, k)
                            s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
                        if _ == 0:
                            s, i = np.concatenate([best[m][0], s], axis=1), np.concatenate([best[m][1], i], axis=1)
                    best[m] = s, i
        for (qids, ks, _, _), (s, i) in zip(tiles, best):
            order = np.lexsort((i, s), axis=1)
            s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            q, j = np.nonzero(np.isfinite(s) & (np.arange(s.shape[1])[None, :] < ks[:, None]))
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(i[q, j]), pa.array(-s[q, j])], names=["qid", "id", "score"])

    return run
