"""Exact k-nearest neighbours of a set of query vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from .live import top_k

BLOCK_BYTES = 64 * 1024 * 1024  # of queries, and of what a task keeps for them, at a time
TILE_ROWS, TILE_QUERIES = 2048, 256  # of the distances that a task holds; queries of a tile keep as many as the one that wants most


def flat_native(queries: DataFrame, entities: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(qid, id, dist, rank) from built-in expressions alone: queries (qid, vector) against entities (id, vector).

    The plan that the block version is checked against: a nested loop with a partial top-k in each task.
    """
    q = queries.select("qid", F.col("vector").alias("qv"))
    d = V.distance(F.col("qv"), F.col("vector"), metric)
    pairs = entities.select("id", "vector").crossJoin(q).select("qid", "id", (F.round(d, 6) + F.lit(0.0)).alias("dist"))
    return top_k(pairs, ["qid"], [F.asc("dist"), F.asc("id")], k if k > 0 else 10)


def query_blocks(queries: DataFrame, id_col: str, most: int) -> Iterator[list]:
    """The rows of a table of stated queries, in blocks of about ``most`` that are collected one after the other."""
    n = queries.count()
    blocks = max(1, -(-n // most))
    part = F.pmod(F.xxhash64(id_col), F.lit(blocks))
    for b in range(blocks):
        yield queries.where(part == b).collect()


def _scan(shared, digits: int):
    """Queries lie by their k, so a tile of them keeps about as many neighbours as each wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, l2, ks = shared.value
        tiles = [slice(a, min(len(qids), a + TILE_QUERIES)) for a in range(0, len(qids), TILE_QUERIES)]
        best = [(np.full((t.stop - t.start, 0), np.inf), np.zeros((t.stop - t.start, 0), np.int64)) for t in tiles]
        for whole in batches:
            for lo in range(0, whole.num_rows, TILE_ROWS):
                b = whole.slice(lo, TILE_ROWS)
                ids = np.asarray(b.column(0))
                if not len(ids):
                    continue
                v = np.asarray(b.column(1).flatten()).astype(np.float64).reshape(len(ids), -1)
                for n, t in enumerate(tiles):
                    d = q[t] @ v.T
                    far = np.flatnonzero(l2[t])
                    if len(far):
                        d[far] = _euclid(q[t][far], v, d[far])
                    d[~l2[t]] = 1 - d[~l2[t]]
                    d = np.round(d, digits) + 0.0  # no negative zeros
                    k = int(ks[t].max())
                    own = np.broadcast_to(ids, d.shape)
                    if d.shape[1] > k:
                        top = first_k(d, own, k)
                        d, own = np.take_along_axis(d, top, 1), np.take_along_axis(own, top, 1)
                    d, own = np.concatenate([best[n][0], d], axis=1), np.concatenate([best[n][1], own], axis=1)
                    if d.shape[1] > k:
                        top = first_k(d, own, k)
                        d, own = np.take_along_axis(d, top, 1), np.take_along_axis(own, top, 1)
                    best[n] = d, own
        for t, (d, own) in zip(tiles, best):
            m = d.shape[1]
            if not m:
                continue
            order = np.lexsort((own, d), axis=1)
            d, own = np.take_along_axis(d, order, 1), np.take_along_axis(own, order, 1)
            keep = np.arange(m)[None, :] < ks[t][:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[t], m)[keep.ravel()]), pa.array(own[keep]), pa.array(d[keep])], names=["qid", "id", "dist"])

    return run


def _euclid(q: np.ndarray, v: np.ndarray, dot: np.ndarray) -> np.ndarray:
    """Euclid's distances by the expanded square, and by differences where that would lose digits: of near ones."""
    size = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :]
    square = size - 2 * dot
    i, j = np.nonzero(square < 1e-6 * size)
    for lo in range(0, len(i), 100_000):
        a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
        square[a, b] = ((q[a] - v[b]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


def first_k(d: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest of each row by (d, i)."""
    top = np.argpartition(d, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(d, top, 1).max(axis=1)
    # Where more than k share the edge's value, the smaller i decide.
    tied = np.flatnonzero(((d <= edge[:, None]).sum(axis=1) > k) & np.isfinite(edge))
    for r in tied:
        c = np.flatnonzero(d[r] <= edge[r])
        top[r] = c[np.lexsort((i[r, c], d[r, c]))[:k]]
    return top


def flat_top_k(queries: DataFrame, entities: DataFrame, k: int = 10, metric: str = "cosine", dim: int | None = None, digits: int = 6) -> DataFrame:
    """(qid, id, dist, rank): for each query (qid, vector[, metric]) its k nearest entities (id, vector), ties by id; k <= 0 means 10.

    cosine: 1 - dot, so vectors should be of unit length; l2: Euclid. Columns ``metric`` and ``k`` of the queries go before the
    arguments. Sums are of doubles. Vectors of another length than ``dim`` (default: that of the queries), null or not finite are left out.
    Each task keeps the k nearest of each query and sends no more. Queries are collected and broadcast in blocks: of each,
    the vectors and the neighbours kept have about BLOCK_BYTES. A task holds TILE_ROWS x TILE_QUERIES distances.
    """
    spark = entities.sparkSession
    k = k if k > 0 else 10
    m = F.col("metric") if "metric" in queries.columns else F.lit(metric)
    own_k = F.greatest(F.coalesce(F.col("k").cast("int"), F.lit(k)), F.lit(1)) if "k" in queries.columns else F.lit(k)
    asked = queries.where("qid is not null and vector is not null").select("qid", "vector", (m == "l2").alias("l2"), own_k.alias("k"))
    if dim is None:
        one = asked.select(F.size("vector")).first()
        dim = one[0] if one else 1
    asked = asked.where(V.valid(F.col("vector"), dim))
    data = entities.where(V.valid(F.col("vector"), dim)).select(F.col("id").cast("long").alias("id"), "vector")
    out = None
    for part in query_blocks(asked, "qid", max(1, BLOCK_BYTES // (8 * dim + 16 * k))):
        part.sort(key=lambda r: (-r["k"], r["qid"]))
        shared = spark.sparkContext.broadcast(
            (
                np.array([r["qid"] for r in part], np.int64), np.array([r["vector"] for r in part], np.float64).reshape(len(part), dim),
                np.array([bool(r["l2"]) for r in part], bool), np.array([r["k"] for r in part], np.int64),
            )
        )
        got = data.mapInArrow(_scan(shared, digits), "qid long, id long, dist double")
        out = got if out is None else out.unionByName(got)
    most = asked.select("qid", F.col("k").alias("_k")) if "k" in queries.columns else None
    top = top_k(out, ["qid"], [F.asc("dist"), F.asc("id")], k)
    return top if most is None else top.join(most, "qid").where(F.col("rank") <= F.col("_k")).drop("_k")


def flat_serial(queries: DataFrame, entities: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """flat_top_k in one task: the baseline of the speed-up measurement."""
    return flat_top_k(queries, entities.coalesce(1), k, metric)
