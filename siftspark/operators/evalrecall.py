"""Recall, latency and speed-up of the graph index against the exact scan, on generated vectors."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fusion, hnsw, knn

# Seed and shape of the evaluation's vectors.
SEED, CENTRES, RANDOM_EVERY, CENTRE_PART, NOISE_PART = 20260823, 12, 5, 0.85, 0.15
RECALL_LEAST, P99_MOST_MS = 0.95, 50.0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def generate(spark: SparkSession, n: int, dim: int) -> DataFrame:
    """(id, vector): every fifth vector random, the others near one of twelve centres; the same for any partitioning."""
    centres = _unit(np.random.default_rng(SEED).standard_normal((CENTRES, dim)))

    def run(frames):
        for f in frames:
            out = []
            for i in f["id"]:
                r = _unit(np.random.default_rng([SEED, int(i)]).standard_normal(dim))
                k = int(i) - 1
                out.append((r if k % RANDOM_EVERY == 0 else _unit(CENTRE_PART * centres[k % CENTRES] + NOISE_PART * r)).astype(np.float32))
            yield pd.DataFrame({"id": f["id"], "vector": out})

    return spark.range(1, n + 1).mapInPandas(run, "id long, vector array<float>")


def evaluate(spark: SparkSession, n: int = 2000, queries: int = 40, k: int = 10, dim: int = 1024, shards: int = 8, params: hnsw.HnswParams = hnsw.HnswParams()) -> dict:
    """recall_at_k of the sharded graph, build rate, latencies of single searches in a shard, speed-up of the scan, pass flags."""
    n, queries, k = min(n if n > 0 else 2000, 10_000), queries if queries > 0 else 40, k if k > 0 else 10
    vecs = generate(spark, n, dim).persist()
    vecs.count()
    t = time.perf_counter()
    graph = hnsw.build(vecs, dim, shards, params).persist()
    graph.count()
    built = n / (time.perf_counter() - t)
    picks = np.random.default_rng(SEED).integers(1, n + 1, queries)
    q = spark.createDataFrame([(i, int(p)) for i, p in enumerate(picks)], "qid long, id long").join(vecs, "id").select("qid", "vector")
    found = hnsw.search(graph, q, k, params=params)
    truth = knn.flat_top_k(q, vecs, k)
    recall = fusion.recall_at_k(truth, found, k).agg(F.avg("recall")).first()[0]
    first = hnsw.Graph.load(graph.where("shard = 0").toPandas(), params)  # one shard of n / shards vectors
    took = []
    for r in q.collect():
        t = time.perf_counter()
        first.search(np.array(r["vector"], np.float32), k)
        took.append((time.perf_counter() - t) * 1000)
    took.sort()
    one = q.limit(1)
    times = {}
    for name, scan in (("serial", knn.flat_serial), ("parallel", knn.flat_top_k)):
        runs = []
        for _ in range(4):
            t = time.perf_counter()
            scan(one, vecs, 20).count()
            runs.append(time.perf_counter() - t)
        times[name] = sorted(runs)[2]
    p50, p99 = (took[int((len(took) - 1) * p)] for p in (0.5, 0.99))
    for df in (vecs, graph):
        df.unpersist()
    return {
        "n": n, "dim": dim, "queries": queries, "k": k, "recall_at_k": recall, "p50_ms": p50, "p99_ms": p99, "flat_speedup": times["serial"] / times["parallel"],
        "insert_vec_per_s": built, "pass_recall": recall >= RECALL_LEAST, "pass_latency": p99 < P99_MOST_MS,
    }
