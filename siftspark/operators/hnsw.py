"""A navigable small-world graph in layers, sharded: one graph for each shard, stored as rows, searched in parallel.

Links are built by layers of decreasing size; a search descends greedily and widens to a beam on the
lowest layer. Shards are independent, so building and searching scale with their number; the global
top-k merges the shards' own. The rows survive lost executors and are reloaded, not rebuilt.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from .knn import BLOCK_BYTES, query_blocks
from .live import top_k

GRAPH = "shard int, id long, level int, links array<array<long>>, vector array<float>, deleted boolean, entry boolean"


@dataclass(frozen=True)
class HnswParams:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    seed: int = 42

    def __post_init__(self):
        for name, least, default in (("m", 4, 16), ("ef_construction", 16, 200), ("ef_search", 8, 64)):
            if getattr(self, name) < least:
                object.__setattr__(self, name, default)


class Graph:
    """One shard's graph. Distance is 1 - dot of unit vectors."""

    def __init__(self, dim: int, params: HnswParams = HnswParams(), shard: int = 0):
        self.p, self.rng = params, np.random.default_rng(params.seed + shard)
        self.ids: list[int] = []
        self.at: dict[int, int] = {}
        self.vec = np.zeros((16, dim), np.float32)
        self.links: list[list[list[int]]] = []
        self.dead: list[bool] = []
        self.entry = -1

    def __len__(self) -> int:
        return len(self.ids) - sum(self.dead)

    def _far(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return 1 - self.vec[nodes] @ q

    def _beam(self, q: np.ndarray, start: list[int], width: int, layer: int, live: bool = False) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes reached from start on a layer, nearest first; with ``live`` deleted nodes lead on but don't count."""
        seen = set(start)
        todo = [(float(d), n) for d, n in zip(self._far(q, start), start)]
        heapq.heapify(todo)
        kept = [(-d, -n) for d, n in todo if not (live and self.dead[n])]
        heapq.heapify(kept)
        while todo:
            d, n = heapq.heappop(todo)
            if len(kept) >= width and d > -kept[0][0]:
                break
            new = [x for x in self.links[n][layer] if x not in seen] if layer < len(self.links[n]) else []
            if not new:
                continue
            seen.update(new)
            for e, x in zip(self._far(q, new).tolist(), new):
                if len(kept) < width or e < -kept[0][0]:
                    heapq.heappush(todo, (e, x))
                    if not (live and self.dead[x]):
                        heapq.heappush(kept, (-e, -x))
                        if len(kept) > width:
                            heapq.heappop(kept)
        return sorted((-d, -n) for d, n in kept)

    def _pick(self, near: list[tuple[float, int]], m: int) -> list[int]:
        """Diverse neighbours: one nearer to a picked node than to the centre waits, and fills up at the end."""
        picked: list[int] = []
        spare: list[int] = []
        for d, n in near:
            if len(picked) == m:
                break
            if picked and (self._far(self.vec[n], picked) < d).any():
                spare.append(n)
            else:
                picked.append(n)
        return picked + spare[: m - len(picked)]

    def add(self, key: int, v: np.ndarray) -> None:
        v = np.asarray(v, np.float32)
        if key in self.at:  # a new vector for a known id: unlinked and linked anew
            self.delete(key)
            del self.at[key]
        n = len(self.ids)
        if n == len(self.vec):
            self.vec = np.concatenate([self.vec, np.zeros_like(self.vec)])
        self.vec[n] = v
        level = int(-math.log(max(self.rng.random(), 1e-12)) / math.log(self.p.m))
        self.ids.append(key)
        self.at[key] = n
        self.dead.append(False)
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = n
            return
        top = len(self.links[self.entry]) - 1
        start = [self.entry]
        for layer in range(top, level, -1):
            start = [self._beam(v, start, 1, layer)[0][1]]
        for layer in range(min(level, top), -1, -1):
            near = self._beam(v, start, self.p.ef_construction, layer)
            most = self.p.m if layer else 2 * self.p.m
            self.links[n][layer] = self._pick(near, most)
            for x in self.links[n][layer]:
                own = self.links[x][layer]
                own.append(n)
                if len(own) > most:
                    d = self._far(self.vec[x], own)
                    self.links[x][layer] = self._pick(sorted(zip(d.tolist(), own)), most)
            start = [x for _, x in near]
        if level > top:
            self.entry = n

    def delete(self, key: int) -> None:
        if key in self.at:
            self.dead[self.at[key]] = True

    def search(self, q: np.ndarray, k: int = 10, ef: int = 0) -> list[tuple[int, float]]:
        """(id, distance) of the k nearest live nodes; k <= 0 means 10."""
        k = k if k > 0 else 10
        if self.entry < 0:
            return []
        start = [self.entry]
        for layer in range(len(self.links[self.entry]) - 1, 0, -1):
            start = [self._beam(q, start, 1, layer)[0][1]]
        return [(self.ids[n], d) for d, n in self._beam(q, start, max(k, ef, self.p.ef_search), 0, live=True)][:k]

    def rows(self, shard: int) -> pd.DataFrame:
        link = lambda node: [[self.ids[x] for x in layer] for layer in node]
        return pd.DataFrame(
            {
                "shard": shard, "id": self.ids, "level": [len(x) - 1 for x in self.links], "links": [link(x) for x in self.links],
                "vector": list(self.vec[: len(self.ids)]), "deleted": self.dead, "entry": [n == self.entry for n in range(len(self.ids))],
            }
        )

    @classmethod
    def load(cls, rows: pd.DataFrame, params: HnswParams) -> Graph:
        g = cls(len(rows["vector"].iloc[0]), params)
        g.ids = rows["id"].tolist()
        g.at = {x: n for n, x in enumerate(g.ids)}
        g.vec = np.stack(rows["vector"].tolist()).astype(np.float32)
        g.links = [[[g.at[int(x)] for x in layer] for layer in node] for node in rows["links"]]
        g.dead = rows["deleted"].tolist()
        g.entry = int(np.flatnonzero(rows["entry"].values)[0])
        return g


def build(entities: DataFrame, dim: int, shards: int, params: HnswParams = HnswParams()) -> DataFrame:
    """The graph's rows of entities (id, vector); a shard holds what its hash gives it. Unusable vectors are left out."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        g = Graph(dim, params, int(key[0]))
        for i, v in zip(rows["id"], rows["vector"]):
            g.add(int(i), v)
        return g.rows(int(key[0]))

    data = entities.where(V.valid(F.col("vector"), dim)).select(
        F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")
    )
    return data.groupBy("shard").applyInPandas(lambda key, rows: one(key, rows.sort_values("id")), GRAPH)


def _in_shard(shared, k: int, params: HnswParams):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g = Graph.load(rows, params)
        return pd.DataFrame([(qid, i, d) for qid, q, e in shared.value for i, d in g.search(q, k, e)], columns=["qid", "id", "dist"])

    return run


def search(graph: DataFrame, queries: DataFrame, k: int = 10, ef: int = 0, params: HnswParams = HnswParams(), digits: int = 6) -> DataFrame:
    """(qid, id, dist, rank) of queries (qid, vector): each shard's k nearest, then the k nearest of all.

    ef can only widen the beam; a column ``ef`` of the queries goes before the argument. Queries are collected and
    broadcast in blocks of BLOCK_BYTES; a shard's graph is loaded once for each block.
    """
    k = k if k > 0 else 10
    spark = graph.sparkSession
    wide = F.coalesce(F.col("ef").cast("int"), F.lit(ef)) if "ef" in queries.columns else F.lit(ef)
    asked = queries.where("qid is not null and vector is not null").select("qid", F.col("vector").cast("array<float>").alias("vector"), wide.alias("ef"))
    one = asked.select(F.size("vector")).first()
    found = None
    for part in query_blocks(asked, "qid", max(1, BLOCK_BYTES // (4 * (one[0] if one else 1) + 24 * k))):
        shared = spark.sparkContext.broadcast([(r["qid"], np.array(r["vector"], np.float32), r["ef"]) for r in part])
        got = graph.groupBy("shard").applyInPandas(_in_shard(shared, k, params), "qid long, id long, dist double")
        found = got if found is None else found.unionByName(got)
    return top_k(found.withColumn("dist", F.round("dist", digits)), ["qid"], [F.asc("dist"), F.asc("id")], k)


def delete(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """The graph with tombstones: they are passed through and never found."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return graph.join(gone, "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone").select("shard", "id", "level", "links", "vector", "deleted", "entry")
