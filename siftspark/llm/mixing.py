"""Mixing sources to target shares of tokens.

1. Sizes: tokens of each document by the public vocabulary; totals by source.
2. Quotas: the largest total for which every source with documents reaches its share (shares of
   sources without documents are spread in proportion) without using a document more than
   ``max_repeats`` times; a larger total asked for leaves such sources at their cap.
3. A source's quota is so many whole passes over its documents and a part of one more, taken in a
   random order. Copies are laid in a random order and cut into blocks of ``block_docs``.
4. A splitting tree deals the blocks: at each node the shards are halved and the left half draws its
   blocks from the node's by a multivariate hypergeometric draw, down to single shards. So the
   blocks of each source are dealt exactly, and each shard is a fair sample of the mixture. A node's draw
   depends on the seed and its shards alone, so every task deals its own range of shards. A shard gets the
   next blocks of each source, whose order is random.
5. Within a shard the documents are shuffled.

Orders within a source are found by (source, hash range): each range is ranked alone and moved by the
totals of the ranges before it, so a source with a third of all rows is no single task. The driver
holds the targets and their sources' totals, and nothing that grows with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import partitions, scratch
from .bpe import VOCABULARY, count_tokens


def quotas(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, dict]:
    """For each target with documents: share (renormalised), quota (tokens), passes, rest (tokens of a part pass)."""
    have = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    norm = sum(t[0] for t in have.values())
    if not have:
        return {}
    most = min(sizes[s] * cap / (share / norm) for s, (share, cap) in have.items())
    want = most if total is None else float(total)
    out = {}
    for s, (share, cap) in have.items():
        quota = int(min(round(want * share / norm), sizes[s] * cap))
        out[s] = {"share": share / norm, "quota": quota, "passes": quota // sizes[s], "rest": quota % sizes[s]}
    return out


def deal(blocks: list[int], shards: int, seed: int, first: int = 0, end: int | None = None) -> np.ndarray:
    """How many of each source's blocks the shards first..end - 1 get: (shards asked for, sources).

    Only the nodes above the shards asked for are visited; whatever part is asked for, a shard gets the same.
    """
    end = shards if end is None else end
    out = np.zeros((max(0, end - first), len(blocks)), np.int64)
    stack = [(0, shards, np.array(blocks, np.int64))]
    while stack:
        lo, hi, left = stack.pop()
        if hi <= first or lo >= end:
            continue
        if hi - lo == 1:
            out[lo - first] = left
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        rest, draw = int(left.sum() * (mid - lo) // (hi - lo)), np.zeros_like(left)
        others = int(left.sum())
        for i, m in enumerate(left.tolist()):  # multivariate hypergeometric, one source after the other
            others -= m
            draw[i] = int(rng.hypergeometric(m, others, rest)) if rest and m else 0
            rest -= int(draw[i])
        stack += [(lo, mid, draw), (mid, hi, left - draw)]
    return out


def dealt_blocks(spark: SparkSession, blocks: dict[str, int], shards: int, seed: int) -> DataFrame:
    """(_src, _block, shard) of every block of every source, dealt by ranges of shards in parallel."""
    sources = sorted(blocks)
    counts = [blocks[s] for s in sources]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            if not len(ids):
                continue
            got = deal(counts, shards, seed, int(ids[0]), int(ids[-1]) + 1)
            shard, source = np.nonzero(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([sources[i] for i in source], pa.string()), pa.array(ids[0] + shard), pa.array(got[shard, source])], names=["_src", "shard", "n"]
            )

    per = spark.range(0, shards, numPartitions=min(shards, partitions(spark))).mapInArrow(run, "_src string, shard long, n long")
    ends = F.sum("n").over(Window.partitionBy("_src").orderBy("shard"))  # one row for each shard
    per = per.withColumn("_end", ends).select("_src", F.col("shard").cast("int").alias("shard"), F.explode(F.sequence(F.col("_end") - F.col("n"), F.col("_end") - 1)).alias("_block"))
    return per.select("_src", "_block", "shard")


def _ordered(df: DataFrame, key: Column, ranges: int, size: Column) -> DataFrame:
    """df with pos (0-based place in its source by key) and before (sizes ahead of it), found range by range."""
    df = df.withColumn("_k", key).withColumn("_r", F.shiftrightunsigned("_k", 64 - int(np.log2(ranges))).cast("int"))
    own = df.groupBy("source", "_r").agg(F.count("*").alias("_n"), F.sum(size).alias("_s"))
    ahead = Window.partitionBy("source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select(
        F.col("source").alias("_src"), F.col("_r").alias("_rr"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s0"),
    )
    order = Window.partitionBy("source", "_r").orderBy("_k", "doc_id", "copy")
    df = df.withColumn("_i", F.row_number().over(order) - 1).withColumn(
        "_b", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    return df.join(own, (F.col("source") == F.col("_src")) & (F.col("_r") == F.col("_rr"))).select(
        "doc_id", "source", "n_tokens", "copy", (F.col("_n0") + F.col("_i")).alias("pos"), (F.col("_s0") + F.col("_b")).alias("before")
    )


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total: int | None = None,
    seed: int = 7,
    block_docs: int = 64,
    shard_docs: int = 8192,
    ranges: int | None = None,
    path: str = VOCABULARY,
) -> DataFrame:
    """doc_id, source, copy (1-based), n_tokens, shard, position of every use of a document in the mixture.

    ``targets``: source, target_share, max_repeats; a source named twice counts with its first row by
    share. Documents without a target (a null source too) are left out; targets without documents are
    reported by mixture_report. ``ranges``: parts that a source is ordered in, by default one for about every
    200,000 rows of all; more orders the same. Documents of no tokens (null, empty) add nothing and are left out.
    Shares are met to within half a document of each source. The same seed gives the same mixture.
    An empty table, or no target that has documents, gives an empty mixture.
    """
    spark = documents.sparkSession
    want = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in
            targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").collect()}
    named = F.broadcast(targets.select(F.col("source").alias("_t")).distinct())  # as large as the table of targets
    docs = documents.select("doc_id", "source", "text").join(named, F.col("source") == F.col("_t"), "left_semi").where("doc_id is not null")
    sized = scratch(count_tokens(docs, keep=("doc_id", "source"), path=path).where("n_tokens > 0"), "sizes")
    got = {r["source"]: (r["s"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("s"), F.count("*").alias("n")).collect()}
    plan = quotas({s: v[0] for s, v in got.items()}, want, total)
    table = spark.createDataFrame(
        [(s, int(p["passes"]), int(p["rest"])) for s, p in plan.items()], "_src string, passes long, rest long"
    )
    parts = lambda n: ranges or 1 << max(4, (n // 200_000).bit_length())
    base = sized.withColumn("copy", F.lit(0)).join(F.broadcast(table), F.col("source") == F.col("_src")).drop("_src")
    one = _ordered(base.drop("passes", "rest"), F.xxhash64(F.lit(seed), "doc_id"), parts(sum(v[1] for v in got.values())), F.col("n_tokens"))
    one = one.join(F.broadcast(table), F.col("source") == F.col("_src"))
    uses = F.col("passes") + ((F.col("before") * 2 + F.col("n_tokens")) < F.col("rest") * 2).cast("long")
    copies = one.withColumn("uses", uses).where("uses > 0").select(
        "doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))).alias("copy")
    )
    copies = scratch(copies, "copies")
    n = {r["source"]: r["n"] for r in copies.groupBy("source").agg(F.count("*").alias("n")).collect()}
    blocks = {s: -(-c // block_docs) for s, c in n.items()}
    shards = max(1, -(-sum(n.values()) // shard_docs))
    where = dealt_blocks(spark, blocks, shards, seed)
    placed = _ordered(copies, F.xxhash64(F.lit(seed + 1), "doc_id", "copy"), parts(sum(n.values())), F.lit(0))
    placed = placed.withColumn("_b", F.expr(f"pos div {block_docs}"))
    out = placed.join(where, (F.col("source") == F.col("_src")) & (F.col("_b") == F.col("_block")))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "copy"), "doc_id", "copy")
    return out.withColumn("position", F.row_number().over(local) - 1).select(
        "doc_id", "source", F.col("copy").cast("int").alias("copy"), "n_tokens", "shard", "position"
    )


def mixture_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, documents, uses, most_uses, tokens, share: what the mixture reached, targets without documents too."""
    each = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("c"), F.sum("n_tokens").alias("t"))
    own = each.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("c").alias("uses"), F.max("c").alias("most_uses"), F.sum("t").alias("tokens")
    )
    total = F.sum("tokens").over(Window.partitionBy())  # over one row for each target
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return wanted.join(own, "source", "left").withColumn("all", total).select(
        "source", "target_share", zero("documents"), zero("uses"), zero("most_uses"), zero("tokens"),
        F.coalesce(F.round(F.col("tokens") / F.col("all"), 6), F.lit(0.0)).alias("share"),
    )
