"""The write path as tables: sizes, sealing of segments, their list, compaction, collections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BAD_REQUEST, CONFLICT, NOT_FOUND, EngineError
from .live import current_rows
from .ordered import before, in_ranges, running


def row_bytes(vector: Column, content: Column, caption: Column, content_hash: Column, patches: Column | None = None) -> Column:
    """Estimated bytes of a row: 4 a dimension, the texts' bytes, 4 a dimension of each patch, and 128."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in (content, caption, content_hash)]
    out = size(vector) * 4 + texts[0] + texts[1] + texts[2] + 128
    if patches is not None:
        out = out + F.coalesce(F.aggregate(patches, F.lit(0), lambda a, p: a + 4 * F.size(p["vector"])), F.lit(0))
    return out


def seal_by_rows(log: DataFrame, stream: str, order: str, rows: int = 1000) -> DataFrame:
    """Log with ``segment``: every ``rows`` rows of a stream fill one, counted from 0. A long stream is counted range by range."""
    ranged = in_ranges(log, [stream], [order])
    out = running(ranged, [stream], [order], F.lit(1).cast("long"), "_n")
    return out.withColumn("segment", F.floor(F.col("_n") / rows).cast("int")).select(*log.columns, "segment")


def seal_by_idle(log: DataFrame, stream: str, ts: str, order: str, idle_ms: int = 30_000) -> DataFrame:
    """Log with ``segment``: a row that comes ``idle_ms`` or more after the one before begins a new one."""
    ranged = before(in_ranges(log, [stream], [ts, order]), [stream], [ts, order], ts, "_was")
    gap = F.coalesce((F.col(ts) - F.col("_was") >= idle_ms).cast("long"), F.lit(0).cast("long"))
    out = running(ranged.withColumn("_gap", gap), [stream], [ts, order], F.col("_gap"), "_n")
    return out.withColumn("segment", (F.col("_n") + F.col("_gap")).cast("int")).select(*log.columns, "segment")


def seal(log: DataFrame, stream: str, ts: str, order: str, size: str, max_bytes: int = 4 << 20, max_rows: int = 1000, idle_ms: int = 30_000) -> DataFrame:
    """(stream, order, segment, reason) with all three triggers; reason is that which seals the row's segment after it, else null.

    A segment is sealed after the row with which it holds max_bytes (asked first) or max_rows, and before a row that
    comes idle_ms after the last. Each trigger resets the others, so a stream is one sequential fold: rows pass
    through in order, one at a time, and only the open segment's totals are held.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seg, n, b, last = None, 0, 0, 0, 0
        for f in frames:
            segs, why = [], []
            for s, t, z in zip(f["s"], f["t"], f["z"]):
                if s != now:
                    now, seg, n, b = s, 0, 0, 0
                elif n and t - last >= idle_ms:
                    seg, n, b = seg + 1, 0, 0
                n, b, last = n + 1, b + int(z), t
                segs.append(seg)
                full = "max_bytes" if b >= max_bytes else "max_rows" if n >= max_rows else None
                why.append(full)
                if full:
                    seg, n, b = seg + 1, 0, 0
            yield pd.DataFrame({"s": f["s"], "o": f["o"], "segment": segs, "reason": why})

    rows = log.select(F.col(stream).cast("string").alias("s"), F.col(ts).cast("long").alias("t"), F.col(order).cast("long").alias("o"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("z"))
    rows = rows.where("s is not null and t is not null").repartition("s").sortWithinPartitions("s", "t", "o")
    return rows.mapInPandas(fold, "s string, o long, segment int, reason string").select(F.col("s").alias(stream), F.col("o").alias(order), "segment", "reason")


def segment_stats(sealed: DataFrame, stream: str, ts: str, size: str) -> DataFrame:
    """stream, segment, rows, bytes, min_ts, max_ts of each segment."""
    return sealed.groupBy(stream, "segment").agg(
        F.count("*").alias("rows"), F.sum(size).alias("bytes"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts")
    )


def compact(segments: DataFrame, cols: list[str], **kw) -> DataFrame:
    """The live rows of all segments, each id once in its latest state; versions fold before the shuffle."""
    return current_rows(segments, cols, **kw).where("not deleted").drop("deleted")


def compaction_summary(segments: DataFrame, live: DataFrame, size: Column) -> DataFrame:
    """One row: rows before and after, bytes after."""
    return segments.agg(F.count("*").alias("rows_before")).crossJoin(live.agg(F.count("*").alias("rows_after"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_after")))


def create_collection(collections: DataFrame, name: str, dim: int = 0, metric: str = "cosine", index_type: str = "hnsw", default_dim: int = 1024, at=None) -> DataFrame:
    """The table with the new collection. dim 0 means the default; another metric or index type means cosine, hnsw."""
    if not name:
        raise EngineError(BAD_REQUEST, "name required")
    if dim not in (0, default_dim):
        raise EngineError(BAD_REQUEST, f"dim must be {default_dim}")
    if not collections.where(F.col("name") == name).isEmpty():
        raise EngineError(CONFLICT, "collection exists")
    now = F.date_trunc("second", F.lit(at).cast("timestamp") if at else F.current_timestamp())
    row = collections.sparkSession.range(1).select(
        F.lit(name).alias("name"), F.lit(default_dim).alias("dim"), F.lit(metric if metric in ("cosine", "l2") else "cosine").alias("metric"),
        F.lit(index_type if index_type in ("hnsw", "flat") else "hnsw").alias("index_type"), now.cast(collections.schema["created_at"].dataType).alias("created_at"),
    )
    return collections.select("name", "dim", "metric", "index_type", "created_at").unionByName(row)


def drop_collection(collections: DataFrame, entities: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(collections without it, entities with its members deleted)."""
    if collections.where(F.col("name") == name).isEmpty():
        raise EngineError(NOT_FOUND, "collection not found")
    return collections.where(F.col("name") != name), entities.withColumn("deleted", F.coalesce("deleted", F.lit(False)) | (F.coalesce("collection", F.lit("")) == name))
