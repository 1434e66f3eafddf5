"""How distinctive a term is for its record: divergence from randomness.

Model GL2: the information content of the term frequency under a geometric model of the collection,
times the Laplace after-effect gain, with the frequency normalised by the record's length:

    tfn   = tf * log2(1 + c * avgdl / dl)
    inf   = log2(1 + lam) + tfn * log2((1 + lam) / lam)        lam = F / N
    gain  = 1 / (tfn + 1)
    score = gain * inf

F: occurrences of the term in the collection, N: records, dl: terms of the record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.live import live_rows, top_k
from ..session import scratch
from .ngrams import frequencies


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        rec = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
        flat = lists.flatten()
        if flat.null_count:
            ok = np.asarray(flat.is_valid())
            flat, rec = flat.filter(pa.array(ok)), rec[ok]
        if not len(rec):
            continue
        coded = flat.dictionary_encode()
        key, tf = np.unique(rec << 32 | np.asarray(coded.indices).astype(np.int64), return_counts=True)
        row, code = key >> 32, key & 0xFFFFFFFF
        dl = np.bincount(rec, minlength=b.num_rows)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(row)), coded.dictionary.take(pa.array(code)), pa.array(tf.astype(np.int32)), pa.array(dl[row].astype(np.int32))],
            names=["id", "term", "tf", "dl"],
        )


def gl2(tf, dl, cf, n, avgdl, c: float = 1.0):
    """The score as a Column."""
    lam = cf / n
    tfn = tf * F.log2(1 + c * avgdl / dl)
    return (F.log2(1 + lam) + tfn * F.log2((1 + lam) / lam)) / (tfn + 1)


def distinctive_terms(entities: DataFrame, c: float = 1.0, broadcast_bytes: int = 16_000_000) -> DataFrame:
    """id, term, tf, dl, df, cf, score of every distinct term of every live text record.

    Statistics cover all live text records, whatever their length. The table of terms is broadcast
    only if its terms and counts have at most ``broadcast_bytes`` (measured), else joined by shuffle, where a
    hot term is split by AQE. Nulls: null terms count nowhere; records without terms have no rows but count as
    records. Ties have equal scores. An empty table gives an empty table.
    """
    text = entities.withColumn("_terms", F.col("terms.term"))
    live = live_rows(text, [F.col("modality"), F.col("_terms").alias("terms")]).where("modality = 'text'").select("id", "terms")
    live = scratch(live, "terms")
    stats = scratch(
        frequencies(live, F.col("terms")).select("value", F.col("occurrences").alias("cf"), F.col("records").alias("df")), "stats"
    )
    n = max(1, live.count())
    total, size = stats.agg(F.sum("cf"), F.sum(F.octet_length("value") + 32)).first()
    avgdl = (total or 0) / n
    stats = stats.withColumnRenamed("value", "term")
    if (size or 0) <= broadcast_bytes:
        stats = F.broadcast(stats)
    posts = live.mapInArrow(_postings, "id long, term string, tf int, dl int")
    return posts.join(stats, "term").select(
        "id", "term", "tf", "dl", "df", "cf",
        gl2(F.col("tf"), F.col("dl"), F.col("cf"), F.lit(float(n)), F.lit(float(avgdl)), c).alias("score"),
    )


def top_terms(entities: DataFrame, k: int = 10, **kw) -> DataFrame:
    """The k most distinctive terms of each record, ties by term (a report)."""
    return top_k(distinctive_terms(entities, **kw), ["id"], [F.desc("score"), F.asc("term")], k)
