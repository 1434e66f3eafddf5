"""Frequencies of all n-grams by suffix arrays with common-prefix intervals.

Records are cut into blocks (Arrow batches); no record spans two blocks. Each block's values are
coded as integers and laid end to end with an end mark after every record. Its suffixes are put in
order up to the longest n wanted, by successive rank refinement, with the length of the prefix that each
shares with the one before. The intervals in which these lengths are at least k are the distinct k-grams:

* occurrences of a k-gram = length of its interval,
* records with it = that length minus the interval's within-record adjacencies: pairs of suffixes of one
  record, next to each other among its suffixes in the order, that lie in the interval both.

Blocks hold whole records, so both numbers add up over blocks. A value that occurs in every record
is one row for each block before the shuffle: no task gathers its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.live import live_rows


def suffix_array(codes: np.ndarray, rec: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start positions of the suffixes in the order of their first max_n values, prefix shared with the one before).

    codes: ints >= 0, record after record; rec: the record of each code. A record's end comes before any value;
    equal suffixes lie by position. A shared prefix is counted up to max_n.
    """
    n = len(codes)
    last = np.flatnonzero(np.append(rec[1:] != rec[:-1], True))
    left = np.repeat(last, np.diff(np.append(-1, last))) - np.arange(n) + 1  # values from here to the record's end
    ranks = [codes.astype(np.int64) + 1]
    for k in range(2, max_n + 1):
        nxt = np.zeros(n, np.int64)
        nxt[: n - k + 1] = codes[k - 1 :].astype(np.int64) + 1
        nxt[left < k] = 0
        ranks.append(np.unique(ranks[-1] * (int(codes.max()) + 2) + nxt, return_inverse=True)[1])
    order = np.argsort(ranks[-1], kind="stable")
    shared = np.zeros(n, np.int64)
    alike = np.ones(n - 1, bool)
    for k, r in enumerate(ranks, 1):
        alike &= (r[order[1:]] == r[order[:-1]]) & (left[order[1:]] >= k) & (left[order[:-1]] >= k)
        shared[1:] += alike
    return order, shared


def intervals(codes: np.ndarray, rec: np.ndarray, max_n: int):
    """For k = 1..max_n: (k, start position of one occurrence, occurrences, records) of each distinct k-gram."""
    n = len(codes)
    if not n:
        return
    order, shared = suffix_array(codes, rec, max_n)
    last = np.flatnonzero(np.append(rec[1:] != rec[:-1], True))
    left = (np.repeat(last, np.diff(np.append(-1, last))) - np.arange(n) + 1)[order]
    # Suffixes of one record that follow each other among its suffixes in the order.
    by = np.argsort(rec[order], kind="stable")
    beside = rec[order][by[1:]] == rec[order][by[:-1]]
    a, b = by[:-1][beside], by[1:][beside]
    for k in range(1, max_n + 1):
        whole = left >= k
        if not whole.any():
            return
        interval = np.cumsum(shared < k) - 1  # a suffix shorter than k shares less with both neighbours
        occ = np.bincount(interval, weights=whole).astype(np.int64)
        both = (interval[a] == interval[b]) & whole[a]
        dup = np.bincount(interval[a[both]], minlength=len(occ))
        start = np.flatnonzero(shared < k)
        ok = occ > 0
        yield k, order[start[ok]], occ[ok], (occ - dup)[ok]


def _counter(max_n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            rec = np.asarray(pc.list_parent_indices(lists))
            flat = lists.flatten()
            if flat.null_count:
                ok = np.asarray(flat.is_valid())
                flat, rec = flat.filter(pa.array(ok)), rec[ok]
            coded = flat.dictionary_encode()
            codes = np.asarray(coded.indices)
            for k, at, occ, recs in intervals(codes, rec, max_n):
                words = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(at) + 1, dtype=np.int32) * k),
                    coded.dictionary.take(pa.array(codes[(at[:, None] + np.arange(k)).ravel()])),
                ) if max_n > 1 else coded.dictionary.take(pa.array(codes[at]))
                yield pa.RecordBatch.from_arrays(
                    [words, pa.array(np.full(len(at), k, np.int32)), pa.array(occ.astype(np.int64)), pa.array(recs.astype(np.int64))],
                    names=["value", "n", "occurrences", "records"],
                )

    return count


def frequencies(df: DataFrame, values: Column, max_n: int = 1) -> DataFrame:
    """value, n, occurrences, records of every n-gram of the array column ``values`` for n = 1..max_n.

    With max_n 1 ``value`` is the value itself, else the array of the n values. Rows are records.
    Null arrays and null values count nowhere (n-grams close up over a null value); empty arrays
    have no values; an empty string is a value like any other. No cap on n-grams or records.
    """
    kind = "array<string>" if max_n > 1 else "string"
    parts = df.select(values.cast("array<string>").alias("v")).where("size(v) > 0").mapInArrow(
        _counter(max_n), f"value {kind}, n int, occurrences long, records long"
    )
    return parts.groupBy("value", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def tag_values(tags: Column) -> Column:
    """Tags in their compared form: white space trimmed, lower case; blank ones left out."""
    return F.filter(F.transform(tags, lambda x: F.lower(F.regexp_replace(x, r"^[\s 　]+|[\s 　]+$", ""))), lambda x: x != "")


def value_frequencies(entities: DataFrame, rare: int = 1, common: float = 0.25) -> DataFrame:
    """kind, value, occurrences, records, mark of every term and tag of the live records.

    mark: ``rare`` in at most ``rare`` records, ``common`` in more than the share ``common`` of all
    live records of both modalities (with terms or without), else null; rare goes before common.
    No live record gives an empty table. See frequencies() for nulls and repeats.
    """
    live = live_rows(entities, [F.col("terms.term").alias("terms"), tag_values(F.col("tags")).alias("tags")])
    # The number of records travels with the counts, as the value null.
    both = live.select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("k"), F.col("terms").alias("v")),
                F.struct(F.lit(2).alias("k"), F.col("tags").alias("v")),
            )
        ).alias("x")
    ).select("x.k", "x.v")
    parts = both.mapInArrow(_by_kind, "kind int, value string, occurrences long, records long")
    sums = parts.groupBy("kind", "value").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    total = F.broadcast(sums.where("kind = 0").select(F.col("records").alias("total")))  # one row
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.col("total") * common, "common")
    return sums.where("kind > 0").crossJoin(total).select(
        F.when(F.col("kind") == 1, "term").otherwise("tag").alias("kind"), "value", "occurrences", "records", mark.alias("mark")
    )


def _by_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "value", "occurrences", "records"]
    count = _counter(1)
    for b in batches:
        kinds = np.asarray(b.column(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([int((kinds == 1).sum())], pa.int64())], names=names
        )
        for k in (1, 2):
            own = b.filter(pa.array(kinds == k)).select([1])
            for c in count(iter([own])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(c.num_rows, k, np.int32)), c.column(0), c.column(2), c.column(3)], names=names)


def term_ngrams(entities: DataFrame, max_n: int = 3) -> DataFrame:
    """gram (its terms joined by a space), n, occurrences, records of all n-grams of the terms of live records."""
    live = live_rows(entities, [F.col("terms.term").alias("terms")])
    return frequencies(live, F.col("terms"), max_n).select(F.array_join("value", " ").alias("gram"), "n", "occurrences", "records")
