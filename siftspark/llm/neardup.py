"""Near-duplicate texts: a blocked sparse product of the document by n-gram incidence.

A text is the set of its runs of ``run`` letters and digits in lower case; two texts are near-duplicates
if their sets have a Jaccard quotient of at least t. With sizes a <= b that takes an overlap of at least
t / (1 + t) * (a + b), and b <= a / t. Bounds follow from the sizes; none drops a pair that meets t:

* the n-grams of every text in one global order (rare ones first): the smaller text's first
  a - ceil(2t / (1 + t) a) + 1 and the larger one's first b - ceil(t b) + 1 have one in common,
* texts whose sizes differ by more than the factor t are no pair,
* a common n-gram at places i and j of the two leaves room for at most min(a - i, b - j) in common after
  it, if it is their first,
* each text carries a bit map of its n-grams, hashed to ``BITS`` places. A bit that only one of two texts
  has is at least one n-gram that only it has, so the overlap is at most the size less such bits.

The columns of the incidence matrix are dealt to blocks by n-gram; each block multiplies its columns,
entry by entry of the bounded prefixes, and keeps the products that pass all bounds. A column with more
than ``HOT`` entries is cut by texts into parts, and every two parts meet in a cell of their own. What is
left is counted on the whole texts.

The order comes from counts of all n-grams of all texts in a table of 2^20 to 2^24 counters, as the texts
need. Texts equal after reduction form one class, whose smallest id stands for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.live import live_rows
from ..session import partitions, scratch
from .arrow import slices

TILE = 1 << 16
BITS = 512  # of a text's bit map; with more, longer texts part sooner
GRAMS = 4_000_000  # n-grams of all texts for which there is a block, so a task holds as many whatever the data
HOT = 20_000  # entries of a column, or of a part of one


def _hashes(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of every text, number of runs of each text)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.maximum(size - run + 1, 0)
    if not n.sum():
        return np.zeros(0, np.uint64), n
    h = np.zeros(len(cp) - run + 1, np.uint64)
    for k in range(run):
        h += cp[k : len(h) + k]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    at = np.cumsum(size) - size
    return h[np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)], n


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return ((h >> np.uint64(20)) & np.uint64(slots - 1)).astype(np.int64)


def _texts(b: pa.RecordBatch, name: str):
    at = b.schema.get_field_index(name)
    for part in slices(b, at, 1000):
        yield part, part.column(at).to_pylist()


def _tiles(sums: dict[int, np.ndarray], dtype) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.astype(dtype).tobytes() for c in sums.values()], pa.binary())], names=["tile", "counts"])


def _count(run: int, slots: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for b in batches:
            for _, texts in _texts(b, "norm"):
                at, n = np.unique(_slot(_hashes(texts, run)[0], slots), return_counts=True)
                total[at] += n.astype(np.uint32)
        sums = {i: t for i, t in enumerate(total.reshape(-1, TILE)) if t.any()}
        if sums:
            yield _tiles(sums, np.uint32)

    return count


def _add_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile: for each slot a byte that grows with its count, and one for the parts that its columns are cut into."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[i] = sums.get(i, 0) + np.frombuffer(c, np.uint32).astype(np.int64)
    if sums:
        order = {i: np.minimum(255, np.floor(8 * np.log2(np.maximum(c, 1) + 0.0))).astype(np.uint8) for i, c in sums.items()}
        parts = {i: np.clip(-(-c // HOT), 1, 90).astype(np.uint8) for i, c in sums.items()}
        yield _tiles({i: np.concatenate([order[i], parts[i]]) for i in sums}, np.uint8)


def ngram_order(reps: DataFrame, run: int) -> tuple[np.ndarray, int]:
    """((2, slots), n-grams of all texts): for each slot, a byte that grows with the number of n-grams in it (the global order, rare first), and its parts."""
    total = reps.agg(F.sum(F.greatest(F.length("norm") - run + 1, F.lit(0)))).first()[0] or 0
    slots = 1 << min(24, max(20, int(total).bit_length()))
    tiles = reps.select("norm").mapInArrow(_count(run, slots), "tile int, counts binary")
    few = tiles.repartition(min(slots // TILE, partitions(reps.sparkSession)), "tile").mapInArrow(_add_tiles, "tile int, counts binary")
    out = np.zeros((slots // TILE, 2, TILE), np.uint8)
    out[:, 1] = 1
    for r in few.collect():  # two bytes for each slot
        out[r["tile"]] = np.frombuffer(r["counts"], np.uint8).reshape(2, TILE)
    return np.ascontiguousarray(out.transpose(1, 0, 2).reshape(2, slots)), int(total)


# An entry of a block: n-gram, cell and the text that has it, its part and place; packed, so a shuffled row holds many.
_DOC = np.dtype([("rep", "<i8"), ("size", "<i4"), ("bits", "<u8", BITS // 64)])
_ENTRY = np.dtype([("tok", "<u8"), ("doc", "<u2"), ("rank", "<u2"), ("cell", "<u2"), ("part", "u1")])


def _entries(order, run: int, t: float, blocks: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, parts_of = order.value
        slots = len(rank_of)
        for b in batches:
            for part, texts in _texts(b, "norm"):
                h, n = _hashes(texts, run)
                if not len(h):
                    continue
                doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
                q = rank_of[_slot(h, slots)].astype(np.uint64)
                # Text, order, hash in one number: sorting puts each text's n-grams in the global order.
                key = (doc << np.uint64(52)) | (q << np.uint64(44)) | (h >> np.uint64(20))
                key.sort()
                key = key[np.append(True, key[1:] != key[:-1])]
                doc = (key >> np.uint64(52)).astype(np.int64)
                tok = key & np.uint64((1 << 52) - 1)
                size = np.bincount(doc, minlength=len(texts))
                rank = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
                docs = np.zeros(len(texts), _DOC)
                docs["rep"], docs["size"], docs["bits"] = part.column(0), size, _bit_map(doc, tok, len(texts))
                keep = (rank < size[doc] - np.ceil(t * size[doc] - 1e-9) + 1) & (q_of(tok) > 0)
                doc, tok, rank = doc[keep], tok[keep], rank[keep]
                # A hot column's text meets those of every part in the cell of both parts.
                cut = parts_of[(tok & np.uint64(slots - 1)).astype(np.int64)].astype(np.int64)
                mine = (_mixed(docs["rep"][doc].astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % cut
                again = np.repeat(np.arange(len(doc)), cut)
                other = np.arange(len(again)) - np.repeat(np.cumsum(cut) - cut, cut)
                doc, tok, rank, mine = doc[again], tok[again], rank[again], mine[again]
                cell = np.maximum(mine, other) * (np.maximum(mine, other) + 1) // 2 + np.minimum(mine, other)
                block = (_mixed(tok + (cell.astype(np.uint64) << np.uint64(52))) >> np.uint64(40)).astype(np.int64) % blocks
                by = np.argsort(block, kind="stable")
                cuts = np.searchsorted(block[by], np.arange(blocks + 1))
                ids, out = [], []
                for k in range(blocks):
                    own = by[cuts[k] : cuts[k + 1]]
                    if not len(own):
                        continue
                    used, local = np.unique(doc[own], return_inverse=True)
                    e = np.zeros(len(own), _ENTRY)
                    e["tok"], e["doc"], e["rank"], e["cell"], e["part"] = tok[own], local, np.minimum(rank[own], 65535), cell[own], mine[own]
                    ids.append(k)
                    out.append(np.int32(len(used)).tobytes() + docs[used].tobytes() + e.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(out, pa.binary())], names=["block", "packed"])

    return emit


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


def q_of(tok: np.ndarray) -> np.ndarray:
    """The order byte of a token; 0: the n-gram occurs once in the collection, so in no pair."""
    return tok >> np.uint64(44)


def _bit_map(doc: np.ndarray, tok: np.ndarray, n: int) -> np.ndarray:
    """(n, words): for each text the places that its n-grams are hashed to."""
    at = (_mixed(tok & np.uint64((1 << 44) - 1)) >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)
    bits = np.zeros((n, BITS), bool)
    bits[doc, at] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _apart(bits: np.ndarray, i: np.ndarray, j: np.ndarray, most_i: np.ndarray, most_j: np.ndarray) -> np.ndarray:
    """Positions of the pairs (i, j) of which each has no more bits of its own than it may have n-grams of its own."""
    at = np.arange(len(i))
    own_i, own_j = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for w in range(bits.shape[1]):
        x, y = bits[i[at], w], bits[j[at], w]
        own_i[at] += np.bitwise_count(x & ~y)
        own_j[at] += np.bitwise_count(y & ~x)
        if w % 2:
            at = at[(own_i[at] <= most_i[at]) & (own_j[at] <= most_j[at])]
    return at


def _multiply(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks.setdefault(k, []).append(x)
        for k in list(blocks):
            docs, entries, base = [], [], 0
            for x in blocks.pop(k):
                m = int(np.frombuffer(x, np.int32, 1)[0])
                d = np.frombuffer(x, _DOC, m, 4)
                e = np.frombuffer(x, _ENTRY, -1, 4 + m * _DOC.itemsize)
                docs.append(d)
                entries.append((e["tok"], e["doc"].astype(np.int64) + base, e["rank"], e["cell"], e["part"]))
                base += m
            docs = np.concatenate(docs)
            tok, doc, rank, cell, part = (np.concatenate(x) for x in zip(*entries))
            yield from _pairs(docs, tok + (cell.astype(np.uint64) << np.uint64(52)), doc, rank.astype(np.int64), cell, part, t)

    return run


def _pairs(docs: np.ndarray, tok, doc, rank, cell, part, t: float, room: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The pairs of one block, each text with the smaller ones that share an entry: by distance in the sorted entries.

    tok: n-gram and cell; a cell of two parts pairs only texts of different ones.
    """
    by = np.lexsort((docs["rep"][doc], docs["size"][doc], tok))
    tok, doc, rank, cell, part = tok[by], doc[by], rank[by], cell[by].astype(np.int64), part[by].astype(np.int64)
    rep, size = docs["rep"][doc], docs["size"][doc].astype(np.int64)
    bits = np.ascontiguousarray(docs["bits"])
    index = rank < size - np.ceil(2 * t / (1 + t) * size - 1e-9) + 1
    one_part = cell == part * (part + 1) // 2 + part  # the cell of a part with itself
    new = np.append(True, tok[1:] != tok[:-1])
    place = np.arange(len(tok)) - np.maximum.accumulate(np.where(new, np.arange(len(tok)), 0))
    found: list[np.ndarray] = []
    held = 0
    d, at = 1, np.flatnonzero(place >= 1)
    while len(at):
        i, j = at, at - d
        ok = index[j] & (size[j] >= t * size[i] - 1e-9) & (one_part[i] | (part[i] != part[j]))
        i, j = i[ok], j[ok]
        need = np.ceil(t / (1 + t) * (size[i] + size[j]) - 1e-9).astype(np.int64)
        ok = np.minimum(size[i] - rank[i], size[j] - rank[j]) >= need
        i, j, need = i[ok], j[ok], need[ok]
        ok = _apart(bits, doc[i], doc[j], size[i] - need, size[j] - need)
        i, j = i[ok], j[ok]
        if len(i):
            found.append(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], axis=1))
            held += len(i)
            if held > room:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = len(found[0])
                if held > room // 2:
                    yield _batch(found.pop())
                    held = 0
        d += 1
        at = at[place[at] >= d]
    if found:
        yield _batch(np.unique(np.concatenate(found), axis=0))


def _batch(p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], names=["a", "b"])


def _exact(run: int, t: float):
    """(a, b, x, y) -> the pairs whose texts' sets of n-grams (as 64-bit hashes) have a quotient of at least t, with it."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2, 2000):
                m = b.num_rows
                keys, sizes = [], []
                for c in (2, 3):
                    h, n = _hashes(b.column(c).to_pylist(), run)
                    pair = np.repeat(np.arange(m), n)
                    by = np.lexsort((h, pair))
                    h, pair = h[by], pair[by]
                    once = np.append(True, (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])) if len(h) else np.zeros(0, bool)
                    keys.append((h[once], pair[once]))
                    sizes.append(np.bincount(pair[once], minlength=m))
                h, pair = (np.concatenate(x) for x in zip(*keys))
                by = np.lexsort((h, pair))
                h, pair = h[by], pair[by]
                both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=m)
                score = both / np.maximum(1, sizes[0] + sizes[1] - both)
                ok = np.flatnonzero(score >= t)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(score[ok])], names=["a", "b", "score"])

    return check


def reduced_texts(entities: DataFrame) -> DataFrame:
    """id, doc_id, norm (letters and digits in lower case) of the live text records with content."""
    live = live_rows(entities, ["modality", "doc_id", "content"]).where("modality = 'text' and content is not null")
    return live.select("id", "doc_id", F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]+", "").alias("norm"))


def near_pairs(texts: DataFrame, run: int = 8, t: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b, score of class representatives; members id, rep) of texts (id, norm).

    Every pair of different texts with a quotient of at least t is there. Texts with fewer than ``run`` letters and digits have no n-grams and no pair, also
    among equal ones. Null ids or texts are left out. Whole texts count, whatever their length.
    """
    spark = texts.sparkSession
    rows = texts.where(F.col("id").isNotNull() & (F.length("norm") >= run)).select(
        F.col("id").cast("long").alias("id"), F.sha2("norm", 256).alias("key"), "norm"
    )
    reps = scratch(rows.groupBy("key").agg(F.min(F.struct("id", "norm")).alias("m")).select("key", F.col("m.id").alias("rep"), F.col("m.norm").alias("norm")), "reps")
    members = rows.select("id", "key").join(reps.select("key", "rep"), "key").select("id", "rep")
    table, total = ngram_order(reps, run)
    order = spark.sparkContext.broadcast(table)
    blocks = max(partitions(spark), -(-total // GRAMS))
    packed = reps.select("rep", "norm").mapInArrow(_entries(order, run, t, blocks), "block int, packed binary")
    found = packed.repartitionById(blocks, F.col("block")).mapInArrow(_multiply(t), "a long, b long")
    cand = found.distinct()
    x = reps.select(F.col("rep").alias("a"), F.col("norm").alias("x"))
    y = reps.select(F.col("rep").alias("b"), F.col("norm").alias("y"))
    full = cand.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return full.mapInArrow(_exact(run, t), "a long, b long, score double"), members


def near_duplicates(entities: DataFrame, run: int = 8, t: float = 0.6) -> DataFrame:
    """(id_a, id_b), id_a < id_b: live text records of different doc_id with a quotient of at least t.

    A null doc_id differs from every other, also from a null one.
    """
    texts = scratch(reduced_texts(entities), "texts")
    pairs, members = near_pairs(texts.select("id", "norm"), run, t)
    docs = scratch(members.join(texts.select("id", "doc_id"), "id"), "members")
    several = docs.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
    links = pairs.select("a", "b").unionByName(several.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    left = docs.select(F.col("rep").alias("a"), F.col("id").alias("x"), F.col("doc_id").alias("dx"))
    right = docs.select(F.col("rep").alias("b"), F.col("id").alias("y"), F.col("doc_id").alias("dy"))
    out = links.join(left, "a").join(right, "b").where("x <> y and (dx is null or dy is null or dx <> dy) and (a <> b or x < y)")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_groups(entities: DataFrame, run: int = 8, t: float = 0.6) -> DataFrame:
    """id, class_id (smallest id of equal texts), group_id (smallest id reached by links), links (near classes) of each live text record with n-grams."""
    texts = reduced_texts(entities).select("id", "norm")
    pairs, members = near_pairs(scratch(texts, "texts"), run, t)
    pairs = scratch(pairs.select("a", "b"), "pairs")
    groups = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        members.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .join(degree, "rep", "left")
        .select("id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
