"""The most similar vectors for every vector: a hash-prefix forest.

Each tree gives each vector a long hash string; a character is the coordinate (and its sign) that is
largest after a random rotation, so similar vectors tend to share it. The strings of a tree lie sorted.
From each asking vector's string the search descends along its prefix while the run of strings that
share it holds more than a fixed share of all vectors, and ascends, in all trees alike, where the run is
short: runs of neighbouring prefixes in the sorted array are then one page. It descends from the
``probes`` most likely first characters, so few trees are stored. A page is compared in full with what
asks for it, at every size of the data by the same rule: candidates are a constant share of the vectors.

Vectors that crowd around a common direction would share long prefixes with thousands of others. So
centroids are fitted on a bounded sample (about ``SAMPLE`` vectors, those with the smallest hashed ids); a
tree has one sorted array for each centroid, with the strings of what is left of its vectors without it,
and one for vectors near none. The sample shapes the index only: every vector is indexed and searched.

Where a page begins and ends follows from counts of prefixes, in tables whose size depends on the
parameters. The pages of all trees, laid end to end, are cut into blocks of about equal work, and a
page with more work than a block should have is cut into a grid of parts of its vectors and of its
asking ones. So no task depends on a hot prefix, and no result on how the blocks are cut. Pages of one
centroid lie side by side, whatever their tree: the pages that a vector is sent to are in few blocks, and a
block gets a vector once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.live import live_rows, usable_vector
from ..session import partitions, scratch

SAMPLE = 8192
CHARS = 6
SEED = 20
SLICE = 1000  # rows that are packed at a time
PAIRS = 50_000  # pairs that are measured exactly at a time
TIE = 4e-6  # more than 64 products of unit coordinates lose in float32


@lru_cache(4)
def rotations(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32) for _ in range(count)])


def characters(x: np.ndarray, turn: np.ndarray, probes: int = 1) -> np.ndarray:
    """The ``probes`` most likely characters of each row of x (unit or not), best first: (rows, probes)."""
    y = x @ turn
    size = np.abs(y)
    if probes == 1:
        a = np.argmax(size, axis=1)[:, None]
    else:
        probes = min(probes, x.shape[1])
        a = np.argpartition(-size, probes - 1, axis=1)[:, :probes]
        a = np.take_along_axis(a, np.argsort(-np.take_along_axis(size, a, 1), axis=1, kind="stable"), 1)
    return 2 * a + (np.take_along_axis(y, a, 1) < 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, also where squares over- or underflow in float32."""
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def fit_centroids(x: np.ndarray, near: float = 0.55, least: int = 6) -> np.ndarray:
    """Means of the dense groups of a sample: the densest vector takes its neighbours, and so on."""
    n = len(x)
    if n < least:
        return np.zeros((0, x.shape[1] if n else 1), np.float32)
    degree = np.concatenate([(x[i : i + 1024] @ x.T >= near).sum(axis=1) for i in range(0, n, 1024)])
    free = np.ones(n, bool)
    out = []
    for i in np.argsort(-degree, kind="stable"):
        if degree[i] < least:
            break
        if free[i]:
            close = x @ x[i] >= near
            own = close & free
            free[close] = False
            free[i] = False
            if own.sum() >= least:
                out.append(x[own].mean(axis=0))
    return unit(np.array(out)) if out else np.zeros((0, x.shape[1]), np.float32)


def vector_table(entities: DataFrame, dim: int = 64) -> DataFrame:
    """id, modality, vec (float32 bytes) of the live records with usable vectors, as a scratch table."""
    live = live_rows(entities, ["modality", F.col("vector").cast("array<float>").alias("vector")])
    live = live.where(usable_vector(F.col("vector"), dim))
    return scratch(live.mapInArrow(_to_bytes(dim), "id long, modality string, vec binary"), "vectors")


def _to_bytes(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = np.asarray(b.column(2).flatten()).astype(np.float32)
            at = np.arange(b.num_rows + 1, dtype=np.int32) * (4 * dim)
            vec = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vec], names=["id", "modality", "vec"])

    return run


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """The float32 matrix of a binary column."""
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


class Trees:
    """The tries of all trees: children of nodes by character. Roots come first, one for each (tree, cell).

    A child is a page (0 and up), a deeper node (-1 - node) or, at a node of the frontier, not known yet.
    """

    def __init__(self, cents: np.ndarray, dim: int, trees: int, probes: int):
        self.cents, self.dim, self.trees, self.probes = cents, dim, trees, probes
        self.child = np.zeros((trees * (len(cents) + 1), 2 * dim), np.int32)
        self.frontier = 0

    def _rest(self, x: np.ndarray, cell: np.ndarray, s: np.ndarray) -> np.ndarray:
        """What is left of each row without its cell's centroid; s: its product with it."""
        out = x.copy()
        own = cell >= 0
        out[own] = unit(x[own] - s[own][:, None] * self.cents[cell[own]])
        return out

    def own_cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the cell of each row, -1 if no centroid is near; its rest)."""
        if not len(self.cents):
            return np.full(len(x), -1, np.int64), x
        s = x @ self.cents.T
        c = np.argmax(s, axis=1)
        top = s[np.arange(len(x)), c]
        cell = np.where(top >= 0.5, c, -1)
        return cell, self._rest(x, cell, top)

    def asked_cells(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, cell, rest) for each round of cells that the rows ask: the nearest, the next if about as near, and what is near none."""
        at = np.arange(len(x))
        if not len(self.cents):
            yield at, np.full(len(x), -1, np.int64), x
            return
        s = x @ self.cents.T
        c = np.argsort(-s, axis=1, kind="stable")[:, :2]
        top = np.take_along_axis(s, c, 1)
        yield at, c[:, 0], self._rest(x, c[:, 0], top[:, 0])
        if c.shape[1] > 1 and len(rows := np.flatnonzero(top[:, 1] >= top[:, 0] - 0.1)):
            yield rows, c[rows, 1], self._rest(x[rows], c[rows, 1], top[rows, 1])
        if len(rows := np.flatnonzero(top[:, 0] < 0.65)):
            yield rows, np.full(len(rows), -1, np.int64), x[rows]

    def _descend(self, node: np.ndarray, char: np.ndarray, rest: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The page of each row, or -1 - (2 dim node + character) where a node of the frontier is met."""
        out = np.zeros(len(node), np.int64)
        at = np.arange(len(node))
        depth = 0
        while len(at):
            known = node < self.frontier
            out[at[~known]] = -1 - (node[~known] * 2 * self.dim + char[~known])
            at, node, char = at[known], node[known], char[known]
            to = self.child[node, char].astype(np.int64)
            out[at[to >= 0]] = to[to >= 0]
            deep = to < 0
            at, node = at[deep], -1 - to[deep]
            depth += 1
            if len(at):
                char = characters(rest[at], turns[depth])[:, 0]
        return out

    def places(self, x: np.ndarray, ask: np.ndarray, stored: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place of each stored string; row, place of each asked page). turns: (trees, CHARS, dim, dim)."""
        cells = len(self.cents) + 1
        held = np.flatnonzero(stored)
        cell, rest = self.own_cells(x[held])
        kept = [self._descend(t * cells + cell + 1, characters(rest, turns[t, 0])[:, 0], rest, turns[t]) for t in range(self.trees)]
        held = np.tile(held, self.trees)
        rows, asked = [], []
        own = np.flatnonzero(ask)
        for at, c, r in self.asked_cells(x[own]) if len(own) else ():
            for t in range(self.trees):
                chars = characters(r, turns[t, 0], self.probes)
                p = chars.shape[1]
                rows.append(np.repeat(own[at], p))
                asked.append(self._descend(np.repeat(t * cells + c + 1, p), chars.ravel(), np.repeat(r, p, axis=0), turns[t]))
        none = np.zeros(0, np.int64)
        if rows:  # several characters may lead to one page
            both = np.unique(np.stack([np.concatenate(rows), np.concatenate(asked)]), axis=1)
            return held, np.concatenate(kept), both[0], both[1]
        return held, np.concatenate(kept), none, none

    def page_cells(self, pages: int) -> np.ndarray:
        """The cell of each page."""
        node, out = np.arange(len(self.child)) % (len(self.cents) + 1), np.zeros(pages, np.int64)
        for i, to in enumerate(self.child):  # a node comes after the one above it
            node[-1 - to[to < 0]] = node[i]
            out[to[to >= 0]] = node[i]
        return out

    def turns(self) -> np.ndarray:
        return rotations(self.dim, self.trees * CHARS).reshape(self.trees, CHARS, self.dim, self.dim)


def cut_pages(child: np.ndarray, first: int, sizes: np.ndarray, asks: np.ndarray, most: int, short: int, last: bool, pages: list) -> np.ndarray:
    """Fills the children of the nodes from ``first`` on; appends (size, asks) of new pages; gives the nodes to come.

    sizes, asks: counts by (node, character). A run of more than ``most`` strings becomes a node unless it is the
    ``last`` character; runs side by side are gathered to pages of at least ``short`` strings.
    """
    deeper = 0
    for i in range(len(sizes)):
        open_ = -1  # the page that still grows
        before = -1  # the page before it, if they are neighbours
        for c in range(sizes.shape[1]):
            if sizes[i, c] > most and not last:
                child[first + i, c] = -1 - (len(child) + deeper)
                deeper += 1
                open_ = before = -1
                continue
            if open_ < 0:
                open_ = len(pages)
                pages.append([0, 0])
            child[first + i, c] = open_
            pages[open_][0] += int(sizes[i, c])
            pages[open_][1] += int(asks[i, c])
            if pages[open_][0] >= short:
                open_, before = -1, open_
        if open_ >= 0 and before >= 0:  # what is left at the end joins its neighbour
            row = child[first + i]
            row[row == open_] = before
            pages[before][0] += pages[open_][0]
            pages[before][1] += pages[open_][1]
            pages[open_] = [0, 0]
    return np.zeros((deeper, child.shape[1]), np.int32)


def _unpacked(b: pa.RecordBatch, lo: int, dim: int):
    b = b.slice(lo, SLICE)
    ask, stored = (np.asarray(b.column(i).cast(pa.uint8())) > 0 for i in (2, 3))
    return np.asarray(b.column(0)), [np.asarray(c) for c in b.columns[4:]], ask, stored, matrix(b.column(1), dim)


def _count(shared, dim: int):
    """Stored and asking strings by (node of the frontier, character)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees = shared.value
        turns = trees.turns()
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                _, _, ask, stored, raw = _unpacked(whole, lo, dim)
                _, place, _, asked = trees.places(unit(raw), ask, stored, turns)
                key, at = np.unique(-1 - np.concatenate([place, asked]), return_inverse=True)
                n = np.bincount(at[: len(place)], minlength=len(key))
                q = np.bincount(at[len(place) :], minlength=len(key))
                ok = key >= 0
                yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(n[ok].astype(np.int64)), pa.array(q[ok].astype(np.int64))], names=["key", "n", "q"])

    return run


class Grid:
    """The parts of each page and the block of each part.

    A page of n strings and q asking ones has rows x cols parts: strings are dealt to its rows, asking ones to its columns.
    Pages of one cell are laid side by side.
    """

    def __init__(self, n: np.ndarray, q: np.ndarray, cell: np.ndarray, block: int, most_blocks: int):
        unit_work = 5000  # comparisons that cost as much as moving a string
        self.rows = np.maximum(1, -(-n // block))
        tall = -(-n // self.rows)
        self.cols = np.maximum(1, np.maximum(-(-q // block), -(-(q * np.maximum(1, tall)) // (block * unit_work))))
        parts = self.rows * self.cols
        self.first = np.append(0, np.cumsum(parts))
        wide = -(-q // self.cols)
        work = np.repeat(np.where((n > 0) & (q > 0), tall + wide + tall * wide / unit_work, 0.0), parts)
        by = np.argsort(np.repeat(cell, parts), kind="stable")
        upto = np.cumsum(work[by])
        total = float(upto[-1]) if len(upto) else 0.0
        self.blocks = int(max(1, most_blocks, -(-total // block)))
        self.block = np.zeros(len(work), np.int32)
        self.block[by] = np.minimum(self.blocks - 1, ((upto - work[by] / 2) * self.blocks / max(total, 1.0)).astype(np.int64))
        self.empty = (n == 0) | (q == 0)  # nothing to compare: nothing is sent

    def deal(self, row: np.ndarray, page: np.ndarray, ids: np.ndarray, asking: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of everything that (row, page) is sent to."""
        ok = ~self.empty[page]
        row, page = row[ok], page[ok]
        h = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        r, c = self.rows[page], self.cols[page]
        copies = r if asking else c
        k = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        row, page, h = np.repeat(row, copies), np.repeat(page, copies), np.repeat(h, copies)
        r, c = self.rows[page], self.cols[page]
        if asking:
            part = k * c + (h % c.astype(np.uint64)).astype(np.int64)
        else:
            part = (h % r.astype(np.uint64)).astype(np.int64) * c + k
        return row, self.first[page] + part


_PLACE = np.dtype([("row", "<u2"), ("part", "<i4")])


def _row(dim: int, pull: bool) -> np.dtype:
    return np.dtype([("id", "<i8"), ("kind", "<i8"), *([("weight", "<f8"), ("norm", "<f8")] if pull else []), ("v", "<f4", dim)])


def _grow(shared, dim: int, pull: bool):
    """(block, packed rows): of a batch, each block gets a vector once, and where it is stored or asks."""
    row_type = _row(dim, pull)
    names = [n for n in row_type.names if n not in ("id", "v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, grid = shared.value
        turns = trees.turns()
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                ids, rest, ask, stored, raw = _unpacked(whole, lo, dim)
                row, place, asking, asked = trees.places(unit(raw), ask, stored, turns)
                row, part = grid.deal(row, place, ids, False)
                asking, asked = grid.deal(asking, asked, ids, True)
                who = np.concatenate([row, asking])
                where = np.concatenate([part, asked])
                kind = np.repeat([0, 1], [len(row), len(asking)])
                by = np.lexsort((where, kind, grid.block[where]))
                who, where, kind = who[by], where[by], kind[by]
                to = grid.block[where]
                edge = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
                out = []
                for a, z in zip(edge, np.append(edge[1:], len(to))):
                    used, local = np.unique(who[a:z], return_inverse=True)
                    d = np.zeros(len(used), row_type)
                    d["id"], d["v"] = ids[used], raw[used]
                    for name, of in zip(names, rest):
                        d[name] = of[used]
                    p = np.zeros(z - a, _PLACE)
                    p["row"], p["part"] = local, where[a:z]
                    out.append(np.array([len(used), int((kind[a:z] == 0).sum())], np.int32).tobytes() + d.tobytes() + p.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(to[edge].astype(np.int32)), pa.array(out, pa.binary())], names=["block", "packed"])

    return run


def _search(dim: int, least: float | None, k: int, pull: bool):
    """(a, b, cosine): of each asking vector a, its k best (with at least ``least``) among the parts of a block."""
    row_type = _row(dim, pull)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, stored, asking, base = [], [], [], 0
        for b in batches:
            for x in b.column(1).to_pylist():
                m, s = np.frombuffer(x, np.int32, 2)
                d = np.frombuffer(x, row_type, int(m), 8)
                p = np.frombuffer(x, _PLACE, -1, 8 + int(m) * row_type.itemsize)
                rows.append(d)
                stored.append((p["row"][:s].astype(np.int64) + base, p["part"][:s]))
                asking.append((p["row"][s:].astype(np.int64) + base, p["part"][s:]))
                base += int(m)
        if not rows:
            return
        ids, kinds, raw = (np.concatenate([d[c] for d in rows]) for c in ("id", "kind", "v"))
        mass = tuple(np.concatenate([d[c] for d in rows]) for c in ("weight", "norm")) if pull else None
        rows.clear()
        u = unit(raw)

        def by_part(pairs):
            at, part = (np.concatenate(x) for x in zip(*pairs))
            by = np.lexsort((ids[at], part))
            at, part = at[by], part[by]
            edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            return at, part[edge], np.append(edge, len(part))

        own, own_part, own_edge = by_part(stored)
        ask, ask_part, ask_edge = by_part(asking)
        _, i, j = np.intersect1d(own_part, ask_part, assume_unique=True, return_indices=True)
        got, held = [], 0
        for x, y in zip(i, j):
            for p in _compare(u, raw, ids, kinds, ask[ask_edge[y] : ask_edge[y + 1]], own[own_edge[x] : own_edge[x + 1]], least, k, mass):
                got.append(p)
                held += len(p[0])
                if held > 1_000_000:
                    got = [_best(*(np.concatenate(c) for c in zip(*got)), k)]
                    held = len(got[0][0])
                    if held > 500_000:
                        yield _scored(*got.pop())
                        held = 0
        if got:
            yield _scored(*_best(*(np.concatenate(c) for c in zip(*got)), k))

    return run


def _scored(a, b, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["a", "b", "cosine"])


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each a its k best by s, then smaller b; a pair counts once."""
    by = np.lexsort((b, -s, a))
    a, b, s = a[by], b[by], s[by]
    once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))  # equal pairs have equal s
    a, b, s = a[once], b[once], s[once]
    at = np.arange(len(a))
    place = at - np.maximum.accumulate(np.where(np.append(True, a[1:] != a[:-1]), at, 0))
    ok = place < k
    return a[ok], b[ok], s[ok]


def exact_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x.astype(np.float64), y.astype(np.float64)))
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def _compare(u, raw, ids, kinds, ask: np.ndarray, own: np.ndarray, least, k: int, mass=None, tile: int = 2048):
    """The k best of each asking row in each tile of the stored ones, measured exactly.

    mass: (weight, norm) of each row, or None. With it, only what is heavier counts (at equal weight, what has the smaller
    id), and cosines are multiplied by both norms.
    """
    weight, norm = mass or (None, None)
    for r in range(0, len(ask), tile):
        q = ask[r : r + tile]
        for c in range(0, len(own), 2 * tile):
            v = own[c : c + 2 * tile]
            s = u[q] @ u[v].T
            if mass:
                s *= norm[v].astype(np.float32)
                s[(weight[v] < weight[q][:, None]) | ((weight[v] == weight[q][:, None]) & (ids[v] > ids[q][:, None]))] = -2
            same = np.searchsorted(ids[v], ids[q])  # both lie by id
            hit = np.flatnonzero(ids[v[np.minimum(same, len(v) - 1)]] == ids[q])
            s[hit, same[hit]] = -2
            if (kinds[v] != kinds[q[0]]).any() or (kinds[q] != kinds[q[0]]).any():
                s[kinds[q][:, None] != kinds[v][None, :]] = -2
            floor = np.full(len(q), -1.5 if least is None else least - TIE, np.float32)
            if mass and least is not None:
                floor = (np.minimum(least / np.maximum(norm[q], 1e-9), 2) - TIE).astype(np.float32)
            if least is None:
                busy = np.arange(len(q))
            else:
                busy = np.flatnonzero((s >= floor[:, None]).sum(axis=1) > 2 * k)
            if len(busy) and s.shape[1] > k:
                kth = -np.partition(-s[busy], k - 1, axis=1)[:, k - 1]
                floor[busy] = np.maximum(floor[busy], kth - TIE)
            i, j = np.nonzero(s >= floor[:, None])
            if not len(i):
                continue
            parts = []
            for lo in range(0, len(i), PAIRS):
                a, b = q[i[lo : lo + PAIRS]], v[j[lo : lo + PAIRS]]
                exact = exact_cosines(raw[a], raw[b])
                if mass:
                    exact *= norm[a] * norm[b]
                ok = slice(None) if least is None else exact >= least
                parts.append(_best(ids[a[ok]], ids[b[ok]], exact[ok], k))
            yield tuple(np.concatenate(x) for x in zip(*parts))


def search_forest(
    rows: DataFrame, k: int, least: float | None, dim: int, trees: int, probes: int, short: int, share: float, block: int, pull: bool = False
) -> DataFrame:
    """(a, b, cosine): of each asking row its k best stored ones of its kind, as found by each block.

    ``rows``: id, vec, ask, stored, kind (long); ids are unique. A pair may come from several blocks, with equal cosines.
    ``pull``: rows have weight and norm (doubles), too; b is heavier than a, or as heavy with the smaller id, and cosine is
    the product of the vectors' cosine with both norms.
    """
    spark = rows.sparkSession
    n = rows.count()
    # The rows of the smallest hashes, chosen in each task by itself: about SAMPLE in all, whatever n.
    kept = min(1.0, SAMPLE / max(1, n))
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("id"), 11) <= int(kept * (1 << 53))).select("id", "vec").collect()
    sample.sort(key=lambda r: r["id"])
    x = unit(np.frombuffer(b"".join(bytes(r["vec"]) for r in sample), np.float32).reshape(-1, dim)) if sample else np.zeros((0, dim), np.float32)
    index = Trees(fit_centroids(x), dim, trees, probes)
    most, pages = max(short, int(share * n)), []
    for depth in range(CHARS):
        shared = spark.sparkContext.broadcast(index)
        counts = rows.mapInArrow(_count(shared, dim), "key long, n long, q long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).collect()
        sizes = np.zeros((2, len(index.child) - index.frontier, 2 * dim), np.int64)
        for r in counts:  # one row for each node and character
            sizes[:, r["key"] // (2 * dim) - index.frontier, r["key"] % (2 * dim)] = r["n"], r["q"]
        to_come = cut_pages(index.child, index.frontier, sizes[0], sizes[1], most, short, depth == CHARS - 1, pages)
        index.frontier = len(index.child)
        if not len(to_come):
            break
        index.child = np.concatenate([index.child, to_come])
    table = np.array(pages, np.int64).reshape(-1, 2)
    grid = Grid(table[:, 0], table[:, 1], index.page_cells(len(table)), block, partitions(spark))
    shared = spark.sparkContext.broadcast((index, grid))
    forest = rows.mapInArrow(_grow(shared, dim, pull), "block int, packed binary")
    return forest.repartitionById(grid.blocks, F.col("block")).mapInArrow(_search(dim, least, k, pull), "a long, b long, cosine double")


def nearest(
    vectors: DataFrame,
    k: int = 5,
    least: float | None = None,
    dim: int = 64,
    trees: int = 8,
    probes: int = 8,
    short: int = 256,
    share: float = 1 / 64,
    every: int = 1,
    block: int = 200_000,
) -> DataFrame:
    """id, neighbour, cosine, rank: the k most similar vectors of each vector (by cosine, then smaller id).

    ``vectors``: id, vec (float32 bytes, dim finite numbers, not all zero). ``least``: only neighbours with at
    least this cosine are wanted. ``every``: only vectors whose id is divisible by it ask, against all.
    ``probes``: first characters that a search descends from. ``short``: strings of a page at least; ``share``: a
    longer prefix is taken where a run has more than this share of all vectors. ``block``: strings of a task, or as
    much work; it changes no result. Cosines are exact; what no page of any tree brings together is missed.

    Equal vectors form one class, searched once; each record gets the smallest ids of its neighbours' classes
    and of its own (cosine 1), itself excepted. Nulls are left out. An empty table gives an empty table.
    """
    rows = vectors.where("id is not null and vec is not null").select(F.col("id").cast("long").alias("id"), F.md5("vec").alias("key"), "vec")
    asks = F.col("id") % every == 0
    classes = rows.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("c"), F.max(asks).alias("ask")).where("c > 1")
    classes = scratch(classes.select(F.col("key").alias("_key"), "rep", "ask"), "classes")
    known = rows.join(classes, F.col("key") == F.col("_key"), "left").select("id", "vec", "rep", F.coalesce("ask", asks).alias("ask"))
    known = scratch(known, "known")
    reps = known.where("rep is null or rep = id").select("id", "vec", "ask", F.lit(True).alias("stored"), F.lit(0).cast("long").alias("kind"))
    members = known.where("rep is not null").select("rep", "id")  # of classes of more than one
    found = search_forest(reps, k, least, dim, trees, probes, short, share, block)
    # Of a class only its k + 1 smallest ids can be among anyone's nearest k.
    crowd = Window.partitionBy("rep").orderBy("id")
    low = members.withColumn("i", F.row_number().over(crowd)).where(F.col("i") <= k + 1).select(F.col("rep").alias("_b"), F.col("id").alias("_member"))
    own = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cosine"))
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    near = found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    near = near.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k).drop("i").unionByName(own)
    cand = near.join(low, F.col("b") == F.col("_b"), "left").select("a", F.coalesce("_member", "b").alias("neighbour"), "cosine")
    each = cand.join(members.select(F.col("rep").alias("_r"), F.col("id").alias("_id")), F.col("a") == F.col("_r"), "left")
    each = each.select(F.coalesce("_id", "a").alias("id"), "neighbour", "cosine").where((F.col("id") % every == 0) & (F.col("id") != F.col("neighbour")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbour", "cosine", "rank")


def close_pairs(vectors: DataFrame, least: float, k: int = 5, **kw) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs with a cosine of at least ``least`` of which one is among the k nearest of the other."""
    near = nearest(vectors, k, least, **kw)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
