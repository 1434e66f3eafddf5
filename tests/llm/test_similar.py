import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.llm import forest, neardup, peaks

TEXTS = "id bigint, modality string, created_at timestamp, deleted boolean, doc_id string, content string, norm string, rep string, block int"


def texts(spark, rows):
    """rows: id, doc_id, content"""
    return spark.createDataFrame([(i, "text", dt.datetime(2025, 1, 1), None, d, c, "clash", "clash", 1) for i, d, c in rows], TEXTS)


def runs(s):
    s = "".join(c for c in (s or "").lower() if c.isalnum())
    return {s[i : i + 8] for i in range(len(s) - 7)}


def brute_pairs(rows, t=0.6):
    out = set()
    for i, (a, da, x) in enumerate(rows):
        for b, db, y in rows[i + 1 :]:
            p, q = runs(x), runs(y)
            if p and q and (da is None or db is None or da != db) and len(p & q) / len(p | q) >= t:
                out.add((min(a, b), max(a, b)))
    return out


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "索引", "向量", "检索", "epsilon", "zeta", "eta"]
    base = [" ".join(r.choice(words) + str(r.randint(0, 40)) for _ in range(r.choice([6, 30, 60]))) for _ in range(60)]
    rows = []
    for i in range(240):
        t = base[i % 60].split(" ")
        for _ in range(r.randint(0, len(t) // 4)):
            t[r.randrange(len(t))] = r.choice(words)
        if r.random() < 0.3:
            k = r.randrange(len(t))
            t = t[k:] + t[:k]
        rows.append((i, f"d{i % 200}", " ".join(t)))
    rows += [(900, "e1", base[0]), (901, "e2", base[0].upper() + "!!"), (902, "e2", base[0]), (903, None, base[0]), (904, None, base[0])]
    rows += [(910, "f", ""), (911, "g", None), (912, "h", "short"), (913, "i", "short"), (914, "j", "exactly8"), (915, "k", "Exactly 8"), (916, "l", "x" * 30_000), (917, "m", "x" * 29_000)]
    got = [(x.id_a, x.id_b) for x in neardup.near_duplicates(texts(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    groups = {x.id: x for x in neardup.near_groups(texts(spark, rows)).collect()}
    assert groups[902].class_id == groups[901].class_id == groups[900].class_id and 912 not in groups and groups[914].group_id == 914
    assert all(groups[a].group_id == groups[b].group_id for a, b in got)
    assert neardup.near_duplicates(texts(spark, [])).count() == 0


def test_bit_maps_part_no_pair():
    r = np.random.default_rng(1)
    a = np.sort(r.integers(0, 1 << 44, 250).astype(np.uint64))
    b = np.concatenate([a[:188], r.integers(0, 1 << 44, 62).astype(np.uint64)])  # a quotient of 0.6
    c = r.integers(0, 1 << 44, 250).astype(np.uint64)
    bits = neardup._bit_map(np.repeat([0, 1, 2], 250), np.concatenate([a, b, c]), 3)
    most = np.array([62, 62, 62])
    assert neardup._apart(bits, np.array([0, 0, 1]), np.array([1, 2, 2]), most, most).tolist() == [0]


def test_hot_columns_are_cut(spark, monkeypatch):
    """With parts of three entries, every column of these texts is a grid of cells."""
    r = random.Random(3)
    words = [f"word{i}" for i in range(30)]
    base = " ".join(r.choice(words) for _ in range(40))
    rows = []
    for i in range(40):
        t = base.split(" ")
        for _ in range(i % 9):
            t[r.randrange(40)] = r.choice(words)
        rows.append((i, f"d{i}", " ".join(t)))
    monkeypatch.setattr(neardup, "_add_tiles", _parts_of_three)
    got = [(x.id_a, x.id_b) for x in neardup.near_duplicates(texts(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows) and len(got) > 100


def _parts_of_three(batches):
    from siftspark.llm import neardup

    neardup.HOT = 3
    yield from neardup._add_tiles(batches)


VECTORS = "id bigint, modality string, created_at timestamp, deleted boolean, vector array<float>, node string, cosine string"


def entities(spark, v, ids=None, modality=None):
    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(int(ids[i] if ids is not None else i), modality[i] if modality else "text", t, False, None if x is None else [float(y) for y in x], "clash", "clash") for i, x in enumerate(v)], VECTORS)


def clustered(seed, groups, n, dim=64, spread=0.55):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    noise = r.standard_normal((n, dim))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    lab = r.integers(0, groups, n)
    v = centres[lab] * np.sqrt(1 - spread**2) + noise * spread
    return v / np.linalg.norm(v, axis=1, keepdims=True), lab


def test_forest_recall(spark):
    v, _ = clustered(1, 6, 1500)
    near = np.random.default_rng(2).integers(0, 1500, 200)
    v = np.concatenate([v, v[near] + 0.03 * np.random.default_rng(3).standard_normal((200, 64)) / 8 * 2])
    v[7] = v[8] = v[9] = v[10] * 1.0
    table = forest.vector_table(entities(spark, v))
    x = np.array(v, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    truth = set()
    for i in range(len(x)):
        for j in np.lexsort((np.arange(len(x)), -np.round(s[i], 12)))[:5]:
            if s[i, j] >= 0.955:
                truth.add((min(i, int(j)), max(i, int(j))))
    got = {(r.id_a, r.id_b) for r in forest.close_pairs(table, 0.955).collect()}
    assert len(truth & got) >= 0.98 * len(truth) and len(got - truth) <= 3
    hits = 0
    rows = forest.nearest(table, 5, every=20).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, set()).add(r.neighbour)
    assert set(by) == set(range(0, 1700, 20)) and all(len(b) == 5 for b in by.values())
    for i, b in by.items():
        hits += len(b & {int(j) for j in np.lexsort((np.arange(len(x)), -np.round(s[i], 12)))[:5]})
    assert hits >= 0.9 * 5 * len(by)


def test_blocks_change_no_result(spark):
    """Also where every page is a grid of many parts."""
    v, _ = clustered(13, 3, 1200, spread=0.8)
    table = forest.vector_table(entities(spark, v))
    whole, cut = ({(r.id, r.neighbour, r.rank) for r in forest.nearest(table, 5, trees=3, probes=2, short=60, block=b).collect()} for b in (200_000, 40))
    assert whole == cut and len(whole) == 6000


def test_recall_at_every_size(spark):
    """With one set of parameters, also where prefixes of several characters are needed."""
    v, _ = clustered(21, 2, 2000, spread=0.5)
    table = forest.vector_table(entities(spark, v))
    x = np.array(v, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    best = {i: set(np.argsort(-s[i])[:5].tolist()) for i in range(2000)}
    for short, share, least in ((256, 1 / 64, 0.97), (16, 1 / 256, 0.9)):
        rows = forest.nearest(table, 5, short=short, share=share, every=20).collect()
        assert sum(r.neighbour in best[r.id] for r in rows) >= least * 500


def test_pages_hold_every_string_once():
    child = np.zeros((2, 8), np.int32)
    sizes = np.array([[5, 0, 90, 1, 2, 3, 4, 1], [0, 0, 0, 0, 0, 0, 0, 0]])
    pages = []
    more = forest.cut_pages(child, 0, sizes, sizes, 20, 6, False, pages)
    assert len(more) == 1 and child[0].tolist() == [0, 0, -3, 1, 1, 1, 1, 1] and sum(p[0] for p in pages) == 16
    assert len(forest.cut_pages(child, 0, sizes, sizes, 20, 6, True, [])) == 0


def test_many_that_ask_one_page_are_cut():
    """A page of few strings that a million ask is no single part."""
    grid = forest.Grid(np.array([50, 3000]), np.array([1_000_000, 10_000]), np.zeros(2, np.int64), 200_000, 4)
    assert (-(-np.array([1_000_000, 10_000]) // grid.cols) <= 200_000).all() and grid.rows.tolist() == [1, 1] and grid.cols[1] == 1
    ids = np.arange(1000)
    row, part = grid.deal(ids, np.zeros(1000, np.int64), ids, True)
    assert len(row) == 1000 and set(part.tolist()) == set(range(grid.cols[0]))  # asked once
    row, part = grid.deal(ids[:50], np.zeros(50, np.int64), ids, False)
    assert len(row) == 50 * grid.cols[0]  # stored in each


def test_ties_are_measured_in_small_parts():
    """Vectors as good as equal: every pair of a tile is measured, but not all of them at a time."""
    import tracemalloc

    r = np.random.default_rng(2)
    raw = (np.ones((800, 64)) + 1e-5 * r.standard_normal((800, 64))).astype(np.float32)
    ids = np.arange(800)
    tracemalloc.start()
    a, b, s = (np.concatenate(x) for x in zip(*forest._compare(forest.unit(raw), raw, ids, np.zeros(800, np.int64), ids, ids, 0.9, 8)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    a, b, s = forest._best(a, b, s, 8)
    exact = forest.exact_cosines(np.repeat(raw[:1], 799, axis=0), raw[1:])
    assert peak < 300e6 and len(a) == 6400 and sorted(s[a == 0].tolist()) == pytest.approx(np.sort(exact)[-8:].tolist(), abs=1e-15)


def test_forest_edges(spark):
    one = np.eye(64)[0]
    v = [one, one, one * 2, None, np.zeros(64), np.ones(3), np.full(64, np.nan), one, np.eye(64)[1]]
    table = forest.vector_table(entities(spark, v))
    assert {r.id for r in table.select("id").collect()} == {0, 1, 2, 7, 8}
    got = {(r.id_a, r.id_b) for r in forest.close_pairs(table, 0.955).collect()}
    assert got == {(0, 1), (0, 2), (0, 7), (1, 2), (1, 7), (2, 7)}
    assert forest.close_pairs(forest.vector_table(entities(spark, [])), 0.955).count() == 0
    copies = forest.vector_table(entities(spark, [one] * 40))
    assert {(r.id_a, r.id_b) for r in forest.close_pairs(copies, 0.955).collect()} == {(a, b) for a in range(6) for b in range(a + 1, 40) if a < 5 or b == 5 and a < 5}


def test_groups_are_found_and_checked(spark):
    v, lab = clustered(5, 5, 400, spread=0.5)
    r = np.random.default_rng(6)
    noise = r.standard_normal((80, 64))
    tiny, _ = clustered(9, 1, 10, spread=0.5)
    v = np.concatenate([v, noise, tiny, [v[0]] * 30])
    mod = ["image" if x == 4 else "text" for x in lab] + ["text"] * 90 + [("image" if lab[0] == 4 else "text")] * 30
    members, groups = peaks.checked_groups(forest.vector_table(entities(spark, v, modality=mod)))
    members = members.cache()
    assert members.count() == len(v) and groups.agg({"size": "sum"}).first()[0] == len(v)
    got = {}
    for m in members.where("sound").collect():
        got.setdefault(m.group_id, set()).add(m.id)
    want = {}
    for i, x in enumerate([*lab, *[-1] * 90, *[lab[0]] * 30]):
        if x >= 0:
            want.setdefault(int(x), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(min(m) == g for g, m in got.items())
    top = peaks.typical(members.where("sound"), 3).collect()
    assert all(len(t.typical) == 3 and t.size == len(got[t.group_id]) for t in top)
    assert peaks.checked_groups(forest.vector_table(entities(spark, [])))[0].count() == 0


def test_peaks_in_small_blocks(spark, monkeypatch):
    """Clusters much larger than a block come out whole, level by level."""
    v, lab = clustered(7, 3, 900, spread=0.5)
    u = forest.unit(v)
    ids = np.arange(900)
    peak = peaks._block_peaks(u, np.ones(900), ids, 0.6)
    assert len({(peak[i], lab[i]) for i in range(900)}) == 3
    labels = peaks.peak_labels(forest.vector_table(entities(spark, v))).collect()
    assert len({r.label for r in labels}) <= 30 and len(labels) == 900


def test_rounds_join_what_blocks_part(spark, monkeypatch):
    """With blocks of two nodes the levels leave many pieces; the rounds lead them to one peak a cluster."""
    monkeypatch.setattr(peaks, "_level", _no_level)
    v, lab = clustered(11, 2, 300, spread=0.5)
    labels = {r.id: r.label for r in peaks.peak_labels(forest.vector_table(entities(spark, v))).collect()}
    assert len(labels) == 300 and all(len({labels[i] for i in range(300) if lab[i] == g}) == 1 for g in (0, 1))
    assert labels[int(np.flatnonzero(lab == 0)[0])] != labels[int(np.flatnonzero(lab == 1)[0])]


def _no_level(dim, near):
    """A level whose blocks hold one node each."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], b.column(0)], names=["node", "kind", "n", "s", "peak"])

    return run


def test_follow(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "node long, peak long")
    got = {r.node: r.peak for r in peaks.follow(links).collect()}
    assert got == {i: 20 for i in range(20)} | {100: 101}
    assert peaks.follow(links.limit(0)).count() == 0


def test_rounds_point_to_the_denser_behind_many_lighter(spark):
    """The most similar denser node counts, however many lighter ones lie nearer."""
    e = np.eye(64)
    nodes = [(1, 5.0, e[0]), (2, 50.0, 0.7 * e[0] + 0.51**0.5 * e[1])] + [(10 + i, 1.0, 0.9 * e[0] + 0.19**0.5 * e[2 + i]) for i in range(20)]
    rows = [(i, 0, n, bytearray((n * v).astype(np.float32).tobytes())) for i, n, v in nodes]
    got = {r.node: r.peak for r in peaks._round_links(spark.createDataFrame(rows, peaks.NODE), 0.6, 64).collect()}
    assert got == {i: 2 for i, _, _ in nodes if i != 2}


def test_superseded_tables_are_released(spark):
    """No table of vectors but the given one and that of the means outlives the clusters."""
    from siftspark import session

    v, _ = clustered(41, 3, 200, spread=0.5)
    table = forest.vector_table(entities(spark, v))
    before = {path for _, path in session._written}
    members, _ = peaks.checked_groups(table)
    left = [path for _, path in session._written if path not in before]
    held = [p.rsplit("-", 2)[1] for p in left if {"vec", "s"} & set(spark.read.parquet(p).columns)]
    assert sorted(held) == ["fit", "means", "sums"] and members.count() == 200


def test_heavy_prefixes_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(peaks, "PART", 40)
    v, lab = clustered(31, 2, 500, spread=0.4)
    labels = {r.id: r.label for r in peaks.peak_labels(forest.vector_table(entities(spark, v))).collect()}
    assert len({(labels[i], lab[i]) for i in range(500)}) == 2


def test_tiles_of_groups_change_no_result(spark, monkeypatch):
    v, _ = clustered(33, 6, 300, spread=0.5)
    table = forest.vector_table(entities(spark, v))
    one = {(r.id, r.group_id, r.sound) for r in peaks.checked_groups(table)[0].collect()}
    monkeypatch.setattr(peaks, "TILE", 2)
    assert one == {(r.id, r.group_id, r.sound) for r in peaks.checked_groups(table)[0].collect()} and any(s for _, _, s in one)


def test_chance_neighbours_take_no_group_away(spark):
    """A record beside a member of a group, but unlike the others, is let go; the group stays sound."""
    v, lab = clustered(12, 2, 60, spread=0.5)
    c = v[lab == 0].mean(axis=0)
    r = np.random.default_rng(4).standard_normal(64)
    r -= (r @ c) / (c @ c) * c
    v = np.concatenate([v, [v[lab == 0][0] + 1.25 * r / np.linalg.norm(r)]])  # 0.62 to that member, some 0.46 to the others
    members, _ = peaks.checked_groups(forest.vector_table(entities(spark, v)))
    got = {}
    for m in members.where("sound").collect():
        got.setdefault(m.group_id, set()).add(m.id)
    assert sorted(map(sorted, got.values())) == sorted([int(i) for i in np.flatnonzero(lab == g)] for g in (0, 1))


@pytest.mark.parametrize("n,depth", [(10, 0), (50_001, 1), (10_000_000, 2)])
def test_depth(n, depth):
    assert peaks._depth(n) == depth
