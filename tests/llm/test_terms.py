import collections
import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from siftspark.llm import distinctive, ngrams, percentile

ENTITY = "id bigint, modality string, created_at timestamp, deleted boolean, terms array<struct<term:string,start:int,end:int>>, tags array<string>, tf int, score string, value string"


def entities(spark, rows):
    """rows: id, modality, terms, tags"""
    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, m, t, False, None if ts is None else [(x, 0, 1) for x in ts], tags, 9, "clash", "clash") for i, m, ts, tags in rows], ENTITY)


def test_ngrams_against_counting(spark):
    r = random.Random(1)
    docs = [[r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(60)] + [None, [], ["x"] * 400, ["a", None, "b"]]
    df = spark.createDataFrame([(d,) for d in docs], "v array<string>").repartition(3)
    got = {tuple(x.value): (x.occurrences, x.records) for x in ngrams.frequencies(df, F.col("v"), 3).collect()}
    occ, rec = collections.Counter(), collections.Counter()
    for d in docs:
        d = [x for x in d or [] if x is not None]
        grams = [tuple(d[i : i + n]) for n in (1, 2, 3) for i in range(len(d) - n + 1)]
        occ.update(grams)
        rec.update(set(grams))
    assert got == {g: (occ[g], rec[g]) for g in occ}


def test_intervals_of_nothing():
    assert list(ngrams.intervals(np.zeros(0, np.int64), np.zeros(0, np.int64), 2)) == []


def test_marks(spark):
    rows = [(i, "text", ["every", "every", f"own{i}"], [" RAG", "rag "] if i < 2 else None) for i in range(7)] + [(7, "image", None, [None, "", "  ", "Solo"]), (8, "image", [], ["rag"])]
    got = {(r.kind, r.value): (r.occurrences, r.records, r.mark) for r in ngrams.value_frequencies(entities(spark, rows + rows[:2])).collect()}
    assert got["term", "every"] == (14, 7, "common")
    assert got["term", "own3"] == (1, 1, "rare")
    assert got["tag", "rag"] == (5, 3, "common") and got["tag", "solo"] == (1, 1, "rare")
    assert len(got) == 10
    assert ngrams.value_frequencies(entities(spark, [])).count() == 0
    two = {(r.value): r.mark for r in ngrams.value_frequencies(entities(spark, [(i, "text", ["q"] if i < 2 else ["z"], None) for i in range(8)])).collect()}
    assert two["q"] is None  # exactly a quarter isn't more than a quarter


def test_distinctive_by_hand(spark):
    docs = {1: ["a", "a", "a", "b"], 2: ["b", "c"], 3: ["b"], 4: []}
    rows = [(i, "text", d, None) for i, d in docs.items()] + [(5, "image", ["a"], None), (6, "text", None, None)]
    for limit in (10_000, 0):  # broadcast and shuffle join
        got = {(r.id, r.term): r for r in distinctive.distinctive_terms(entities(spark, rows), broadcast_bytes=limit).collect()}
        assert set(got) == {(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "b")}
        n, avg = 5, 7 / 5
        for (i, t), r in got.items():
            tf, dl = docs[i].count(t), len(docs[i])
            cf, df = sum(d.count(t) for d in docs.values()), sum(t in d for d in docs.values())
            lam, tfn = cf / n, tf * math.log2(1 + avg / dl)
            assert (r.tf, r.dl, r.cf, r.df) == (tf, dl, cf, df)
            assert abs(r.score - (math.log2(1 + lam) + tfn * math.log2((1 + lam) / lam)) / (tfn + 1)) < 1e-9
        assert got[1, "a"].score > got[1, "b"].score
    assert distinctive.distinctive_terms(entities(spark, [])).count() == 0
    top = distinctive.top_terms(entities(spark, rows), 1).collect()
    assert {(r.id, r.term) for r in top} >= {(1, "a"), (2, "c"), (3, "b")}


def test_a_long_record_and_copies(spark):
    rows = [(1, "text", ["w"] * 5000 + ["v"], None), (2, "text", ["v"], None)] * 3
    got = {(r.id, r.term): r.tf for r in distinctive.distinctive_terms(entities(spark, rows)).collect()}
    assert got == {(1, "w"): 5000, (1, "v"): 1, (2, "v"): 1}


FUSED = "qid bigint, id bigint, vec_rank int, key_rank int, vec_score double, key_score double, rrf double, score string, v int"


def fused(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], FUSED)


def test_inverse_normal(spark):
    from statistics import NormalDist

    ps = [1e-12, 1e-4, 0.05, 0.3, 0.5, 0.77, 0.99, 1 - 1e-9]
    got = [r.z for r in spark.createDataFrame([(p,) for p in ps], "p double").select(percentile.inverse_normal(F.col("p")).alias("z")).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], rtol=1e-9, atol=1e-12)


def test_percentiles_by_hand_and_in_ranges(spark):
    from statistics import NormalDist

    r = random.Random(2)
    rows = []
    for q in (1, 2):
        for i in range(40 if q == 1 else 5):
            vr, kr = r.choice([0, 1, 2]), r.choice([0, 1, 2])
            rows.append((q, i, vr, kr, r.choice([0.1, 0.2, 0.5, 1e300]), r.choice([0.0, 3.0, 5.5, float("inf")]), r.choice([0.1, 0.2, None])))
    want = {}
    for q in (1, 2):
        own = [x for x in rows if x[0] == q]
        keys = {"vec": [(-x[4] if x[2] > 0 else None) for x in own], "key": [(x[5] if x[3] > 0 else None) for x in own], "rrf": [x[6] for x in own]}
        n = len(own)
        for j, x in enumerate(own):
            z, place = 0.0, []
            for vals in keys.values():
                rank = [-math.inf if v is None else v for v in vals]
                better, ties = sum(v > rank[j] if vals[j] is not None else vals[k] is not None for k, v in enumerate(rank)), sum((v is None) == (vals[j] is None) and (v is None or v == vals[j]) for v in vals)
                z += NormalDist().inv_cdf((n - better - (ties - 1) / 2 - 0.5) / n) / 3
                place.append(better + 1)
            want[q, x[1]] = (round(z, 6), *place)
    for part in (1_000_000, 10):
        got = {(g.qid, g.id): (round(g.score, 6), g.vec_place, g.key_place, g.rrf_place) for g in percentile.fuse_percentiles(fused(spark, rows + rows[:5]), rows_per_part=part).collect()}
        assert got == want
    order = percentile.ranked(fused(spark, rows), rows_per_part=10).where("qid = 1").orderBy("position").collect()
    assert [o.position for o in order] == list(range(1, 41)) and [(-o.score, o.id) for o in order] == sorted((-o.score, o.id) for o in order)


def test_fused_edges(spark):
    assert percentile.fuse_percentiles(fused(spark, [])).count() == 0
    nan = float("nan")
    rows = [(1, 1, 1, 1, nan, nan, nan), (1, 2, 1, 1, 0.5, 1.0, 0.1), (1, 3, None, None, 0.1, 9.0, None), (None, 4, 1, 1, 0.1, 1.0, 1.0)]
    got = {r.id: (r.vec_place, r.key_place, r.rrf_place) for r in percentile.fuse_percentiles(fused(spark, rows), weights={"key": 2.0}).collect()}
    assert got == {1: (2, 2, 2), 2: (1, 1, 1), 3: (2, 2, 2)}
    one = percentile.fuse_percentiles(fused(spark, [(5, 5, 0, 0, None, None, None)])).first()
    assert abs(one.score) < 1e-12


def test_suffix_order_and_records():
    """Against a plain count, also of runs that repeat inside a record in any order."""
    r = np.random.default_rng(5)
    recs = [r.integers(0, 3, n).tolist() for n in (7, 1, 12, 4, 9)]
    codes, rec = np.concatenate([np.array(x) for x in recs]), np.repeat(np.arange(5), [7, 1, 12, 4, 9])
    order, shared = ngrams.suffix_array(codes, rec, 4)
    tails = [tuple(recs[rec[i]][i - int(np.flatnonzero(rec == rec[i])[0]) :][:4]) for i in order]
    assert tails == sorted(tails) and sorted(order) == list(range(len(codes)))
    for a, b, k in zip(tails, tails[1:], shared[1:]):
        assert a[:k] == b[:k] and (k == 4 or a[: k + 1] != b[: k + 1] or len(a) == k or len(b) == k)
    got = {}
    for k, at, occ, n in ngrams.intervals(codes, rec, 4):
        for a, o, m in zip(at, occ, n):
            got[tuple(codes[a : a + k].tolist())] = (o, m)
    want = {}
    for i, x in enumerate(recs):
        for k in range(1, 5):
            for j in range(len(x) - k + 1):
                o, m = want.get(tuple(x[j : j + k]), (0, set()))
                want[tuple(x[j : j + k])] = (o + 1, m | {i})
    assert got == {g: (o, len(m)) for g, (o, m) in want.items()}


def test_leaders_are_at_the_head_of_the_order(spark):
    r = random.Random(8)
    rows = [(q, i, 1, 1, r.random(), r.random() * 100, r.randint(0, 6) / 100) for q in range(12) for i in range(25)]
    fused = spark.createDataFrame(rows, "qid long, id long, vec_rank int, key_rank int, vec_score double, key_score double, rrf double")
    got = {(x.qid, x.id) for x in percentile.leaders(fused, 8).collect()}
    want = set()
    for q in range(12):
        own = [x for x in rows if x[0] == q]
        for x in own:
            if sum(y[4] < x[4] for y in own) < 8 and sum(y[5] > x[5] for y in own) < 8 and sum(y[6] > x[6] for y in own) < 8:
                want.add((q, x[1]))
    assert got == want and want
