import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.config import EngineConfig
from siftspark.operators import bm25, fusion, hnsw, knn, search


def test_bm25_by_hand(spark):
    rows = [(1, "alpha beta beta"), (2, "alpha"), (3, "gamma"), (4, ""), (5, None)]
    docs = bm25.document_terms(spark.createDataFrame(rows, "k bigint, s string"), "k", F.col("s"))
    q = spark.createDataFrame([(1, "beta beta alpha"), (2, "the"), (3, None)], "qid bigint, query string")
    got = {(r.qid, r.id): (r.score, r.rank) for r in bm25.bm25_top_k(docs, q).collect()}
    n, avg = 5, 5 / 5
    w = lambda tf, dl, df: math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {(1, 1): (round(w(1, 3, 2) + w(2, 3, 1), 6), 1), (1, 2): (round(w(1, 1, 2), 6), 2)}


def test_bm25_deleted_and_ties(spark):
    docs = bm25.document_terms(spark.createDataFrame([(i, "same text") for i in range(5, 0, -1)], "k bigint, s string"), "k", F.col("s"))
    q = spark.createDataFrame([(1, "text")], "qid bigint, query string")
    gone = spark.createDataFrame([(1,)], "id bigint")
    got = bm25.bm25_top_k(docs, q, 2, deleted=gone).collect()
    assert [(r.id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(2, 1), (3, 2)]
    assert bm25.bm25_top_k(docs.limit(0), q).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((300, 16))
    v[40:60] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vector array<double>").repartition(5).cache()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_flat_against_numpy_and_native(spark, vectors, metric):
    v, df = vectors
    q = spark.createDataFrame([(i, v[i].tolist()) for i in (0, 7, 45)], "qid bigint, vector array<double>")
    got, native = (sorted((r.qid, r["rank"], r.id, r.dist) for r in f(q, df, 12, metric).collect()) for f in (knn.flat_top_k, knn.flat_native))
    assert got == native
    for i in (0, 7, 45):
        d = np.round(1 - v @ v[i] if metric == "cosine" else np.linalg.norm(v - v[i], axis=1), 6) + 0.0
        assert [g[2] for g in got if g[0] == i] == [int(j) for j in np.lexsort((np.arange(300), d))[:12]]


def test_flat_edges(spark, vectors):
    _, df = vectors
    none = spark.createDataFrame([], "qid bigint, vector array<double>")
    assert knn.flat_top_k(none, df).count() == 0
    bad = spark.createDataFrame([(1, [1.0]), (2, None)], "id bigint, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, vector array<double>")
    assert knn.flat_top_k(q, bad, 0).count() == 0


def test_hnsw_recall_tombstones_and_reload(spark, vectors):
    v, df = vectors
    graph = hnsw.build(df, 16, 2).cache()
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 300, 10)], "qid bigint, vector array<double>")
    recall = fusion.recall_at_k(knn.flat_top_k(q, df, 10), hnsw.search(graph, q, 10), 10).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9
    gone = hnsw.delete(graph, spark.createDataFrame([(7,), (70,)], "id bigint"))
    assert not {7, 70} & {r.id for r in hnsw.search(gone, q, 10).collect()}


def test_hnsw_self_recall_and_update():
    v = np.random.default_rng(1).standard_normal((80, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = hnsw.Graph(64)
    for i, x in enumerate(v):
        g.add(i, x)
    assert sum(g.search(x.astype(np.float32), 1)[0][0] == i for i, x in enumerate(v)) >= 75
    g.add(3, v[4])
    assert len(g) == 80 and {i for i, _ in g.search(v[4].astype(np.float32), 2)} == {3, 4}
    g.delete(3)
    g.add(3, v[3])
    assert g.search(v[3].astype(np.float32), 1)[0][0] == 3
    assert hnsw.Graph(4).search(np.zeros(4, np.float32)) == []
    assert hnsw.HnswParams(1, 1, 1) == hnsw.HnswParams(16, 200, 64)


def test_rrf(spark):
    t = "qid bigint, id bigint, rank int, score double"
    vec, key = spark.createDataFrame([(1, 1, 1, 0.1), (1, 2, 2, 0.2), (1, 2, 5, 0.9)], t), spark.createDataFrame([(1, 2, 1, 9.0), (1, 3, 2, 8.0)], t)
    got = {r.id: r for r in fusion.rrf_fuse(vec, key).collect()}
    assert {i: round(r.rrf, 9) for i, r in got.items()} == {2: 0.032522475, 1: 0.016393443, 3: 0.016129032}
    assert (got[1].key_rank, got[1].key_score, got[2].vec_rank) == (0, 0.0, 2)
    p = spark.createDataFrame([(1, 0, -1.0, 3.0)], "qid bigint, rrf_k int, vector_weight double, keyword_weight double")
    assert round({r.id: r.rrf for r in fusion.rrf_fuse(vec, key, p).collect()}[2], 9) == round(1 / 62 + 3 / 61, 9)


def test_recall_and_plans():
    assert fusion.recall_lists([1, 2, 3, 4], [2, 9, 1], 4) == 0.5
    assert fusion.recall_lists([], [1], 3) == 1 and fusion.recall_lists([1], [1], 0) == 0
    assert fusion.plan_channels("q", True, None, False)[0] == ["vector", "keyword", "rrf"]
    assert fusion.plan_channels("q", False, "image", False)[0] == ["keyword"] and fusion.plan_channels("q", False, "image", False)[1]
    assert "cross_modal" in fusion.plan_channels("q", False, "image", True)[0]


def test_normalize(spark):
    r = spark.createDataFrame([(1, None, "q", 500, "x", None, -1, 0.0, None, "", None), (2, "none", " ", 5, "l2", "flat", 9, 2.0, 3.0, "text", "f")], "qid bigint, collection string, query string, top_k int, metric string, index_type string, rrf_k int, vector_weight double, keyword_weight double, modality string, filter string")
    cols = spark.createDataFrame([("default",)], "name string")
    a, b = sorted(fusion.normalize_requests(r, cols).collect(), key=lambda x: x.qid)
    assert (a.collection, a.top_k, a.metric, a.index_type, a.rrf_k, a.vector_weight, a.keyword_weight, a.modality, a.filter, a.error) == ("default", 12, "cosine", "hnsw", 60, 1.0, 1.0, None, "", None)
    assert b.error == 40001 or b.error == 40400


def entities(spark):
    rows = []
    for i in range(60):
        kind = "image" if i % 6 == 0 else "text"
        v = [1.0, i / 60, 0.0] if i != 13 else None
        rows.append((i, "main" if i % 2 else "other", kind, v, {"title": f"t{i}"}, f"s{i}", i == 9, None if kind == "image" else f"alpha word{i}", f"d{i}", f"alpha cap{i}" if kind == "image" else None, ["x"] if i % 5 == 0 else [], None))
    return spark.createDataFrame(rows, "id bigint, collection string, modality string, vector array<double>, scalar map<string,string>, source_ref string, deleted boolean, content string, doc_id string, caption string, tags array<string>, content_hash string")


def request(spark, **kw):
    base = dict(qid=1, collection="main", query="alpha", top_k=5, metric="cosine", index_type="flat", rrf_k=60, vector_weight=1.0, keyword_weight=1.0, modality=None, filter="", vector=[1.0, 0.0, 0.0])
    return spark.createDataFrame([tuple((base | kw).values())], "qid bigint, collection string, query string, top_k int, metric string, index_type string, rrf_k int, vector_weight double, keyword_weight double, modality string, filter string, vector array<double>")


def test_hybrid_post_and_pre(spark):
    ents = entities(spark).cache()
    post = search.search_hybrid(request(spark, top_k=12), ents, dim=3).collect()
    pre = search.search_hybrid(request(spark, top_k=12), ents, dim=3, filter_mode="pre").collect()
    assert {r.collection for r in post + pre} == {"main"} and 9 not in {r.id for r in post + pre}
    assert len(post) <= 12 and [r.position for r in sorted(pre, key=lambda r: r.position)] == list(range(1, 13))
    assert [r.rrf for r in sorted(post, key=lambda r: r.position)] == sorted((r.rrf for r in post), reverse=True)
    graph = hnsw.build(ents.where("not deleted").select("id", "vector"), 3, 1)
    via = search.search_hybrid(request(spark, top_k=12, index_type="hnsw"), ents, dim=3, graph=graph).collect()
    assert {r.id for r in via} & {r.id for r in post}


def test_pre_ranks_what_a_request_admits_without_rows_of_pairs(spark):
    """Both channels of many requests against brute force; before, every pair of a request and an entity was a row of a join."""
    from siftspark.operators.search import _ranked_after_filter

    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    schema = "id bigint, collection string, modality string, vector array<float>, scalar map<string,string>, source_ref string, content string, doc_id string, caption string, tags array<string>"
    rows = []
    for i in range(400):
        v = None if i % 17 == 0 else [float(x) for x in rng.integers(-2, 3, 3 if i % 5 else 2)]
        rows.append((i, f"c{i % 3}" if i % 11 else None, ["text", "image"][i % 4 == 0], v, None, "s", " ".join(rng.choice(words, 4)), f"d{i}", None, ["a"] if i % 2 else None))
    ents = spark.createDataFrame(rows, schema).repartition(7).cache()
    asks = []
    texts = ["", 'tag == "a"', "nonsense", "score > 0.02"]
    for q in range(120):
        v = None if q % 13 == 0 else [float(x) for x in rng.integers(-2, 3, 3 if q % 7 else 2)]
        asks.append((q, f"c{q % 4}", [None, "text", "image"][q % 3], texts[q % 4], ["cosine", "l2"][q % 2], v, " ".join(rng.choice(words, q % 3)), 3 + q % 9))
    req = spark.createDataFrame(asks, "qid bigint, collection string, modality string, filter string, metric string, vector array<double>, query string, pool int")
    vec, key = _ranked_after_filter(req, req.where("vector is not null"), ents, texts)
    got = [sorted((r.qid, r["rank"], r.id) for r in df.collect() if r["rank"] <= asks[r.qid][7]) for df in (vec, key)]
    scores = bm25.bm25_scores(bm25.document_terms(ents, "id", F.col("content")), req.select("qid", "query"))
    scores = {(r.qid, r.id): round(r.score, 6) for r in scores.collect()}
    want = [[], []]
    for q, col, mod, text, metric, v, _, pool in asks:
        ok = [r for r in rows if r[1] == col and mod in (None, r[2]) and text != "nonsense" and ("tag" not in text or r[9])]
        far = lambda a: math.dist(a, v) if metric == "l2" else 1 - float(np.dot(a, v))
        near = sorted((round(far(r[3]), 6), r[0]) for r in ok if v and r[3] and len(r[3]) == len(v))
        best = sorted((-scores[q, r[0]], r[0]) for r in ok if (q, r[0]) in scores)
        for out, found in zip(want, (near, best)):
            out += [(q, i + 1, f[1]) for i, f in enumerate(found[:pool])]
    assert got == [sorted(w) for w in want] and all(got)


def test_text_for_images_uses_keywords_only(spark):
    hits = search.search_hybrid(request(spark, modality="image", collection="other"), entities(spark), dim=3).collect()
    assert hits and all(r.vec_rank == 0 and r.modality == "image" and r.score == round(r.rrf, 6) for r in hits)
    hits = search.search_hybrid(request(spark, modality="image", collection="other", query=""), entities(spark), dim=3).collect()
    assert hits and all(r.key_rank == 0 and r.vec_rank > 0 for r in hits)


def test_filters_after_ranking(spark):
    hits = search.search_hybrid(request(spark, filter="tag == 'x' and score > 0.001"), entities(spark), dim=3).collect()
    assert hits and all("x" in r.tags for r in hits)
    assert search.search_hybrid(request(spark, filter="broken ="), entities(spark), dim=3).count() == 0


def test_evidence(spark):
    hits = spark.createDataFrame([(1, 1, "Alpha beta. Gamma alpha!")], "qid bigint, id bigint, content string")
    terms = spark.createDataFrame([(1, [("alpha", 0, 5), ("beta", 6, 10), ("gamma", 12, 17), ("alpha", 18, 23)])], "id bigint, terms array<struct<term:string,start:int,end:int>>")
    req = spark.createDataFrame([(1, "beta alpha beta")], "qid bigint, query string")
    got = sorted((r.ord, r.start, r.end) for r in search.term_evidence(hits, terms, req).collect())
    assert got == [(1, 6, 10), (2, 0, 5), (3, 18, 23)]
    from siftspark.functions.embed import HashEmbedder

    q = search.with_query_vectors(req.withColumn("query", F.lit("gamma")), HashEmbedder(64)).withColumn("metric", F.lit("cosine"))
    s = search.sentence_evidence(hits, q, 64).first()
    assert (s.start, s.end) == (11, 24)
    assert search.highlight("a中b", [(1, 4), (2, 5), (9, 12)]) == "a<mark>中</mark>b"
    p = spark.createDataFrame([([([0.1], [1.0, 0.0]), ([0.2], [0.0, 1.0]), ([0.3], [1.0, 0.0]), ([0.4], [0.6, 0.8])],)], "p array<struct<bbox:array<double>,vector:array<float>>>")
    best = p.select(search.patch_evidence(F.col("p"), F.array(F.lit(1.0), F.lit(0.0)), F.lit("cosine")).alias("x")).first().x
    assert [b.bbox for b in best] == [[0.1], [0.3], [0.4]]
    names = spark.range(1).select(search.channel_names(F.lit(True), F.lit(True)).alias("a"), search.channel_names(F.lit(False), F.lit(True)).alias("b")).first()
    assert names.a == ["vector", "keyword", "rrf"] and names.b == ["keyword"]


def test_settings(monkeypatch):
    assert EngineConfig().rrf_k == 60
    with pytest.raises(ValueError):
        EngineConfig(patch_grid=9)
    monkeypatch.setenv("SIFTSPARK_HNSW_M", "many")
    with pytest.raises(ValueError):
        EngineConfig.from_env()


def test_plan_shapes(spark, vectors):
    _, df = vectors
    q = spark.createDataFrame([(0, [0.1] * 16)], "qid bigint, vector array<double>")
    plan = knn.flat_top_k(q, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    docs = bm25.document_terms(spark.createDataFrame([(1, "a b")], "k bigint, s string"), "k", F.col("s"))
    plan = bm25.bm25_scores(docs, spark.createDataFrame([(1, "b")], "qid bigint, query string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_recall_of_an_empty_truth(spark):
    from siftspark.operators import fusion

    truth = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "qid long, id long, rank int")
    asked = spark.createDataFrame([(1,), (2,)], "qid long")
    got = {r.qid: r.recall for r in fusion.recall_at_k(truth, truth.where("rank = 1"), 10, asked).collect()}
    assert got == {1: 0.5, 2: 1.0} and fusion.recall_at_k(truth, truth, 0, asked).count() == 2


def test_euclid_keeps_digits_of_near_vectors():
    import numpy as np

    from siftspark.operators import knn

    r = np.random.default_rng(3)
    q, v = r.standard_normal((5, 16)) * 100, r.standard_normal((40, 16)) * 100
    v[:5] = q + 1e-5 * r.standard_normal((5, 16))
    v[5] = q[0]
    want = np.sqrt(((q[:, None] - v[None]) ** 2).sum(axis=2))
    got = knn._euclid(q, v, q @ v.T)
    assert np.allclose(got, want, rtol=1e-8, atol=1e-12) and got[0, 5] == 0
