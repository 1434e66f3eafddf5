"""Hybrid search over entities for a batch of requests: channels, fusion, filters, projection, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import vector as V
from ..functions.embed import Embedder, embed_sentences
from ..functions.text import search_text, terms
from ..session import release, scratch
from . import admitted, bm25, filters, fusion, hnsw, knn
from .live import top_k


def similarity_by(metric: Column, a: Column, b: Column) -> Column:
    return F.when(metric == "l2", V.similarity(a, b, "l2")).otherwise(V.similarity(a, b))


def pool_size(top: Column, config: EngineConfig) -> Column:
    return F.greatest(top * config.pool_factor, F.lit(config.pool_least))


def search_hybrid(
    requests: DataFrame,
    entities: DataFrame,
    config: EngineConfig = EngineConfig(),
    dim: int | None = None,
    graph: DataFrame | None = None,
    fresh: DataFrame | None = None,
    filter_mode: str = "post",
    cross_modal: bool = False,
    stats_include_deleted: bool = True,
) -> DataFrame:
    """The hits of every request: qid, position, id, score, rrf, ranks and scores of both channels, and the entity's fields.

    ``requests``: as normalize_requests gives them, and optionally ``vector``. ``entities``: one row an id, with
    ``deleted``. Requests with an error have no hits. Each channel gives its best max(32, 4 top_k); then deleted
    entities, other collections and modalities and what the filter refuses are left out, so a request may get
    fewer hits than there are (``filter_mode`` "post"); with "pre" all but a score's condition is asked before
    the channels are ranked. A text request for images uses the keyword channel only, unless ``cross_modal``.
    ``graph``: an HNSW graph for requests with index_type hnsw; without it all are exact. ``fresh`` (id): entities written
    after the graph was built, which are searched exactly beside it. ``channels`` names what a request asked.
    score: similarity of request and entity where both have comparable vectors, else rrf. Order: rrf, then id.
    """
    req = requests.where("error is null") if "error" in requests.columns else requests
    if "vector" not in req.columns:
        req = req.withColumn("vector", F.lit(None).cast("array<float>"))
    req = req.withColumn("pool", pool_size(F.col("top_k"), config))
    gone = F.coalesce(F.col("deleted"), F.lit(False))
    by_vector = req.where(F.col("vector").isNotNull())
    if not cross_modal:  # a text is no query for images
        by_vector = by_vector.where((F.coalesce("modality", F.lit("")) != "image") | (F.col("query") == ""))
    texts = [r["filter"] for r in req.select("filter").distinct().collect()]  # different filters of the batch
    if filter_mode == "pre":
        vec, key = _ranked_after_filter(req, by_vector, entities.where(~gone), texts)
    else:
        most = req.agg(F.max("pool")).first()[0] or config.pool_least  # the largest pool of the batch; each request keeps its own
        live = entities.where(~gone).select("id", "vector")
        asks = by_vector.select("qid", "vector", "metric", F.col("pool").alias("k"), "index_type")
        if graph is None:
            vec = knn.flat_top_k(asks, live, most, dim=dim)
        else:
            params = hnsw.HnswParams(config.hnsw_m, config.hnsw_ef_construction, config.hnsw_ef_search)
            # The graph holds unit vectors and finds by cosine; other metrics are exact.
            by_graph = (F.col("index_type") == "hnsw") & (F.col("metric") == "cosine")
            vec = knn.flat_top_k(asks.where(~by_graph), live, most, dim=dim)
            near = hnsw.search(graph, asks.where(by_graph), most, params=params).join(live.select("id"), "id", "left_semi")
            if fresh is not None:
                near = near.join(fresh.select("id"), "id", "left_anti")
                new = knn.flat_top_k(asks.where(by_graph), live.join(fresh.select("id"), "id", "left_semi"), most, dim=dim)
                near = near.unionByName(new)
            vec = vec.unionByName(fusion.assign_ranks(near.drop("rank"), "qid", [F.asc("dist"), F.asc("id")]).select(*vec.columns))
        docs = scratch(bm25.document_terms(entities, "id", search_text(F.col("content"), F.col("caption"), F.col("tags"))), "terms")
        key = bm25.bm25_top_k(docs, req.select("qid", "query", F.col("pool").alias("k")), most, deleted=entities.where(gone).select("id"), stats_include_deleted=stats_include_deleted, k1=config.bm25_k1, b=config.bm25_b)
    pools = req.select("qid", "pool")
    cut = lambda df, c: df.join(pools, "qid").where(F.col("rank") <= F.col("pool")).select("qid", "id", "rank", F.col(c).alias("score"))
    fused = fusion.rrf_fuse(cut(vec, "dist"), cut(key, "score"), req.select("qid", "rrf_k", "vector_weight", "keyword_weight"))
    fused = fused.withColumn("rrf", F.round("rrf", 9))
    uses = channel_names(F.col("vector").isNotNull() & ((F.coalesce("modality", F.lit("")) != "image") | (F.col("query") == "") | F.lit(cross_modal)), F.col("query") != "")
    ask = req.select("qid", F.col("collection").alias("_col"), F.col("modality").alias("_mod"), F.col("filter").alias("_filter"), "top_k", "metric", F.col("vector").alias("_qv"), F.col("query").alias("_query"), uses.alias("channels"))
    # Only what decides goes into the first join; texts and vectors come to the hits that are left.
    narrow = [c for c in ("id", "collection", "modality", "tags", "scalar", "caption", "doc_id", "source_ref") if c in entities.columns]
    hits = fused.join(ask.drop("_qv", "_query", "channels"), "qid").join(entities.where(~gone).select(*narrow), "id")
    hits = hits.where((F.col("collection") == F.col("_col")) & (F.col("_mod").isNull() | (F.col("_mod") == F.col("modality"))))
    hits = hits.where(filters.per_request(texts, "_filter"))
    order = Window.partitionBy("qid").orderBy(F.desc("rrf"), F.asc("id"))
    hits = hits.withColumn("position", F.row_number().over(order)).where(F.col("position") <= F.col("top_k")).select(*fused.columns, "position")
    hits = hits.join(ask, "qid").join(entities.drop("deleted"), "id")
    spaces_differ = (F.col("modality") == "image") & (F.col("_query") != "") & F.lit(not cross_modal)
    both = F.col("_qv").isNotNull() & (F.size("vector") == F.size("_qv")) & ~spaces_differ
    score = F.when(both, similarity_by(F.col("metric"), F.col("_qv"), F.col("vector"))).otherwise(F.col("rrf"))
    return hits.select(
        "qid", "position", "id", F.round(score, 6).alias("score"), "rrf", "vec_rank", "key_rank", "vec_score", "key_score",
        "collection", "modality", "source_ref", "content", "caption", "tags", F.coalesce(F.try_element_at("scalar", F.lit("title")), F.lit("")).alias("title"),
        F.when(F.coalesce("content_hash", F.lit("")) != "", F.concat(F.lit("/assets/"), "content_hash")).alias("asset"), "channels",
    )


def _ranked_after_filter(req: DataFrame, by_vector: DataFrame, live: DataFrame, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both channels ranked among the entities that a request admits, as far as its pool goes; compared by collection, so no pair is a row."""
    most = req.agg(F.max("pool")).first()[0] or 1
    texts = [t for t in texts if t is not None and "score" not in t.lower()]
    fields = [c for c in ("id", "vector", "collection", "modality", "tags", "scalar", "caption", "content", "doc_id", "source_ref") if c in live.columns]
    rows = admitted.prepared(live.select(*fields), texts, search_text(F.col("content"), F.col("caption"), F.col("tags")))
    ask = lambda df: df.withColumn("k", F.col("pool"))
    vec, key = scratch(admitted.nearest(ask(by_vector), rows, texts, most), "near"), scratch(admitted.best_scores(ask(req), rows, texts, most), "scored")
    release(rows)  # as large as the entities, and nothing reads it again
    return vec, key


def with_query_vectors(requests: DataFrame, embedder: Embedder) -> DataFrame:
    """Requests with the vector of their query; a blank query has none."""
    return requests.withColumn("vector", F.when(F.trim("query") != "", embedder.embed(F.col("query"))))


def compare_flat(requests: DataFrame, hits: DataFrame, entities: DataFrame, k: int, dim: int | None = None) -> DataFrame:
    """(qid, recall) of the hits against the k exact nearest of the request's vector, whatever collection or modality."""
    live = entities.where(~F.coalesce(F.col("deleted"), F.lit(False))).select("id", "vector")
    truth = knn.flat_top_k(requests.select("qid", "vector", "metric"), live, k, dim=dim)
    return fusion.recall_at_k(truth, hits.select("qid", "id", F.col("position").alias("rank")), k)


def channel_names(has_vector: Column, has_query: Column) -> Column:
    v, k = F.when(has_vector, F.array(F.lit("vector"))).otherwise(F.array().cast("array<string>")), F.when(has_query, F.array(F.lit("keyword"))).otherwise(F.array().cast("array<string>"))
    return F.concat(v, k, F.when(has_vector & has_query, F.array(F.lit("rrf"))).otherwise(F.array().cast("array<string>")))


def term_evidence(hits: DataFrame, entities: DataFrame, requests: DataFrame) -> DataFrame:
    """(qid, id, ord, start, end): the places of the query's terms in each hit, once each, by query order, then place.

    ``entities`` has ``terms`` with byte offsets. Hits without a place have no rows.
    """
    asked = requests.select("qid", F.posexplode(terms(F.col("query"))).alias("q", "term")).groupBy("qid", "term").agg(F.min("q").alias("q"))
    places = hits.select("qid", "id").join(entities.select("id", "terms"), "id").select("qid", "id", F.posexplode("terms").alias("p", "t"))
    own = places.select("qid", "id", "p", F.col("t.term").alias("term"), F.col("t.start").alias("start"), F.col("t.end").alias("end")).join(asked, ["qid", "term"])
    once = own.groupBy("qid", "id", "start", "end").agg(F.min(F.struct("q", "p")).alias("o"))
    w = Window.partitionBy("qid", "id").orderBy("o", "start", "end")
    return once.withColumn("ord", F.row_number().over(w)).select("qid", "id", "ord", "start", "end")


def sentence_evidence(hits: DataFrame, requests: DataFrame, dim: int = 1024) -> DataFrame:
    """(qid, id, start, end, score) of the sentence of each hit's content most similar to the request's vector; the first of equals."""
    cut = hits.where(F.coalesce("content", F.lit("")) != "").select("qid", "id", embed_sentences(F.col("content"), dim).alias("s"))
    each = cut.select("qid", "id", F.posexplode("s").alias("i", "s")).join(requests.select("qid", "vector", "metric"), "qid")
    each = each.withColumn("score", F.round(similarity_by(F.col("metric"), F.col("vector"), F.col("s.vector")), 6)).where("score > -1")
    best = top_k(each, ["qid", "id"], [F.desc("score"), F.asc("i")], 1)
    return best.select("qid", "id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "score")


def with_evidence(hits: DataFrame, entities: DataFrame, requests: DataFrame, dim: int = 1024) -> DataFrame:
    """Hits with ``term_places`` (start, end of the query's terms), ``sentence`` (start, end, score of the best one) and ``patches``
    (score, bbox of the best of an image asked by an image), each null or empty where there is none.

    ``entities`` has terms, and sentences and patches if it may; ``requests`` the vectors.
    """
    have = set(entities.columns)
    hits = scratch(hits, "hits")  # the search itself runs once
    places = term_evidence(hits, entities, requests).groupBy("qid", "id").agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end"))).alias("p"))  # of one hit
    places = places.select("qid", "id", F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("term_places"))
    out = hits.join(places, ["qid", "id"], "left").withColumn("term_places", F.coalesce("term_places", F.array().cast("array<struct<start:int,end:int>>")))
    extra = [c for c in ("sentences", "patches") if c in have]
    ask = requests.select("qid", F.col("vector").alias("_qv"), F.col("metric").alias("_metric"), F.col("query").alias("_q"))
    wide = out.join(entities.select("id", *[F.col(c).alias(f"_{c}") for c in extra]), "id", "left").join(ask, "qid", "left")
    same = lambda v: F.col("_qv").isNotNull() & (F.size(v) == F.size("_qv"))
    if "sentences" in have:
        scored = F.transform(
            F.filter("_sentences", lambda x: same(x["vector"])),
            lambda x, i: F.struct(F.round(similarity_by(F.col("_metric"), F.col("_qv"), x["vector"]), 6).alias("score"), (-i).alias("i"), x["start"].alias("start"), x["end"].alias("end")),
        )
        best = F.array_max(F.filter(scored, lambda x: x["score"] > -1))
        sentence = F.when(F.col("modality") == "text", F.when(best.isNotNull(), F.struct(best["start"].alias("start"), best["end"].alias("end"), best["score"].alias("score"))))
    else:
        sentence = F.lit(None).cast("struct<start:int,end:int,score:double>")
    if "patches" in have:
        asked = (F.col("modality") == "image") & (F.col("_q") == "") & F.col("_qv").isNotNull() & F.col("_patches").isNotNull()
        patches = F.when(asked, patch_evidence(F.filter("_patches", lambda p: same(p["vector"])), F.col("_qv"), F.col("_metric")))
    else:
        patches = F.lit(None).cast("array<struct<score:double,bbox:array<double>>>")
    return wide.select(*out.columns, sentence.alias("sentence"), patches.alias("patches"))


def patch_evidence(patches: Column, query: Column, metric: Column, most: int = 3, least: float = 0.05) -> Column:
    """array of (score, bbox) of the best patches: of the first three those of at least 0.05, equals in grid order."""
    scored = F.transform(patches, lambda p, i: F.struct((-similarity_by(metric, query, p["vector"])).alias("s"), i.alias("i"), p["bbox"].alias("bbox")))
    first = F.slice(F.sort_array(scored), 1, most)
    return F.transform(F.filter(first, lambda x: -x["s"] >= least), lambda x: F.struct((-x["s"]).alias("score"), x["bbox"].alias("bbox")))


def highlight(text: str, ranges: list[tuple[int, int]], mark=("<mark>", "</mark>")) -> str:
    """The text with its ranges (bytes) marked: by start, overlapping and outlying ones left out."""
    raw = text.encode()
    out, at = [], 0
    for a, b in sorted(ranges):
        if a < at or b > len(raw) or a >= b:
            continue
        out += [raw[at:a].decode("utf-8", "replace"), mark[0], raw[a:b].decode("utf-8", "replace"), mark[1]]
        at = b
    return "".join([*out, raw[at:].decode("utf-8", "replace")])
