"""The queries over the given tables: one for each operator, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..engine import Engine
from ..functions import embed, text, vector as V
from ..functions.image import image_features
from ..operators import bm25, changefeed, cost, evalrecall, filters, fusion, hnsw, knn, live, rag, search, segments, stats
from ..session import scratch, scratch_path
from ..sources import seed, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIM = 64  # of the test tables' vectors


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files give fewer partitions than there are; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


FIELDS = ["collection", "modality", "content", "caption", "tags", "scalar", "doc_id", "source_ref", "content_hash"]


def current(spark: SparkSession, sf_dir: str, cols: list) -> DataFrame:
    """One row an id, deleted ones too."""
    return live.current_rows(table(spark, sf_dir, "entities"), cols)


def unit_vector() -> F.Column:
    v = F.col("vector")
    return F.when(live.usable_vector(v, DIM), V.normalize(v)).alias("vector")


# --- change feed -------------------------------------------------------------------------------


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities left after all changes, each with the change that made its state."""
    return changefeed.apply_changes(table(spark, sf_dir, "oplog"))


@query
def p3_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt entities themselves."""
    return changefeed.final_state(table(spark, sf_dir, "oplog")).withColumn("tags", F.array_join("tags", ","))


@query
def p3_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain fields of the rebuilt entities."""
    title = F.try_element_at("scalar", F.lit("title")).alias("title")
    return changefeed.final_state(table(spark, sf_dir, "oplog")).select("id", "seq", "collection", "modality", "content", "doc_id", "chunk_index", "caption", "content_hash", "mime", "width", F.array_join("tags", ",").alias("tags"), title)


@query
def oplog_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery in order of arrival: the last operation on an id decides."""
    log = changefeed.parse_changes(table(spark, sf_dir, "oplog")).select("id", "seq", F.when(F.col("gone"), "delete").otherwise("upsert").alias("op"))
    return live.latest_wins(log).select("id", "seq")


# --- text --------------------------------------------------------------------------------------


@query
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where("text is not null").select("doc_id", F.array_join(text.terms(F.col("text")), " ").alias("terms"))


@query
def distinct_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "requests").select("qid", F.explode(text.distinct_terms(F.col("query"))).alias("term"))


@query
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bm25.document_terms(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return bm25.document_frequencies(bm25.postings(docs))


@query
def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every current record's content with their byte offsets."""
    rows = current(spark, sf_dir, ["content"]).where("content is not null")
    return rows.select("id", F.explode(text.tokenize(F.col("content"))).alias("t")).select("id", "t.term", "t.start", "t.end")


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_table(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """char_offset of the entities' chunks, from their rows."""
    rows = current(spark, sf_dir, ["modality", "doc_id", "chunk_index", "content"]).where("modality = 'text' and not deleted")
    return text.char_offsets(rows, "doc_id", "chunk_index", "content").select("id", F.col("char_offset").cast("long").alias("char_offset"))


@query
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.end", "s.text")


@query
def fnv_hash_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "requests").select(F.explode(text.terms(F.col("query"))).alias("term")).distinct()
    return terms.select("term", embed.hash_fnv(F.concat(F.lit("t:"), "term")).alias("hash"))


@query
def hash_embed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = table(spark, sf_dir, "requests").select("qid", F.posexplode(embed.hash_embed(F.col("query"), DIM, "double")).alias("slot", "value"))
    return req.withColumn("value", F.round("value", 6)).where("value <> 0")


@query
def parse_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("csv", F.concat_ws(" ,", "tags"))
    return docs.select("doc_id", F.array_join(text.parse_tags(F.col("csv")), "|").alias("tags"), text.first_tag(text.parse_tags(F.col("csv"))).alias("first"))


@query
def answer_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.answer_excerpt(F.col("text")).alias("excerpt"))


# --- vectors -----------------------------------------------------------------------------------


@query
def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dot, Euclid, distance and similarity of each embedding and the next."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    n = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    a, b = F.col("a"), F.col("b")
    return e.join(n, "vec_id").select(
        "vec_id", F.round(V.dot(a, b), 6).alias("dot"), F.round(V.l2(a, b), 6).alias("l2"), F.round(V.distance(a, b), 6).alias("cosine_distance"),
        F.round(V.similarity(a, b, "l2"), 6).alias("l2_similarity"),
    )


@query
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current(spark, sf_dir, ["vector"]).where(live.usable_vector(F.col("vector"), DIM) & ~F.col("deleted"))
    return rows.select("id", F.posexplode(V.normalize(F.col("vector"))).alias("slot", "value")).withColumn("value", F.round("value", 6))


@query
def vector_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(V.pad_or_trim(F.col("embedding"), 100)).alias("slot", "value")).withColumn("value", F.round("value", 6))


@query
def vector_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir, ["vector"]).select("id", V.valid(F.col("vector"), DIM).alias("valid"))


# --- nearest neighbours ------------------------------------------------------------------------


def _embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e.where("id % 20 = 0").withColumnRenamed("id", "qid"), e


def _flat(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, e = _embeddings(spark, sf_dir)
        return knn.flat_top_k(q, e, 10, metric)

    return run


QUERIES["flat_topk_cosine"] = _flat("cosine")
QUERIES["flat_topk_l2"] = _flat("l2")


@query
def flat_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from built-in expressions alone."""
    q, e = _embeddings(spark, sf_dir)
    return knn.flat_native(q, e, 10)


@query
def flat_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = _embeddings(spark, sf_dir)
    return knn.flat_serial(q, e, 10)


@query
def flat_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each request the nearest live entities to the entity of its number, by the request's metric."""
    ents = scratch(current(spark, sf_dir, [unit_vector()]).where("not deleted and vector is not null"), "vectors")
    q = table(spark, sf_dir, "requests").select(F.col("qid").alias("id"), "metric").join(ents, "id").select(F.col("id").alias("qid"), "vector", "metric")
    return knn.flat_top_k(q, ents, 10, dim=DIM)


@query
def hnsw_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph index's answers; its recall is a query of its own."""
    q, e = _embeddings(spark, sf_dir)
    return hnsw.search(hnsw.build(e, DIM, 4), q, 10)


@query
def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = _embeddings(spark, sf_dir)
    return fusion.recall_at_k(knn.flat_top_k(q, e, 10), hnsw.search(hnsw.build(e, DIM, 4), q, 10), 10)


# --- keywords, fusion, search ------------------------------------------------------------------


def _documents(ents: DataFrame) -> DataFrame:
    return scratch(bm25.document_terms(ents, "id", text.search_text(F.col("content"), F.col("caption"), F.col("tags"))), "terms")


def _bm25(spark: SparkSession, sf_dir: str, with_deleted: bool) -> DataFrame:
    ents = current(spark, sf_dir, ["content", "caption", "tags"])
    return bm25.bm25_top_k(_documents(ents), table(spark, sf_dir, "requests"), 10, deleted=ents.where("deleted").select("id"), stats_include_deleted=with_deleted)


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best live entities of each request; statistics count deleted ones."""
    return _bm25(spark, sf_dir, True)


@query
def bm25_live_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, False)


@query
def normalize_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.normalize_requests(table(spark, sf_dir, "requests"), table(spark, sf_dir, "collections"))


def _channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, sf_dir, "fused").where("qid is not null and id is not null")
    pick = lambda r, s: f.where(F.col(r) > 0).groupBy("qid", "id").agg(F.min(r).alias("rank"), F.max(s).alias("score"))
    return pick("vec_rank", "vec_score"), pick("key_rank", "key_score")


@query
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels' ranks fused anew, by each request's constant and weights."""
    vec, key = _channels(spark, sf_dir)
    out = fusion.rrf_fuse(vec, key, table(spark, sf_dir, "requests"))
    return out.select("qid", "id", F.round("rrf", 9).alias("rrf"), "vec_rank", "key_rank")


@query
def rrf_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec, key = _channels(spark, sf_dir)
    fused = fusion.rrf_fuse(vec, key).withColumn("rrf", F.round("rrf", 9))
    return live.top_k(fused, ["qid"], [F.desc("rrf"), F.asc("id")], 12).select("qid", "id", "rank", "rrf")


@query
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the first ten by keyword are among the first ten by vector."""
    vec, key = _channels(spark, sf_dir)
    return fusion.recall_at_k(key, vec, 10).withColumn("recall", F.round("recall", 6))


def _requests(spark: SparkSession, sf_dir: str, ents: DataFrame) -> DataFrame:
    """Requests with the vector of the entity of their number, if it lives and has one."""
    own = ents.where("not deleted and vector is not null").select(F.col("id").alias("qid"), "vector")
    return fusion.normalize_requests(table(spark, sf_dir, "requests"), table(spark, sf_dir, "collections")).join(own, "qid", "left")


def _hybrid(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    ents = scratch(current(spark, sf_dir, [unit_vector(), *FIELDS]), "entities")
    hits = search.search_hybrid(_requests(spark, sf_dir, ents), ents, dim=DIM, filter_mode=mode)
    return hits.select("qid", "position", "id", "score", "rrf", "vec_rank", "key_rank", "title")


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels, fused, filtered after ranking."""
    return _hybrid(spark, sf_dir, "post")


@query
def hybrid_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with filters before ranking."""
    return _hybrid(spark, sf_dir, "pre")


@query
def compare_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of hybrid hits against the exact nearest of the request's vector."""
    ents = scratch(current(spark, sf_dir, [unit_vector(), *FIELDS]), "entities")
    req = _requests(spark, sf_dir, ents)
    hits = search.search_hybrid(req, ents, dim=DIM)
    return search.compare_flat(req, hits, ents, 12, DIM).withColumn("recall", F.round("recall", 6))


@query
def term_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents = table(spark, sf_dir, "entities")
    terms = live.current_rows(ents, ["terms"])
    return search.term_evidence(_bm25(spark, sf_dir, True), terms, table(spark, sf_dir, "requests"))


@query
def sentence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sentence of each keyword hit by hash embedding."""
    ents = current(spark, sf_dir, ["content"])
    hits = _bm25(spark, sf_dir, True).join(ents.select("id", "content"), "id")
    req = search.with_query_vectors(table(spark, sf_dir, "requests"), embed.HashEmbedder(256))
    return search.sentence_evidence(hits, req.withColumn("metric", F.lit("cosine")), 256)


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.coalesce(F.try_element_at("scalar", F.lit("title")), F.lit("")).alias("title")
    ents = live.current_rows(table(spark, sf_dir, "entities"), ["content", "caption", title])
    hits = _bm25(spark, sf_dir, True).where("rank <= 6").withColumnRenamed("rank", "position").join(ents, "id")
    return rag.citations(hits)


@query
def rag_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _citations(spark, sf_dir)


@query
def rag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.answers(table(spark, sf_dir, "requests").select("qid", "query"), _citations(spark, sf_dir))


@query
def rag_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers' token events, counted by kind."""
    events = rag.token_stream(rag_answer(spark, sf_dir))
    return events.groupBy("qid", "event").agg(F.count("*").alias("n"), F.max("seq").cast("long").alias("last"))


# --- filters -----------------------------------------------------------------------------------

FILTERS = {
    "filter_tag": 'tag == "rag"',
    "filter_tag_not": "tags != 'rag'",
    "filter_tag_contains": 'tags > "stor"',
    "filter_caption": 'caption >= "memory" or caption < "日志"',
    "filter_modality": 'MODALITY == "Image"',
    "filter_collection": 'collection == "handbook" && modality != "image"',
    "filter_doc": "doc_id > '1719446'",
    "filter_source": 'source_ref > "handbook" OR source_ref > "gallery"',
    "filter_nested": '(tag == "rag" || tag == "storage") and (collection == "handbook" or modality == "image") and tag != "zh"',
    "filter_blank": "  ",
}


def _filter(expression: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return current(spark, sf_dir, FIELDS).where("not deleted").where(filters.filter_column(expression)).select("id")

    return run


for _name, _text in FILTERS.items():
    QUERIES[_name] = _filter(_text)


@query
def filter_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = table(spark, sf_dir, "fused").select("qid", "id", "rrf").distinct()
    return fused.where(filters.filter_column("score >= 0.03 and score < 0.05"))


# --- tables, segments, statistics --------------------------------------------------------------


@query
def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "collections").select("name", "dim", "metric", "index_type")


@query
def create_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.create_collection(table(spark, sf_dir, "collections"), "new shelf", 0, "other", "other", DIM, "2025-01-01 00:00:00")
    return out.select("name", "dim", "metric", "index_type")


@query
def current_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir, ["collection", "modality", "source_ref"])


@query
def drop_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents = current(spark, sf_dir, ["collection"])
    _, after = segments.drop_collection(table(spark, sf_dir, "collections"), ents, "handbook")
    return after.groupBy("collection").agg(F.count_if(~F.col("deleted")).alias("live"), F.count("*").alias("all"))


@query
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.compact(table(spark, sf_dir, "entities"), ["collection", "modality", "content", "caption", "tags"]).withColumn("tags", F.array_join("tags", ","))


@query
def compact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents = table(spark, sf_dir, "entities")
    size = segments.row_bytes(F.col("vector"), F.col("content"), F.col("caption"), F.col("content_hash"))
    return segments.compaction_summary(ents, segments.compact(ents, ["vector", "content", "caption", "content_hash"]), size)


@query
def segment_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = segments.row_bytes(F.col("vector"), F.col("content"), F.col("caption"), F.col("content_hash"))
    ents = table(spark, sf_dir, "entities").withColumn("bytes", size).withColumn("segment", F.lit(0))
    return segments.segment_stats(ents, "collection", "created_at", "bytes")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "oplog").withColumn("bytes", F.coalesce(F.octet_length("payload"), F.lit(0)) + 17)


@query
def seal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = segments.seal_by_rows(_log(spark, sf_dir), "log_file", "seq", 100)
    return segments.segment_stats(sealed, "log_file", "ts", "bytes")


@query
def seal_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = segments.seal_by_idle(_log(spark, sf_dir), "log_file", "ts", "seq", 3_600_000)
    return segments.segment_stats(sealed, "log_file", "ts", "bytes")


@query
def seal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, rows and idle time together."""
    return segments.seal(_log(spark, sf_dir), "log_file", "ts", "seq", "bytes", 4096, 25, 36_000_000)


@query
def live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.live_counts(current(spark, sf_dir, ["vector"]), table(spark, sf_dir, "collections"))


@query
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latency(table(spark, sf_dir, "events"), "value", ["event_type"], ["event_id"])


@query
def latency_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantile_by_rank(table(spark, sf_dir, "events"), "value", ["event_type"], 0.99, "p99")


@query
def query_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.rate(table(spark, sf_dir, "events"), "ts", ["event_type"])
    return out.select("event_type", "n", F.round("qps", 9).alias("qps"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("cny"))


@query
def cost_spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.spent(_ledger(spark, sf_dir)).withColumn("spent", F.round("spent", 2))


@query
def budget_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cost.breaker(_ledger(spark, sf_dir), 300.0, ["user_id"], ["event_id"])
    return out.select("event_id", "user_id", F.round("before", 4).alias("before"), "open")


# --- ingestion and the engine -------------------------------------------------------------------


@query
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that all documents become."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id"))
    out = tables.ingest_documents(docs, table(spark, sf_dir, "collections"), embed.HashEmbedder(DIM), sentence_vectors=False)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "chunk_index", "char_offset", "collection", "content", F.size("vector").alias("dim"))


@query
def rejected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.rejected_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "collections")).select("doc_id", F.col("error").cast("int").alias("error"))


@query
def engine_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written by one engine and read by another over the same folder, after a delete and a compaction."""
    path = scratch_path(spark, "engine")
    one = Engine(spark, path, EngineConfig(dim=DIM))
    docs = table(spark, sf_dir, "documents").drop("collection")
    one.ingest_documents(docs)
    one.flush()
    third = F.col("doc_id").cast("long") % 3 == 0
    one.delete(one.entities(["doc_id"]).where(third).select("id"))
    one.flush()
    two = Engine(spark, path, EngineConfig(dim=DIM))
    before = two.entities([]).agg(F.count("*").alias("rows"), F.count_if("deleted").alias("deleted"))
    before = scratch(before, "before")
    two.compact()
    after = Engine(spark, path, EngineConfig(dim=DIM)).entities([]).agg(F.count("*").alias("compacted"), F.max("id").alias("last_id"))
    return before.crossJoin(after)  # one row each


@query
def get_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live entities that requests name by their number."""
    ids = table(spark, sf_dir, "requests").select(F.col("qid").alias("id")).distinct()
    return current(spark, sf_dir, ["collection", "modality"]).where("not deleted").join(ids, "id", "left_semi").select("id", "collection", "modality")


@query
def hash_embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(embed.hash_embed(F.col("text"), DIM, "double")).alias("slot", "value"))
    return docs.withColumn("value", F.round("value", 5)).where("abs(value) >= 0.00002")


@query
def image_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour bin of a plain image of each nation's colour, from its descriptor."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    channel = lambda m: F.lpad(F.hex((F.col("k") * m) % 256), 2, "0")
    data = F.unhex(F.repeat(F.concat(channel(91), channel(53), channel(37)), 24 * 16))  # blue, green, red
    image = F.struct(F.lit("").alias("origin"), F.lit(16).alias("height"), F.lit(24).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))
    px = n.select("k", image_features(image, 1024).alias("f"))
    bins = F.slice("f.vector", 1, 256)
    return px.select("k", (F.array_position(bins, F.array_max(bins)) - 1).cast("int").alias("bin"), F.size(F.filter(bins, lambda x: x > 0)).alias("bins"), F.col("f.width").alias("width"), F.size("f.patches").alias("patches"))


@query
def image_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The painted images as entities: size, type, patches, unit length; the folder's file that is no image is left out."""
    files = seed.image_files(spark, scratch_path(spark, "images"))
    out = tables.ingest_images(spark, files)
    norm = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 4)
    return out.select(F.regexp_extract("source_ref", r"([a-z]+)\.png$", 1).alias("name"), "width", "height", "mime", F.size("patches").alias("patches"), norm.alias("norm"))


@query
def patch_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best quarters of each live image's vector, asked by its own first quarter."""
    rows = current(spark, sf_dir, ["modality", unit_vector()]).where("not deleted and modality = 'image' and vector is not null")
    part = lambda i: F.slice("vector", i * 16 + 1, 16)
    patches = F.array(*[F.struct(part(i).alias("vector"), F.array(F.lit(float(i))).alias("bbox")) for i in range(4)])
    best = search.patch_evidence(patches, part(0), F.lit("cosine"))
    out = rows.select("id", F.posexplode(best).alias("place", "p")).select("id", "place", F.round("p.score", 6).alias("score"), F.col("p.bbox")[0].cast("int").alias("quarter"))
    return out


@query
def plan_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels that each request asks."""
    ents = current(spark, sf_dir, [unit_vector()])
    req = _requests(spark, sf_dir, ents).where("error is null")
    vector = F.col("vector").isNotNull() & ((F.coalesce("modality", F.lit("")) != "image") | (F.col("query") == ""))
    return req.select("qid", F.array_join(search.channel_names(vector, F.col("query") != ""), ",").alias("channels"))


@query
def hnsw_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the graph finds 95 of 100 of the exact nearest."""
    q, e = _embeddings(spark, sf_dir)
    recall = fusion.recall_at_k(knn.flat_top_k(q, e, 10), hnsw.search(hnsw.build(e, DIM, 4), q, 10), 10)
    return recall.agg(F.count("*").alias("asked"), (F.avg("recall") >= 0.95).alias("reached"))


@query
def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall evaluation on generated vectors: what it was asked and whether it passes."""
    out = evalrecall.evaluate(spark, 1000, 20, 10, dim=DIM, shards=4)
    return spark.createDataFrame([(out["n"], out["dim"], out["queries"], out["k"], bool(out["pass_recall"]))], "n int, dim int, queries int, k int, pass_recall boolean")


# --- flagship ----------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question over the documents: chunks, BM25 and hash embeddings, fused; the entities' similarity as score."""
    docs = table(spark, sf_dir, "documents")
    pieces = text.chunk_table(docs.where("length(trim(text)) > 0"), "doc_id", "text")
    ents = pieces.select(
        (F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("id"), F.col("doc_id").cast("string").alias("doc_id"), "content", F.lit("default").alias("collection"),
        F.lit("text").alias("modality"), F.lit(None).cast("string").alias("caption"), F.array().cast("array<string>").alias("tags"),
        F.lit(None).cast("map<string,string>").alias("scalar"), F.lit(None).cast("string").alias("source_ref"), F.lit(None).cast("string").alias("content_hash"), F.lit(False).alias("deleted"),
    )
    ents = scratch(ents.withColumn("vector", embed.hash_embed(F.col("content"), 256)), "entities")
    question = spark.range(1).select(
        F.col("id").alias("qid"), F.lit("default").alias("collection"), F.lit("exact segment query index").alias("query"), F.lit(12).alias("top_k"), F.lit("cosine").alias("metric"),
        F.lit("flat").alias("index_type"), F.lit(60).alias("rrf_k"), F.lit(1.0).alias("vector_weight"), F.lit(1.0).alias("keyword_weight"), F.lit(None).cast("string").alias("modality"), F.lit("").alias("filter"),
    )
    question = search.with_query_vectors(question, embed.HashEmbedder(256))
    hits = search.search_hybrid(question, ents, dim=256)
    return hits.select("qid", "position", "id", (F.expr("id div 1000000")).alias("doc_id"), (F.col("id") % 1_000_000).alias("chunk_index"), "score", "vec_rank", "key_rank", "rrf")


@query
def flagship_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)
