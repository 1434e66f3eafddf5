"""One object for the engine's tables and services."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .config import EngineConfig
from .errors import BAD_REQUEST, INTERNAL, EngineError, wrap
from .functions.embed import Embedder, HashEmbedder
from .operators import cost, evalrecall, fusion, hnsw, rag, search, segments, stats
from .operators.live import current_rows
from .session import release, scratch, ship
from .sources import tables


class Engine:
    """Collections and entities of a folder: numbered manifests, segments, a log of what no segment holds yet, a graph, assets.

    Every call works on batches: documents, requests and questions are tables. A write is durable when it returns: a
    batch as large as a segment becomes one, a smaller one is a batch of the log until enough rows or bytes have come
    together, nothing came for the idle time, or flush() is called; then the log's batches become a segment. A new
    engine over the folder reads the segments and the log's complete batches that none of them holds.
    """

    def __init__(
        self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), embedder: Embedder | None = None, clip: Embedder | None = None,
        clock: Callable[[], float] = time.time,
    ):
        self.spark, self.path, self.config = ship(spark), path.rstrip("/"), config
        self.embedder, self.clip, self.clock = embedder or HashEmbedder(config.dim), clip, clock
        self.manifest = tables.load_manifest(spark, self.path)
        self.searches: list[tuple[float, float, int]] = []  # of this process: when, seconds, requests; the newest 512
        self.pending = [self._pending(n) for n in tables.log_batches(spark, f"{self.path}/log") if n > self.manifest["logged"]]
        highest = max((b["max_id"] for b in self.pending), default=0)
        self.manifest["next_entity_id"] = max(self.manifest["next_entity_id"], highest + 1)
        if not self.manifest["collections"]:
            self.create_collection("default")

    # Collections

    @property
    def collections(self) -> DataFrame:
        rows = [(c["name"], c["dim"], c["metric"], c["index_type"], None) for c in self.manifest["collections"]]
        return self.spark.createDataFrame(rows, schema.COLLECTION)

    def create_collection(self, name: str, dim: int = 0, metric: str = "cosine", index_type: str = "hnsw") -> None:
        table = segments.create_collection(self.collections, name, dim, metric, index_type, self.config.dim)
        new = table.where(F.col("name") == name).first()
        self._save(collections=[*self.manifest["collections"], {k: new[k] for k in ("name", "dim", "metric", "index_type")}])

    def list_collections(self) -> DataFrame:
        return self.collections.orderBy("name")

    def drop_collection(self, name: str) -> None:
        """Its entities are deleted first, so they stay so after a restart."""
        segments.drop_collection(self.collections, self.collections.limit(0).select(F.lit(False).alias("deleted"), F.lit("").alias("collection")), name)
        gone = self.entities().where((F.col("collection") == name) & ~F.col("deleted"))
        self._write(gone.withColumn("deleted", F.lit(True)).withColumn("created_at", F.current_timestamp()))
        self._save(collections=[c for c in self.manifest["collections"] if c["name"] != name])

    # Writing

    def ingest_documents(self, docs: DataFrame) -> DataFrame:
        """The new entities' (id, doc_id, chunk_index)."""
        new = scratch(tables.ingest_documents(docs, self.collections, self.embedder, self.config, self.manifest["next_entity_id"]), "ingest")
        return self._add(new)

    def ingest_images(self, path: str, collection: str = "default", captions: DataFrame | None = None) -> DataFrame:
        new = scratch(tables.ingest_images(self.spark, path, collection, captions, self.config, self.manifest["next_entity_id"]), "ingest")
        return self._add(new)

    def delete(self, ids: DataFrame) -> None:
        gone = self._current(self._stored().join(ids.select("id").distinct(), "id", "left_semi"))
        self._write(gone.withColumn("deleted", F.lit(True)).withColumn("created_at", F.current_timestamp()))

    def flush(self, reason: str = "manual") -> dict:
        """The entry of the segment that the log's batches become; {} if there are none."""
        if not self.pending:
            return {}
        rows = self.spark.read.schema(schema.ENTITY).parquet(*[b["path"] for b in self.pending])
        entry = self._segment(rows, reason, logged=self.pending[-1]["number"])
        old, self.pending = self.pending, []
        for b in old:
            tables.remove(self.spark, b["path"])
        return entry

    def tick(self) -> dict:
        """Seals what is pending if nothing came for the idle time; for a caller's timer."""
        if self.pending and self.clock() - self.pending[-1]["at"] >= self.config.segment_max_idle_s:
            return self.flush("max_idle")
        return {}

    def compact(self) -> dict:
        """All segments as one; at least two are needed.

        Each is read whole and held against its entry in the manifest first; one that doesn't agree stops it. The
        inputs are deleted after the manifest names the new segment, and only then.
        """
        old = self.manifest["segments"]
        if len(old) < 2:
            raise EngineError(BAD_REQUEST, "at least two segments are needed")
        for entry in old:
            self._verify(entry)
        number = self.manifest["next_segment_id"]
        to = f"{self.path}/segments/segment={number:08d}-{uuid.uuid4().hex[:8]}"
        tables.rewrite_compacted(self.spark, [e["path"] for e in old], to)
        entry = self._entry(number, to)
        self._save(segments=[entry], next_segment_id=number + 1, history=self._history(entry, "compact"))
        for e in old:
            tables.remove(self.spark, e["path"])
        return entry

    def damaged(self) -> list[dict]:
        """The segments that can't be read whole or don't agree with the manifest: id, error and the files that can't be read."""
        out = []
        for entry in self.manifest["segments"]:
            try:
                self._verify(entry)
            except EngineError as e:
                out.append({"id": entry["id"], "error": e.message, "files": tables.readable_segments(self.spark, entry["path"])[1]})
        return out

    def segments(self) -> DataFrame:
        """id, state, reason, row_count, byte_size of the segments, and of what grows."""
        rows = [(e["id"], e["state"], e.get("reason"), e["row_count"], e["byte_size"]) for e in self.manifest["segments"]]
        if self.pending:
            rows.append((self.manifest["next_segment_id"], "growing", None, sum(b["rows"] for b in self.pending), sum(b["bytes"] for b in self.pending)))
        return self.spark.createDataFrame(rows, "id long, state string, reason string, row_count long, byte_size long")

    def build_index(self, shards: int | None = None) -> dict:
        """Builds the graph of all live vectors and keeps it; searches take it for requests with index_type hnsw.

        What is written after it is searched exactly, beside it, until it is built again.
        """
        live = self.entities().where(~F.col("deleted")).select("id", "vector")
        shards = shards or max(1, -(-live.count() // 20_000))
        path = f"{self.path}/graph-{uuid.uuid4().hex[:8]}"
        hnsw.build(live, self.embedder.dim, shards, self._hnsw()).write.parquet(path)
        old = self.manifest.get("graph")
        covered = {"segments": [e["id"] for e in self.manifest["segments"]], "logged": self.pending[-1]["number"] if self.pending else self.manifest["logged"]}
        self._save(graph={"path": path, **covered})
        if old:
            tables.remove(self.spark, old["path"])
        return self.manifest["graph"]

    # Assets

    def put_assets(self, files: DataFrame) -> DataFrame:
        return tables.put_assets(files, f"{self.path}/assets")

    def asset(self, name: str) -> DataFrame:
        return tables.read_asset(self.spark, f"{self.path}/assets", name)

    # Reading

    def entities(self, columns: list[str] | None = None) -> DataFrame:
        """The current row of every id, deleted ones too; with ``columns`` just id, deleted and these, so that no others are moved."""
        return self._current(self._stored()) if columns is None else current_rows(self._stored(), columns)

    def get(self, ids: DataFrame) -> DataFrame:
        return self.entities().where(~F.col("deleted")).join(ids.select("id").distinct(), "id", "left_semi")

    def search_text(self, requests: DataFrame, filter_mode: str = "post", evidence: bool = True) -> DataFrame:
        """Hits of text requests, each with its evidence and the channels that were asked."""
        req = fusion.normalize_requests(requests, self.collections, self.config.top_k, self.config.top_k_most)
        return self._search(search.with_query_vectors(req, self.embedder), filter_mode, False, evidence)

    def search_hybrid(self, requests: DataFrame, filter_mode: str = "post", evidence: bool = True) -> DataFrame:
        """search_text, where requests for images take their vector from the cross-modal embedder, if the engine has one."""
        req = fusion.normalize_requests(requests, self.collections, self.config.top_k, self.config.top_k_most)
        if self.clip is None:
            return self._search(search.with_query_vectors(req, self.embedder), filter_mode, False, evidence)
        image = F.coalesce(F.col("modality") == "image", F.lit(False))
        vector = F.when(F.trim("query") != "", F.when(image, self.clip.embed(F.col("query"))).otherwise(self.embedder.embed(F.col("query"))))
        return self._search(req.withColumn("vector", vector), filter_mode, True, evidence)

    def search_image(self, requests: DataFrame, vectors: DataFrame, evidence: bool = True) -> DataFrame:
        """Requests with image vectors (qid, vector): images only, the vector channel alone."""
        req = fusion.normalize_requests(requests.withColumn("query", F.lit("")).withColumn("modality", F.lit("image")), self.collections, self.config.top_k, self.config.top_k_most)
        req = req.where(F.coalesce("error", F.lit(0)) != 40400).drop("error").join(vectors, "qid")
        return self._search(req, "post", False, evidence)

    def compare_flat(self, requests: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
        """(qid, recall) of hits against the exact nearest of the request's vector (requests with ``vector`` or a query)."""
        req = requests if "vector" in requests.columns else search.with_query_vectors(requests, self.embedder)
        return search.compare_flat(req, hits, self.entities(), k, self.embedder.dim)

    def _search(self, req: DataFrame, filter_mode: str, cross_modal: bool, evidence: bool) -> DataFrame:
        began = self.clock()
        ents = scratch(self.entities(), "entities")
        req = scratch(req, "requests")
        graph = self.manifest.get("graph")
        index = self.spark.read.schema(hnsw.GRAPH).parquet(graph["path"]) if graph else None
        fresh = self._since(graph) if graph else None
        hits = search.search_hybrid(req, ents, self.config, self.embedder.dim, graph=index, fresh=fresh, filter_mode=filter_mode, cross_modal=cross_modal)
        if evidence:
            hits = search.with_evidence(hits, ents, req, self.embedder.dim)
        hits = scratch(hits, "hits")  # the search is done here, so its time is known
        self.searches = [*self.searches[-511:], (began, self.clock() - began, req.count())]
        return hits

    def _since(self, graph: dict) -> DataFrame:
        """The ids written after the graph was built."""
        paths = [e["path"] for e in self.manifest["segments"] if e["id"] not in graph["segments"]]
        return tables.read_all(self.spark, paths, [b["path"] for b in self.pending if b["number"] > graph["logged"]]).select("id").distinct()

    def _hnsw(self) -> hnsw.HnswParams:
        return hnsw.HnswParams(self.config.hnsw_m, self.config.hnsw_ef_construction, self.config.hnsw_ef_search)

    def rag(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(answers, citations) of questions (qid, query, collection)."""
        have = set(questions.columns)
        full = questions.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.REQUEST.fields])
        full = full.withColumn("top_k", F.coalesce("top_k", F.lit(self.config.rag_top_k)))
        cites = rag.citations(self.search_text(full))
        return rag.answers(full, cites), cites

    # Measures

    def eval_recall(self, n: int = 2000, queries: int = 40, k: int = 10) -> dict:
        return evalrecall.evaluate(self.spark, n, queries, k, self.config.dim, params=self._hnsw())

    def stats(self) -> DataFrame:
        """One row: what lives, and of this engine's own searches (batches of requests) p50_s, p99_s and requests a second."""
        took = sorted(t for _, t, _ in self.searches)
        at = lambda i: float(took[i]) if took else 0.0
        span = self.searches[-1][0] - self.searches[0][0] if len(self.searches) > 1 else 0.0
        asked = sum(n for _, _, n in self.searches)
        return stats.live_counts(self.entities(), self.collections).select(
            "*", F.lit(at(len(took) // 2)).alias("p50_s"), F.lit(at(max(int(len(took) * 0.99) - 1, 0))).alias("p99_s"), F.lit(asked / span if span > 0 else float(asked)).alias("qps")
        )

    def record_cost(self, provider: str, tokens: int, cny: float, ok: bool = True, note: str | None = None) -> None:
        """Appended to the engine's ledger, which outlives the process."""
        row = [(dt.datetime.fromtimestamp(self.clock(), dt.timezone.utc), provider, provider, tokens, cny, ok, note)]
        self.spark.createDataFrame(row, schema.COST).coalesce(1).write.mode("append").parquet(f"{self.path}/costs")

    def ledger(self) -> DataFrame:
        if not tables.exists(self.spark, f"{self.path}/costs"):
            return self.spark.createDataFrame([], schema.COST)
        return self.spark.read.schema(schema.COST).parquet(f"{self.path}/costs")

    def cost(self) -> DataFrame:
        return cost.spent(self.ledger())

    def answer(self, questions: DataFrame, generate: Callable[[str, list[str]], str], estimate: float = 0.02) -> tuple[DataFrame, DataFrame]:
        """rag() with a model of one's own: (answers with ok and error, citations).

        The extractive answer stands in for the whole batch if the budget has no room for ``estimate`` a question, and
        for each question whose call fails. What the answers' length costs is recorded.
        """
        plain, cites = self.rag(questions)
        if not cost.allowed(self.ledger(), self.config.budget_cny, estimate * questions.count()):
            return plain.select("qid", "answer", F.lit(False).alias("ok"), F.lit("budget exhausted").alias("error")), cites
        got = scratch(rag.answers_by(questions, cites, generate), "answers")
        spent = got.agg(F.coalesce(F.sum(F.when(F.col("ok"), cost.answer_cost(F.length("answer")))), F.lit(0.0)), F.coalesce(F.sum(F.length("answer")), F.lit(0))).first()
        self.record_cost("llm", int(spent[1]), float(spent[0]))
        both = got.join(plain.select("qid", F.col("answer").alias("_plain")), "qid", "left")
        return both.select("qid", F.when(F.col("ok"), F.col("answer")).otherwise(F.col("_plain")).alias("answer"), "ok", "error"), cites

    def meta(self) -> dict:
        return {"embedder": self.embedder.space, "dim": self.embedder.dim, "collections": len(self.manifest["collections"]), "segments": len(self.manifest["segments"])}

    # Storage

    def _current(self, rows: DataFrame) -> DataFrame:
        names = [f.name for f in schema.ENTITY.fields if f.name not in ("id", "deleted", "created_at")]
        return tables.conform(current_rows(rows, [*names, F.col("created_at").alias("_at")]).withColumnRenamed("_at", "created_at"))

    def _stored(self) -> DataFrame:
        return tables.read_all(self.spark, [e["path"] for e in self.manifest["segments"]], [b["path"] for b in self.pending])

    def _verify(self, entry: dict) -> None:
        try:
            got = tables.segment_crc(tables.read_segments(self.spark, entry["path"])).first()
        except Exception as e:  # noqa: BLE001 - whatever the reader says
            raise wrap(INTERNAL, f"segment {entry['id']} can't be read", e) from e
        if (got["rows"], got["crc"]) != (entry["row_count"], entry["crc"]):
            raise EngineError(INTERNAL, f"segment {entry['id']} has {got['rows']} rows with another checksum than its {entry['row_count']} in the manifest")

    def _entry(self, number: int, path: str, reason: str = "compact") -> dict:
        rows = tables.read_segments(self.spark, path)
        one = tables.segment_crc(rows).crossJoin(rows.agg(F.coalesce(F.sum(_row_bytes()), F.lit(0)).alias("b"))).first()  # one row each
        return {"id": number, "state": "persisted", "reason": reason, "path": path, "row_count": one["rows"], "byte_size": int(one["b"]), "crc": one["crc"]}

    def _history(self, entry: dict, reason: str) -> list[dict]:
        event = {"segment": entry["id"], "reason": reason, "rows": entry["row_count"], "bytes": entry["byte_size"], "at": self.clock()}
        return [*self.manifest.get("history", []), event][-100:]

    def _segment(self, rows: DataFrame, reason: str, **changes) -> dict:
        number = self.manifest["next_segment_id"]
        path = f"{self.path}/segments/segment={number:08d}-{uuid.uuid4().hex[:8]}"
        tables.write_segments(tables.conform(rows), path)
        entry = self._entry(number, path, reason)
        self._save(segments=[*self.manifest["segments"], entry], next_segment_id=number + 1, history=self._history(entry, reason), **changes)
        return entry

    def _pending(self, number: int) -> dict:
        path = f"{self.path}/log/{number:012d}"
        one = self.spark.read.schema(schema.ENTITY).parquet(path).agg(F.count("*").alias("n"), F.coalesce(F.sum(_row_bytes()), F.lit(0)).alias("b"), F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()
        return {"number": number, "path": path, "rows": one["n"], "bytes": int(one["b"]), "max_id": one["m"], "at": self.clock()}

    def _write(self, rows: DataFrame) -> None:
        """Rows made durable: a segment if they fill one, else a batch of the log, which is sealed when full. A scratch table of them is released."""
        rows = rows if getattr(rows, "_scratch", None) else scratch(tables.conform(rows), "batch")
        self.tick()
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(_row_bytes()), F.lit(0)).alias("b")).first()
        full = lambda n, b: "max_bytes" if b >= self.config.segment_max_bytes else "max_rows" if n >= self.config.segment_max_rows else None
        if reason := full(size["n"], size["b"]):
            self.flush("order")  # what came before must not be read as newer
            self._segment(rows, reason)
            release(rows)
            return
        if not size["n"]:
            release(rows)
            return
        number = max([self.manifest["logged"], *(b["number"] for b in self.pending)]) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/log/{number:012d}")  # a batch without its mark of success isn't read
        release(rows)
        self.pending.append(self._pending(number))
        if reason := full(sum(b["rows"] for b in self.pending), sum(b["bytes"] for b in self.pending)):
            self.flush(reason)

    def _add(self, new: DataFrame) -> DataFrame:
        count = new.count()
        names = scratch(new.select("id", "doc_id", "chunk_index"), "ids")
        self._write(new)
        self.manifest["next_entity_id"] += count  # saved with the next manifest; a new engine takes it from the log, too
        if not self.pending:
            self._save()
        return names

    def _save(self, **changes) -> None:
        self.manifest = tables.save_manifest(self.spark, self.path, self.manifest | changes)


def _row_bytes():
    return segments.row_bytes(F.col("vector"), F.col("content"), F.col("caption"), F.col("content_hash"), F.col("patches"))
