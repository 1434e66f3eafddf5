import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftspark.engine import Engine
from siftspark.errors import BAD_REQUEST, CONFLICT, NOT_FOUND, EngineError, is_code, wrap
from siftspark.config import EngineConfig
from siftspark.operators import cost, evalrecall, rag, segments, stats
from siftspark.sources import seed, tables


def test_seal_triggers(spark):
    rows = [("f", t, i, 10) for i, t in enumerate([0, 9, 19, 30, 31, 32, 33, 34, 60])] + [("f", 61, 9, 100), ("f", 61, 10, 1), ("g", 0, 11, 1), (None, 1, 12, 1)]
    log = spark.createDataFrame(rows, "s string, t bigint, o bigint, z int")
    got = {r.o: (r.segment, r.reason) for r in segments.seal(log, "s", "t", "o", "z", 100, 3, 11).collect()}
    assert [got[i] for i in range(12)] == [(0, None), (0, None), (0, "max_rows"), (1, None), (1, None), (1, "max_rows"), (2, None), (2, None), (3, None), (3, "max_bytes"), (4, None), (0, None)]
    assert segments.seal(log.limit(0), "s", "t", "o", "z").count() == 0
    idle = {r.o: r.segment for r in segments.seal_by_idle(log.where("s = 'f'"), "s", "t", "o", 11).collect()}
    assert [idle[i] for i in range(9)] == [0, 0, 0, 1, 1, 1, 1, 1, 2]
    by_rows = segments.seal_by_rows(log.where("s = 'f'"), "s", "o", 4)
    assert segments.segment_stats(by_rows, "s", "t", "z").count() == 3


def test_collections(spark):
    cols = spark.createDataFrame([("default", 1024, "cosine", "hnsw", dt.datetime(2025, 1, 1))], "name string, dim int, metric string, index_type string, created_at timestamp")
    new = segments.create_collection(cols, "x", 0, "odd", "odd").where("name = 'x'").first()
    assert (new.dim, new.metric, new.index_type) == (1024, "cosine", "hnsw")
    for args, code in ((("", 0), BAD_REQUEST), (("y", 7), BAD_REQUEST), (("default", 0), CONFLICT)):
        with pytest.raises(EngineError) as e:
            segments.create_collection(cols, *args)
        assert is_code(e.value, code)
    ents = spark.createDataFrame([(1, "default", None), (2, None, False)], "id bigint, collection string, deleted boolean")
    left, after = segments.drop_collection(cols, ents, "default")
    assert left.count() == 0 and {r.id: r.deleted for r in after.collect()} == {1: True, 2: False}
    with pytest.raises(EngineError) as e:
        segments.drop_collection(cols, ents, "none")
    assert is_code(e.value, NOT_FOUND) and wrap(1, "a", ValueError("b")).__cause__


def test_rag(spark):
    hits = spark.createDataFrame([(1, i, i, f"t{i}", "x" * 130 if i == 1 else "body", None) for i in range(1, 7)] + [(2, 1, 9, "t", None, "cap")], "qid bigint, position int, id bigint, title string, content string, caption string")
    c = rag.citations(hits)
    q = spark.createDataFrame([(1, "why"), (2, "what"), (3, "none")], "qid bigint, query string")
    a = {r.qid: r.answer for r in rag.answers(q, c).collect()}
    assert a[1].count(") t") == 4 and "…" in a[1] and a[1].startswith(rag.HEADER + "why\n\n")
    assert "1) t cap\n" in a[2] and a[3].endswith(rag.NOTHING)
    events = rag.token_stream(rag.answers(q, c)).where("qid = 3").orderBy("seq").collect()
    assert "".join(e.data for e in events) == a[3] and events[-1].event == "done"
    mine = {r.qid: (r.answer, r.ok) for r in rag.answers_by(q, c, lambda s, ctx: f"{s}{len(ctx)}" if ctx else 1 / 0).collect()}
    assert mine == {1: ("why6", True), 2: ("what1", True), 3: (None, False)}
    with pytest.raises(EngineError):
        rag.check_question("")


def test_cost(spark):
    calls = spark.createDataFrame([(1, "a", True, 0.9), (2, "a", False, 5.0), (3, "a", True, 0.2), (4, "b", True, 0.2)], "i int, p string, ok boolean, cny double")
    assert round(cost.spent(calls).first().spent, 6) == 1.3
    assert not cost.allowed(calls, 1.0, 0.2) and cost.allowed(calls.limit(0), 1.0, 0.2)
    assert {r.i: r.open for r in cost.breaker(calls, 1.0, ["p"], ["i"]).collect()} == {1: False, 2: True, 3: True, 4: False}
    waits, tries = [], []

    def flaky():
        tries.append(1)
        raise OSError

    with pytest.raises(OSError):
        cost.with_retries(flaky, sleep=waits.append)
    assert len(tries) == 3 and waits == [0.2, 0.4]

    def permanent():
        tries.append(1)
        raise cost.Permanent

    with pytest.raises(cost.Permanent):
        cost.with_retries(permanent, sleep=waits.append)
    assert len(tries) == 4 and cost.transient(429) and cost.transient(503) and not cost.transient(404)


def test_stats(spark):
    df = spark.createDataFrame([(i, "g", float(i)) for i in range(600)] + [(1, "h", 5.0), (2, "h", None)], "i int, g string, v double")
    got = {r.g: (r.p50, r.p99) for r in stats.latency(df, "v", ["g"], ["i"]).collect()}
    assert got["g"] == (88.0 + 256, 88.0 + 505) and got["h"] == (5.0, 5.0)
    assert {r.g: r.m for r in stats.quantile_by_rank(df, "v", ["g"], 0.5, "m").collect()}["g"] == 299.0


def test_log_files(spark, tmp_path):
    recs = [(1, 5, b'{"id":1}'), (2, 6, b"1"), (1, 7, b"")]
    data = b"".join(tables.encode_record(*r) for r in recs)
    assert list(tables.decode_records(data)) == recs
    assert list(tables.decode_records(data[:-2])) == recs[:2]
    with pytest.raises(ValueError):
        list(tables.decode_records(data[:15] + b"X" + data[16:]))
    (tmp_path / "wal-001.log").write_bytes(data)
    (tmp_path / "wal-002.log").write_bytes(data[:-1])
    got = [(r.seq, r.log_file, r.rec_type, r.ts, bytes(r.payload)) for r in tables.read_log_files(spark, str(tmp_path)).orderBy("seq").collect()]
    assert [g[0] for g in got] == [1, 2, 3, 4, 5] and got[4] == (5, "wal-002.log", 2, 6, b"1")


def test_numbering_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(f"k{i % 37:02d}", i) for i in range(500)], "k string, i int").repartition(7)
    got = tables.number_rows(df, ["k", "i"], 10).orderBy("id").collect()
    assert [r.id for r in got] == list(range(10, 510)) and [(r.k, r.i) for r in got] == sorted((r.k, r.i) for r in got)


def test_assets(spark):
    df = spark.createDataFrame([("a" * 16, "image/png"), ("../etc", "image/png"), ("b" * 20, "x"), (None, None)], "content_hash string, mime string")
    assert [r.n for r in df.select(tables.asset_name(F.col("content_hash"), F.col("mime")).alias("n")).collect()] == ["a" * 16 + ".png", None, "b" * 20 + ".bin", None]
    assert tables.find_asset(df, "a" * 16 + ".png").count() == 1 and tables.find_asset(df, "../etc").count() == 0


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), EngineConfig(dim=64))
    docs = spark.createDataFrame([(i, t, title, tags) for i, (title, tags, t) in enumerate(seed.DOCUMENTS)] + [(7, "  ", "blank", [])], "doc_id bigint, text string, title string, tags array<string>")
    e.ingest_documents(docs)
    return e


def test_engine_round_trip(spark, engine, tmp_path):
    q = spark.createDataFrame([(1, "default", "segment sealed by size", 3)], "qid bigint, collection string, query string, top_k int")
    full = q.select("qid", "collection", "query", "top_k", F.lit(None).cast("string").alias("metric"), F.lit("flat").alias("index_type"), F.lit(0).alias("rrf_k"), F.lit(1.0).alias("vector_weight"), F.lit(1.0).alias("keyword_weight"), F.lit(None).cast("string").alias("modality"), F.lit(None).cast("string").alias("filter"))
    first = [(r.id, r.score) for r in engine.search_text(full).orderBy("position").collect()]
    again = Engine(spark, engine.path, engine.config)
    assert first and first == [(r.id, r.score) for r in again.search_text(full).orderBy("position").collect()]
    assert again.get(spark.createDataFrame([(first[0][0],)], "id bigint")).first().content.startswith("Rows are buffered")
    answers, cites = again.rag(q.drop("top_k"))
    assert "Rows are buffered" in answers.first().answer and cites.count() >= 1
    names = seed.write_images(str(tmp_path / "img"))
    (tmp_path / "img" / "bad.png").write_bytes(b"not an image at all")
    again.ingest_images(str(tmp_path / "img"))
    assert tables.rejected_images(spark, str(tmp_path / "img")).count() == 1
    pictures = again.entities().where("modality = 'image'").collect()
    assert len(pictures) == len(names) and all(len(p.patches) == 9 and len(p.content_hash) == 64 and p.mime == "image/png" for p in pictures)
    v = spark.createDataFrame([(1, pictures[0].vector)], "qid bigint, vector array<float>")
    best = again.search_image(full, v).orderBy("position").first()
    assert best.id == pictures[0].id and best.score > 0.999
    before = {r.id for r in again.entities().where("not deleted").collect()}
    assert best.channels == ["vector"] and 1 <= len(best.patches) <= 3 and best.patches[0].score >= best.patches[-1].score >= 0.05 and len(best.patches[0].bbox) == 4
    again.flush()
    again.delete(spark.createDataFrame([(pictures[0].id,)], "id bigint"))
    again.flush()
    again.compact()
    assert {r.id for r in again.entities().collect()} == before - {pictures[0].id} and again.meta()["segments"] == 1
    now = again.stats().first()
    assert now.entities == len(before) - 1 and now.p99_s >= now.p50_s > 0
    again.create_collection("shelf", 64)
    again.drop_collection("default")
    assert Engine(spark, again.path, again.config).entities().where("not deleted").count() == 0
    again.record_cost("x", 10, 0.5)
    assert again.cost().first().spent == 0.5 and Engine(spark, again.path, again.config).cost().first().spent == 0.5
    with pytest.raises(EngineError):
        Engine(spark, str(tmp_path / "e2"), engine.config).compact()


def test_rejected_documents(spark, engine):
    docs = spark.createDataFrame([(1, "x", "none"), (2, " \n", "default"), (3, "y", None)], "doc_id bigint, text string, collection string")
    assert {r.doc_id: r.error for r in tables.rejected_documents(docs, engine.collections).collect()} == {1: NOT_FOUND, 2: BAD_REQUEST}


def test_recall_evaluation(spark):
    out = evalrecall.evaluate(spark, 400, 20, 10, dim=64, shards=2)
    assert out["recall_at_k"] >= 0.9 and out["insert_vec_per_s"] > 0


def some_docs(spark, first, n):
    return spark.createDataFrame([(i, f"Chunk number {i} speaks of segments and of queries. It has two sentences.", f"t{i}") for i in range(first, first + n)], "doc_id bigint, text string, title string")


def ask(spark, text, index="flat", qid=1):
    row = (qid, "default", text, 3, None, index, 0, 1.0, 1.0, None, None)
    return spark.createDataFrame([row], "qid bigint, collection string, query string, top_k int, metric string, index_type string, rrf_k int, vector_weight double, keyword_weight double, modality string, filter string")


@pytest.fixture
def small(spark, tmp_path):
    return Engine(spark, str(tmp_path / "e"), EngineConfig(dim=64, segment_max_rows=6))


def test_small_writes_go_to_the_log_until_a_segment_is_full(spark, small):
    small.ingest_documents(some_docs(spark, 0, 2))
    assert [(r.state, r.row_count) for r in small.segments().collect()] == [("growing", 2)]
    again = Engine(spark, small.path, small.config)  # a process that ended without a flush
    assert again.entities().count() == 2 and again.manifest["next_entity_id"] == 3
    again.ingest_documents(some_docs(spark, 10, 5))  # full: 7 rows
    assert [(r.state, r.row_count, r.reason) for r in again.segments().collect()] == [("persisted", 7, "max_rows")]
    again.ingest_documents(some_docs(spark, 20, 8))  # a segment at once
    assert [r.row_count for r in again.segments().collect()] == [7, 8] and sorted(r.id for r in again.entities().collect()) == list(range(1, 16))
    again.ingest_documents(some_docs(spark, 40, 1))
    assert again.tick() == {}
    again.clock = lambda: 1e12
    assert again.tick()["reason"] == "max_idle" and not again.pending
    assert [h["reason"] for h in again.manifest["history"]] == ["max_rows", "max_rows", "max_idle"]
    assert Engine(spark, small.path, small.config).entities().count() == 16 and again.flush() == {}


def test_a_torn_log_batch_is_not_read(spark, small):
    import os

    small.ingest_documents(some_docs(spark, 0, 2))
    small.ingest_documents(some_docs(spark, 5, 1))
    os.remove(f"{small.path}/log/{2:012d}/_SUCCESS")
    again = Engine(spark, small.path, small.config)
    assert again.entities().count() == 2
    again.ingest_documents(some_docs(spark, 7, 1))
    assert again.entities().count() == 3


def test_compaction_loses_nothing(spark, small):
    import glob
    import os

    small.ingest_documents(some_docs(spark, 0, 6))
    small.ingest_documents(some_docs(spark, 10, 6))
    one = glob.glob(f"{small.manifest['segments'][0]['path']}/*/*/*.parquet")[0]
    whole = open(one, "rb").read()
    open(one, "wb").write(whole[: len(whole) // 2])
    for crc in glob.glob(os.path.dirname(one) + "/.*.crc"):
        os.remove(crc)
    with pytest.raises(EngineError) as e:
        small.compact()
    assert is_code(e.value, 50000) and len(small.manifest["segments"]) == 2 and all(os.path.exists(s["path"]) for s in small.manifest["segments"])
    bad = small.damaged()
    assert [b["id"] for b in bad] == [1] and len(bad[0]["files"]) == 1
    left, files = tables.readable_segments(spark, small.manifest["segments"][0]["path"])
    assert files and left.count() < 6
    open(one, "wb").write(whole)
    assert small.damaged() == [] and small.compact()["row_count"] == 12 and Engine(spark, small.path, small.config).entities().count() == 12
    os.remove(glob.glob(f"{small.manifest['segments'][0]['path']}/*/*/*.parquet")[0])  # a file that is gone is no empty one
    assert len(small.damaged()) == 1


def test_a_manifest_is_there_at_every_moment(spark, tmp_path):
    import os

    folder = str(tmp_path / "m")
    first = tables.load_manifest(spark, folder)
    for i in range(5):
        first = tables.save_manifest(spark, folder, first | {"next_entity_id": i})
    assert tables.load_manifest(spark, folder) == first and first["version"] == 5
    (tmp_path / "m" / ".manifest-x.tmp").write_text("{")  # a crash before the rename
    (tmp_path / "m" / "manifest-000000000006.json").write_text('{"ver')  # torn
    assert tables.load_manifest(spark, folder) == first
    with pytest.raises(EngineError) as e:  # another writer was faster
        tables.save_manifest(spark, folder, first)
    assert is_code(e.value, CONFLICT)
    for name in os.listdir(folder):
        if name.startswith("manifest-"):
            (tmp_path / "m" / name).write_text("")
    with pytest.raises(EngineError):  # manifests that can't be read are no empty engine
        tables.load_manifest(spark, folder)


def test_hits_have_evidence_and_channels(spark, small):
    small.ingest_documents(some_docs(spark, 0, 7))
    hit = small.search_text(ask(spark, "number 3 segments")).orderBy("position").first()
    assert hit.channels == ["vector", "keyword", "rrf"] and hit.patches is None
    raw = hit.content.encode()
    assert {raw[p.start : p.end].decode().lower() for p in hit.term_places} >= {"number", "segments"}
    assert raw[hit.sentence.start : hit.sentence.end].decode().startswith("Chunk number")
    assert small.compare_flat(ask(spark, "number 3 segments"), small.search_text(ask(spark, "number 3 segments")), 3).first().recall > 0


def test_the_graph_serves_hnsw_requests(spark, small):
    small.ingest_documents(some_docs(spark, 0, 12))
    exact = [r.id for r in small.search_text(ask(spark, "number 3 segments")).orderBy("position").collect()]
    small.build_index(2)
    again = Engine(spark, small.path, small.config)
    assert [r.id for r in again.search_text(ask(spark, "number 3 segments", "hnsw")).orderBy("position").collect()] == exact
    again.ingest_documents(some_docs(spark, 77, 1))  # newer than the graph
    assert again.search_text(ask(spark, "Chunk number 77", "hnsw")).orderBy("position").first().title == "t77"
    again.delete(spark.createDataFrame([(exact[0],)], "id bigint"))
    assert exact[0] not in [r.id for r in again.search_text(ask(spark, "number 3 segments", "hnsw")).collect()]


def test_budgeted_answers(spark, small):
    small.ingest_documents(some_docs(spark, 0, 3))
    q = spark.createDataFrame([(1, "default", "segments"), (2, "default", "")], "qid bigint, collection string, query string")
    got = {r.qid: r for r in small.answer(q, lambda s, ctx: s.upper() if s else 1 / 0)[0].collect()}
    assert got[1].answer == "SEGMENTS" and got[1].ok and not got[2].ok and got[2].answer.startswith(rag.HEADER)
    small.record_cost("x", 1, 99.0)
    spent = {r.qid: r for r in small.answer(q, lambda s, ctx: "never")[0].collect()}
    assert not spent[1].ok and spent[1].answer.startswith(rag.HEADER) and spent[1].error == "budget exhausted"


def test_assets_are_stored_once(spark, small):
    import hashlib

    files = spark.createDataFrame([(b"one", "image/png"), (b"one", "image/png"), (b"two", "x"), (None, "x")], "content binary, mime string")
    assert small.put_assets(files).count() == 2 and small.put_assets(files).count() == 0
    name = hashlib.sha256(b"one").hexdigest() + ".png"
    row = small.asset(name).first()
    assert bytes(row.content) == b"one" and row.name == name and small.asset("../../etc").count() == 0


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_streams_are_worked_on_in_ranges(spark, many_ranges):
    """Against plain loops, with one stream that has most rows and a null one."""
    import random

    from siftspark.operators import ordered

    r = random.Random(6)
    rows = [(r.choice(["a"] * 8 + ["b", None]), r.randint(0, 5000), i, r.randint(1, 9)) for i in range(1200)]
    df = spark.createDataFrame(rows, "s string, t int, o int, z int")
    ranged = ordered.in_ranges(df, ["s"], ["t", "o"])
    assert ranged.where("s = 'a'").select("_p").distinct().count() > 1
    total = {x.o: x.n for x in ordered.running(ranged, ["s"], ["t", "o"], F.col("z"), "n").collect()}
    was = {x.o: x.w for x in ordered.before(ranged, ["s"], ["t", "o"], "t", "w").collect()}
    idle = {x.o: x.segment for x in segments.seal_by_idle(df, "s", "t", "o", 9).collect()}
    by_rows = {x.o: x.segment for x in segments.seal_by_rows(df, "s", "o", 50).collect()}
    spent = {x.o: (x.before, x.open) for x in cost.breaker(df.select("s", "o", F.lit(True).alias("ok"), F.col("z").cast("double").alias("cny")), 500.0, ["s"], ["o"]).collect()}
    for s in ("a", "b", None):
        n, prev, seg = 0, None, 0
        for x in sorted((x for x in rows if x[0] == s), key=lambda x: (x[1], x[2])):
            seg += prev is not None and x[1] - prev >= 9
            assert (total[x[2]], was[x[2]], idle[x[2]]) == (n, prev, seg)
            n, prev = n + x[3], x[1]
        n = 0
        for i, x in enumerate(sorted((x for x in rows if x[0] == s), key=lambda x: x[2])):
            assert by_rows[x[2]] == i // 50 and spent[x[2]] == (n, n + x[3] > 500)
            n += x[3]
    q = {x.s: x.m for x in stats.quantile_by_rank(df, "t", ["s"], 0.9, "m").collect()}
    for s in ("a", "b", None):
        own = sorted(x[1] for x in rows if x[0] == s)
        assert q[s] == own[int((len(own) - 1) * 0.9)]


def test_events_of_an_answer(spark):
    answer = spark.createDataFrame([(1, "ab", True, None), (2, "c", False, "timeout")], "qid bigint, answer string, ok boolean, error string")
    cites = spark.createDataFrame([(1, 2, 8), (1, 1, 9)], "qid bigint, index int, id bigint")
    got = [(r.qid, r.event, r.data) for r in rag.event_stream(answer, cites).orderBy("qid", "seq").collect()]
    assert got[:4] == [(1, "meta", '[{"index":1,"id":9},{"index":2,"id":8}]'), (1, "token", "a"), (1, "token", "b"), (1, "done", "")]
    assert got[4:] == [(2, "meta", "[]"), (2, "token", "c"), (2, "error", "timeout"), (2, "done", "")]


def test_an_embedder_with_a_budget(spark):
    from siftspark.functions.embed import BudgetedEmbedder, FunctionEmbedder, HashEmbedder

    room = [True]
    e = BudgetedEmbedder(FunctionEmbedder(lambda ts: [[1.0, 0.0] for _ in ts], 4, "mine"), HashEmbedder(4), lambda: room[0])
    df = spark.createDataFrame([("x",)], "t string")
    first = df.select(e.embed(F.col("t")).alias("v")).first().v
    assert e.space == "mine" and first[0] > 0.9
    room[0] = False
    assert df.select(e.embed(F.col("t")).alias("v")).first().v == df.select(HashEmbedder(4).embed(F.col("t")).alias("v")).first().v and e.space == "text-hash"
