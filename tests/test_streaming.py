import json
import time

from siftspark.schema import OPLOG
from siftspark.streaming import ingest


def rows(n, start=0):
    return [(start + i, "f", 1, 1_000 * (start + i), json.dumps({"id": i % 5}).encode()) for i in range(n)]


def append(spark, path, data):
    spark.createDataFrame(data, OPLOG).coalesce(1).write.mode("append").parquet(path)


def test_state_follows_the_log(spark, tmp_path):
    src, state, ck = (str(tmp_path / x) for x in ("src", "state", "ck"))
    assert ingest.latest_version(spark, state).count() == 0
    append(spark, src, rows(20, 1))
    ingest.maintain_state(ingest.log_stream(spark, src), state, ck).awaitTermination()
    append(spark, src, [(99, "g", 2, 5_000_000, b"3"), *rows(3, 1)])
    ingest.maintain_state(ingest.log_stream(spark, src), state, ck).awaitTermination()
    assert {r.id: r.seq for r in ingest.latest_version(spark, state).collect()} == {0: 16, 1: 17, 2: 18, 4: 20}


def test_state_of_batches_is_that_of_the_whole_log(spark, tmp_path):
    """Late, repeated and tied changes, dealt to batches in any order."""
    import random

    from siftspark.operators.changefeed import apply_changes

    r = random.Random(5)
    src, state, ck = (str(tmp_path / x) for x in ("src", "state", "ck"))
    changes = [(r.choice([1, 1, 2]), r.randint(1, 6) * 1000, json.dumps({"id": r.randint(1, 8), "x": r.randint(0, 3), "deleted": r.random() < 0.2}).encode()) for _ in range(60)]
    seqs = list(range(1, 181))
    r.shuffle(seqs)
    log = [(s, "f", *r.choice(changes)) for s in seqs]
    for i in range(4):
        append(spark, src, log[i::4])
        ingest.maintain_state(ingest.log_stream(spark, src), state, ck, keep=1).awaitTermination()
    want = {x.id: x.seq for x in apply_changes(spark.createDataFrame(log, OPLOG)).collect()}
    assert want and {x.id: x.seq for x in ingest.latest_version(spark, state).collect()} == want


def drain(spark, stream, name, ck, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_sealing(spark, tmp_path):
    src = str(tmp_path / "src")
    append(spark, src, rows(10))
    q = ingest.seal_stream(ingest.log_stream(spark, src), max_rows=4).writeStream.format("memory").queryName("sealed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    got = []
    until = time.time() + 90
    while len(got) < 2 and time.time() < until and q.isActive:  # a query with timeouts never says that it is done
        time.sleep(1)
        got = spark.table("sealed").collect()
    q.stop()
    assert sorted((r.segment, r.rows, r.reason) for r in got) == [(0, 4, "max_rows"), (1, 4, "max_rows")]


def test_windows_and_duplicates(spark, tmp_path):
    src = str(tmp_path / "src")
    append(spark, src, rows(5, 1) + rows(5, 1))
    got = drain(spark, ingest.deduplicated(ingest.log_stream(spark, src)).select("seq"), "once", str(tmp_path / "a"))
    assert len(got) == 5
    counts = drain(spark, ingest.counts_by_window(ingest.log_stream(spark, src)), "counts", str(tmp_path / "b"), "complete")
    assert [(r.upserts, r.deletes) for r in counts] == [(10, 0)]
    idle = drain(spark, ingest.idle_sessions(ingest.log_stream(spark, src)), "idle", str(tmp_path / "c"), "complete")
    assert [r.rows for r in idle] == [10]
    ingest.copy_log(ingest.log_stream(spark, src), str(tmp_path / "to"), str(tmp_path / "d")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "to")).count() == 10
