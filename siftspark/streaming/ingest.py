"""The write path as streams: op-log ingestion, current state, sealing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changefeed import parse_changes
from ..schema import OPLOG
from ..session import delete_path, folders


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Changes as they are appended to an op-log folder."""
    return spark.readStream.schema(OPLOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def copy_log(stream: DataFrame, to: str, checkpoint: str):
    """Each micro-batch appended to an op-log folder under its number: a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def maintain_state(stream: DataFrame, state_path: str, checkpoint: str, keep: int = 3):
    """After each micro-batch the table of the last changes of every id, as version ``state_path/v=<batch>``; see latest_version.

    A version is made of the one before and the batch: the changes of both are folded to one an id, so a batch costs
    what it and the state hold, not the whole log. Repeated deliveries give the same change with its smallest seq, late
    ones lose to what is newer. A batch that runs again is made from the same version. The ``keep`` newest stay.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = keyed_changes(batch)
        there = [v for v in _versions(spark, state_path) if v < number]
        both = own.unionByName(spark.read.schema(STATE).parquet(f"{state_path}/v={there[-1]}")) if there else own
        last_changes(both).write.mode("overwrite").parquet(f"{state_path}/v={number}")
        for v in there[:-keep]:
            delete_path(spark, f"{state_path}/v={v}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


STATE = "id bigint, ts bigint, late int, phash binary, seq bigint, stays boolean"


def keyed_changes(log: DataFrame) -> DataFrame:
    """(id, ts, late, phash, seq, stays) of the changes of a log, deliveries folded to the smallest seq."""
    rows = parse_changes(log).groupBy("id", "rec_type", "ts", "phash", "gone").agg(F.min("seq").alias("seq"))
    return rows.select("id", "ts", (F.col("rec_type") == 2).cast("int").alias("late"), "phash", "seq", (~F.col("gone")).alias("stays"))


def last_changes(changes: DataFrame) -> DataFrame:
    """Of each id the changes at its last ts, deletes after upserts; deliveries in different batches are folded first.

    Several with one ts stay, as a later delivery may yet give one of them a smaller seq.
    """
    one = changes.groupBy("id", "ts", "late", "phash", "stays").agg(F.min("seq").alias("seq"))
    last = one.groupBy(F.col("id").alias("_id")).agg(F.max(F.struct("ts", "late")).alias("_m"))
    return one.join(last, (F.col("id") == F.col("_id")) & (F.struct("ts", "late") == F.col("_m"))).select("id", "ts", "late", "phash", "seq", "stays")


def _versions(spark: SparkSession, state_path: str) -> list[int]:
    return sorted(int(n[2:]) for n in folders(spark, state_path) if n.startswith("v=") and n[2:].isdigit())


def latest_version(spark: SparkSession, state_path: str) -> DataFrame:
    """(id, seq) of what exists after the newest complete version."""
    there = _versions(spark, state_path)
    if not there:
        return spark.createDataFrame([], "id bigint, seq bigint")
    last = spark.read.schema(STATE).parquet(f"{state_path}/v={there[-1]}").groupBy("id").agg(F.max_by("stays", "seq").alias("stays"), F.max("seq").alias("seq"))
    return last.where("stays").select("id", "seq")


def deduplicated(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Deliveries of one change folded within a watermark on the writer's time."""
    at = F.timestamp_millis("ts").alias("at")
    return stream.select("*", at, F.sha2("payload", 256).alias("phash")).withWatermark("at", watermark).dropDuplicatesWithinWatermark(["rec_type", "ts", "phash"])


def counts_by_window(stream: DataFrame, width: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Upserts and deletes by time window and file; late changes count within the watermark."""
    rows = stream.select(F.timestamp_millis("ts").alias("at"), "log_file", "rec_type").withWatermark("at", watermark)
    return rows.groupBy(F.window("at", width), "log_file").agg(F.count_if(F.col("rec_type") == 1).alias("upserts"), F.count_if(F.col("rec_type") == 2).alias("deletes"))


def idle_sessions(stream: DataFrame, gap: str = "30 seconds", watermark: str = "1 minute") -> DataFrame:
    """Runs of rows by file in which no gap is as long as ``gap`` (a gap of exactly that length joins, here)."""
    rows = stream.select(F.timestamp_millis("ts").alias("at"), "log_file").withWatermark("at", watermark)
    return rows.groupBy(F.session_window("at", gap), "log_file").agg(F.count("*").alias("rows"))


SEALED = "log_file string, segment int, rows int, bytes long, reason string"


def seal_stream(stream: DataFrame, max_bytes: int = 4 << 20, max_rows: int = 1000, idle_ms: int = 30_000) -> DataFrame:
    """A row for each sealed segment, by file: at max_bytes (asked first), at max_rows, or when nothing came for ``idle_ms``.

    The state of a file is three numbers.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seg, n, b = state.get if state.exists else (0, 0, 0)
        out = []
        if state.hasTimedOut:
            if n:
                out.append((key[0], seg, n, b, "max_idle"))
                seg, n, b = seg + 1, 0, 0
            state.update((seg, n, b))
        else:
            for f in frames:
                for size in f.sort_values("seq")["bytes"]:
                    n, b = n + 1, b + int(size)
                    why = "max_bytes" if b >= max_bytes else "max_rows" if n >= max_rows else None
                    if why:
                        out.append((key[0], seg, n, b, why))
                        seg, n, b = seg + 1, 0, 0
            state.update((seg, n, b))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["log_file", "segment", "rows", "bytes", "reason"])

    rows = stream.select("log_file", "seq", (F.coalesce(F.octet_length("payload"), F.lit(0)) + 17).cast("long").alias("bytes"))
    return rows.groupBy("log_file").applyInPandasWithState(fold, SEALED, "segment int, rows int, bytes long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def parsed(stream: DataFrame) -> DataFrame:
    """The changes of a stream, parsed like those of a table."""
    return parse_changes(stream)
