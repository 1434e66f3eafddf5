"""Sources and sinks of the engine's tables: documents, images, entities, segments, op log, manifest, assets."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..config import EngineConfig
from ..errors import BAD_REQUEST, CONFLICT, INTERNAL, NOT_FOUND, EngineError
from ..functions import text
from ..functions.embed import Embedder, HashEmbedder, embed_sentences
from ..functions.image import image_features
from ..schema import ENTITY, OPLOG
from ..session import delete_path, scratch

# File extensions of image types.
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp"}


def ingest_documents(
    docs: DataFrame, collections: DataFrame, embedder: Embedder | None = None, config: EngineConfig = EngineConfig(), first_id: int = 1, sentence_vectors: bool = True
) -> DataFrame:
    """Entities of documents (doc_id, text, and optionally collection, title, tags, source_ref, created_at).

    Every chunk is an entity. Ids go on from ``first_id`` in the order of document and chunk. Blank texts are left
    out, see rejected_documents. Rows are numbered by sorted ranges, so no task holds all documents.
    """
    embedder = embedder or HashEmbedder(config.dim)
    have = set(docs.columns)
    pick = lambda c, kind, default=None: (F.col(c) if c in have else F.lit(default)).cast(kind).alias(c)
    rows = docs.where("doc_id is not null").select(
        "doc_id", "text", pick("collection", "string", "default"), pick("title", "string", ""), pick("tags", "array<string>"), pick("source_ref", "string"), pick("created_at", "timestamp")
    )
    rows = rows.where(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")) > 0).withColumn("collection", F.coalesce("collection", F.lit("default")))
    rows = rows.join(collections.select(F.col("name").alias("collection")).distinct(), "collection", "left_semi")
    cut = text.chunk_table(rows, "doc_id", "text", config.chunk_size, config.chunk_overlap)
    numbered = number_rows(cut, ["doc_id", "chunk_index"], first_id)
    full = numbered.join(rows.drop("text"), "doc_id")
    scalar = F.map_from_arrays(F.array(F.lit("title"), F.lit("tag")), F.array(F.coalesce("title", F.lit("")), text.first_tag(F.col("tags"))))
    out = full.select(
        "id", "collection", F.lit("text").alias("modality"), embedder.embed(F.col("content")).alias("vector"), scalar.alias("scalar"), "source_ref",
        F.coalesce("created_at", F.date_trunc("second", F.current_timestamp())).alias("created_at"), F.lit(False).alias("deleted"), "content",
        F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk_index").cast("int").alias("chunk_index"), F.col("char_offset").cast("int").alias("char_offset"),
        text.tokenize(F.col("content")).alias("terms"),
        (embed_sentences(F.col("content"), embedder.dim) if sentence_vectors else F.lit(None)).alias("sentences"), "tags",
    )
    return conform(out)


def rejected_documents(docs: DataFrame, collections: DataFrame) -> DataFrame:
    """(doc_id, error): 40001 for blank texts, 40400 for unknown collections."""
    col = F.coalesce(F.col("collection"), F.lit("default")) if "collection" in docs.columns else F.lit("default")
    known = collections.select(F.col("name").alias("_c")).distinct()
    rows = docs.withColumn("_col", col).join(known, F.col("_col") == F.col("_c"), "left")
    blank = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")) == 0
    return rows.select("doc_id", F.when(blank, BAD_REQUEST).when(F.col("_c").isNull(), NOT_FOUND).alias("error")).where("error is not null")


def number_rows(df: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """df with id = first, first + 1, ... in the given order: sorted ranges are numbered alone and moved by the ranges before them."""
    mark = F.monotonically_increasing_id()  # the range's number above 33 bits, the row's place in it below
    sorted_ = scratch(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", mark), "numbered")
    totals = sorted_.groupBy(F.shiftright("_m", 33).alias("_k")).agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = totals.select("_k", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    own = sorted_.join(totals, F.shiftright("_m", 33) == F.col("_k"))
    return own.withColumn("id", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + first).drop("_m", "_k", "_before")


def conform(df: DataFrame) -> DataFrame:
    """df with exactly the columns of an entity, absent ones null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTITY.fields])


def ingest_images(
    spark: SparkSession, path: str, collection: str = "default", captions: DataFrame | None = None, config: EngineConfig = EngineConfig(), first_id: int = 1
) -> DataFrame:
    """Entities of image files: descriptor, patches, content hash; ``captions`` (path, caption, tags) by file path.

    Files that are too large, too small or no images are left out (rejected_images names them).
    """
    files = read_images(spark, path, config).where("features.vector is not null")
    rows = number_rows(files, ["path"], first_id)
    if captions is not None:
        rows = rows.join(captions.select("path", "caption", "tags"), "path", "left")
    else:
        rows = rows.withColumn("caption", F.lit("")).withColumn("tags", F.array().cast("array<string>"))
    content = F.trim(F.concat(F.coalesce("caption", F.lit("")), F.lit(" "), text.joined_tags(F.col("tags"))))
    scalar = F.map_from_arrays(F.array(F.lit("caption"), F.lit("tag")), F.array(F.coalesce("caption", F.lit("")), text.first_tag(F.col("tags"))))
    out = rows.select(
        "id", F.lit(collection).alias("collection"), F.lit("image").alias("modality"), F.col("features.vector").alias("vector"), scalar.alias("scalar"), F.col("path").alias("source_ref"),
        F.date_trunc("second", "modificationTime").alias("created_at"), F.lit(False).alias("deleted"), content.alias("content"), text.tokenize(content).alias("terms"),
        "content_hash", F.col("features.width").alias("width"), F.col("features.height").alias("height"), "caption", "tags", mime_type(F.col("head")).alias("mime"), F.col("features.patches").alias("patches"),
    )
    return conform(out)


def read_images(spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """path, modificationTime, content_hash (SHA-256), head (first bytes), features (null for rejected files)."""
    raw = spark.read.format("binaryFile").load(path).where((F.col("length") >= 8) & (F.col("length") <= config.upload_max_bytes))
    raw = raw.select("path", "modificationTime", F.sha2("content", 256).alias("content_hash"), F.expr("substring(content, 1, 16)").alias("head"))
    px = spark.read.format("image").option("dropInvalid", True).load(path).select(
        F.col("image.origin").alias("origin"), image_features(F.col("image"), config.dim, config.patch_grid, 8, config.upload_max_pixels).alias("features")
    )
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return raw.join(px, plain(F.col("path")) == plain(F.col("origin")), "left").drop("origin")


def rejected_images(spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path").join(read_images(spark, path, config).where("features.vector is not null").select("path"), "path", "left_anti")


def mime_type(head: Column) -> Column:
    """The type of an image by its first bytes."""
    h = F.hex(head)
    return F.when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg").when(h.rlike("^52494646.{8}57454250"), "image/webp").otherwise("application/octet-stream")


def valid_hash(c: Column) -> Column:
    """At least 16 hexadecimal digits and nothing else, so an asset's name can't leave its folder."""
    return F.coalesce(c.rlike("^[0-9a-fA-F]{16,}$"), F.lit(False))


def asset_name(content_hash: Column, mime: Column) -> Column:
    ext = F.coalesce(*[F.when(mime == m, F.lit(e)) for m, e in EXTENSIONS.items()], F.lit(".bin"))
    return F.when(valid_hash(content_hash), F.concat(content_hash, ext))


ASSET = "content_hash string, mime string, content binary, name string, shelf string"


def put_assets(files: DataFrame, folder: str) -> DataFrame:
    """(content_hash, name) of files (content, mime) stored under the name that their bytes' SHA-256 gives.

    Equal files are stored once. The bytes are written by the tasks, as binary Parquet by the hash's first two digits, so
    one asset is found by reading one small folder; read_asset gives it back.
    """
    rows = files.where("content is not null").select(F.sha2("content", 256).alias("content_hash"), F.coalesce("mime", F.lit("")).alias("mime"), "content")
    rows = rows.dropDuplicates(["content_hash"]).withColumn("name", asset_name(F.col("content_hash"), F.col("mime"))).withColumn("shelf", F.substring("content_hash", 1, 2))
    try:
        have = files.sparkSession.read.schema(ASSET).parquet(folder).select(F.col("content_hash").alias("_h"))
        rows = rows.join(have, F.col("content_hash") == F.col("_h"), "left_anti")
    except AnalysisException:  # the first of all
        pass
    rows = scratch(rows, "assets")
    rows.write.mode("append").partitionBy("shelf").parquet(folder)
    return rows.select("content_hash", "name")


def read_asset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(name, mime, content) of the asset of a name (a hash of at least 16 digits, with or without extension); no row for any other."""
    want = name.split(".")[0]
    rows = spark.read.schema(ASSET).parquet(folder).where(valid_hash(F.lit(want)) & (F.col("shelf") == want[:2]) & (F.col("content_hash") == want))
    return rows.select("name", "mime", "content")


def find_asset(entities: DataFrame, name: str) -> DataFrame:
    """The entities with the asset of that name (a hash, with or without extension)."""
    want = name.split(".")[0]
    return entities.where(valid_hash(F.lit(want)) & (F.col("content_hash") == want))


# --- segments and manifest ---------------------------------------------------------------------


def write_segments(entities: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Entities as Parquet by collection and modality, so that a search prunes what it doesn't ask for."""
    entities.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("collection", "modality").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a segment; a file that can't be read is an error."""
    return spark.read.schema(ENTITY).option("ignoreCorruptFiles", False).option("ignoreMissingFiles", False).parquet(path)


def read_all(spark: SparkSession, segments: list[str], batches: list[str] = ()) -> DataFrame:
    """The rows of several segments of one folder (its subfolders segment=...) and of log batches: two scans, whatever their number."""
    out = None
    if segments:
        base = segments[0].rsplit("/", 1)[0]
        out = spark.read.schema(ENTITY).option("ignoreCorruptFiles", False).option("basePath", base).parquet(*segments).select(*ENTITY.names)
    if batches:
        more = spark.read.schema(ENTITY).parquet(*batches).select(*ENTITY.names)
        out = more if out is None else out.unionByName(more)
    return spark.createDataFrame([], ENTITY) if out is None else out


def readable_segments(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(the rows of a segment's sound files, its files that can't be read), for a recovery that takes what is left.

    Every file is read once to find out; the driver holds the names of the bad ones.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(conf).exists(root):
        return spark.createDataFrame([], ENTITY), [path]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)

    def failing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pyarrow.parquet as pq

        for f in frames:
            bad = []
            for name, data in zip(f["path"], f["content"]):
                try:
                    pq.read_table(io.BytesIO(data))
                except Exception:  # noqa: BLE001 - whatever is wrong with it, it can't be read
                    bad.append(name)
            yield pd.DataFrame({"path": pd.Series(bad, dtype=object)})

    bad = [r["path"] for r in files.select("path", "content").mapInPandas(failing, "path string").collect()]
    if not bad:
        return read_segments(spark, path), []
    return spark.read.schema(ENTITY).option("ignoreCorruptFiles", True).parquet(path), bad


def rewrite_compacted(spark: SparkSession, paths: list[str], to: str) -> None:
    """The live rows of ``paths``, each id once, written to ``to``; the caller then points at it and may delete the old."""
    from ..operators.live import current_rows

    rows = read_all(spark, paths)
    names = [f.name for f in ENTITY.fields if f.name not in ("id", "deleted", "created_at")]
    live = current_rows(rows, [*names, F.col("created_at").alias("_at")]).where("not deleted").withColumnRenamed("_at", "created_at")
    if current_rows(rows, []).where("not deleted").isEmpty():  # by itself: whole rows are moved once
        raise EngineError(BAD_REQUEST, "nothing to compact")
    write_segments(conform(live), to)


def segment_crc(entities: DataFrame) -> DataFrame:
    """One row: rows and an order-free checksum of them, to compare a segment with its copy. It doesn't depend on the session's time zone."""
    cols = [F.unix_micros(f.name).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in entities.schema.fields]
    return entities.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.crc32(F.to_json(F.struct(*cols)).cast("binary"))), F.lit(0)).alias("crc"))


def _hadoop(spark: SparkSession, path: str):
    """(file system, a Hadoop path maker) of a path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(conf), make


def _manifests(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(version, path) of the manifests of a folder, newest first."""
    fs, make = _hadoop(spark, folder)
    if not fs.exists(make(folder)):
        return []
    found = []
    for status in fs.listStatus(make(folder)):
        name = status.getPath().getName()
        if name.startswith("manifest-") and name.endswith(".json"):
            found.append((int(name[9:-5]), f"{folder}/{name}"))
    return sorted(found, reverse=True)


def save_manifest(spark: SparkSession, folder: str, manifest: dict, keep: int = 3) -> dict:
    """The manifest with its new version, saved as a small file of that version's name.

    It is written beside and renamed; the ``keep`` newest versions stay, so at every moment a whole one is there. If
    another writer took the version, nothing is overwritten and CONFLICT is raised.
    """
    manifest = manifest | {"version": manifest.get("version", 0) + 1}
    fs, make = _hadoop(spark, folder)
    target, temp = make(f"{folder}/manifest-{manifest['version']:012d}.json"), make(f"{folder}/.manifest-{uuid.uuid4().hex}.tmp")
    fs.mkdirs(make(folder))
    out = fs.create(temp, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(temp, target):
        fs.delete(temp, False)
        raise EngineError(CONFLICT, f"version {manifest['version']} of the manifest was written by another")
    for _, old in _manifests(spark, folder)[keep:]:
        fs.delete(make(old), False)
    return manifest


def load_manifest(spark: SparkSession, folder: str) -> dict:
    """The newest manifest that can be read, or a new one whose counters begin at 1 if there has never been one."""
    there = _manifests(spark, folder)
    for _, path in there:
        try:
            return json.loads(spark.read.text(path, wholetext=True).first()[0])
        except (ValueError, TypeError):
            continue
    if there:
        raise EngineError(INTERNAL, f"no manifest of {folder} can be read")
    return {"version": 0, "next_entity_id": 1, "next_segment_id": 1, "collections": [], "segments": [], "history": [], "logged": 0}


def exists(spark: SparkSession, path: str) -> bool:
    fs, make = _hadoop(spark, path)
    return fs.exists(make(path))


def log_batches(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the complete batches of a log's folder, in order."""
    fs, make = _hadoop(spark, folder)
    if not fs.exists(make(folder)):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(make(folder))]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(make(f"{folder}/{n}/_SUCCESS")))


def next_ids(manifest: dict, n: int) -> tuple[int, dict]:
    """(first of n new entity ids, manifest after them)."""
    first = manifest["next_entity_id"]
    return first, manifest | {"next_entity_id": first + n}


# --- op log ------------------------------------------------------------------------------------

_HEAD, _TAIL = struct.Struct(">BQI"), struct.Struct(">I")
MOST_PAYLOAD = 32 << 20


def encode_record(rec_type: int, ts: int, payload: bytes) -> bytes:
    """One record of a log file: type, time, length, payload and the CRC of all that."""
    body = _HEAD.pack(rec_type, ts, len(payload)) + payload
    return body + _TAIL.pack(zlib.crc32(body))


def decode_records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(type, time, payload) of each record; a torn tail ends it, a wrong CRC or a payload above 32 MiB is an error."""
    at = 0
    while at + _HEAD.size <= len(data):
        kind, ts, n = _HEAD.unpack_from(data, at)
        if n > MOST_PAYLOAD:
            raise ValueError("payload too large")
        end = at + _HEAD.size + n
        if end + _TAIL.size > len(data):
            return
        if _TAIL.unpack_from(data, end)[0] != zlib.crc32(data[at:end]):
            raise ValueError("checksum mismatch")
        yield kind, ts, data[at + _HEAD.size : end]
        at = end + _TAIL.size


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """The op log of binary log files: seq by file name and place; files are decoded where they are read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                rows = list(decode_records(bytes(data)))
                yield pd.DataFrame(
                    {"log_file": name.rsplit("/", 1)[-1], "i": range(len(rows)), "rec_type": [r[0] for r in rows], "ts": [r[1] for r in rows], "payload": [r[2] for r in rows]}
                )

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "log_file string, i long, rec_type tinyint, ts bigint, payload binary")
    files = rows.groupBy("log_file").agg(F.count("*").alias("n"))
    before = Window.orderBy("log_file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = files.select("log_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b"))
    return rows.join(files, "log_file").select((F.col("b") + F.col("i") + 1).alias("seq"), "log_file", "rec_type", "ts", "payload")


def append_log(changes: DataFrame, path: str) -> None:
    """Changes as op-log rows; each append is committed as a whole or not at all."""
    changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OPLOG.fields]).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OPLOG).parquet(path)


def entity_payload(entities: DataFrame) -> Column:
    """The JSON of an entity as an upsert's payload, its vector left out."""
    return F.encode(F.to_json(F.struct(*[c for c in entities.columns if c not in ("vector", "patches", "sentences", "terms")])), "utf-8")


def remove(spark: SparkSession, path: str) -> None:
    delete_path(spark, path)
