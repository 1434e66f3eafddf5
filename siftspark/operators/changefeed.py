"""A change feed of inserts, updates and deletes applied as a signed multiset.

Every change takes back the image that its entity had before (multiplicity -1) and adds the image
it leaves (+1). The sum of all multiplicities, together with the base table (+1 for each row), is
zero for every image that has been superseded, so what remains positive is the final state.

An image is named by the ``seq`` of the change that made it, so only numbers are shuffled.
The image before a change is the one its predecessor left. Predecessors are found by a window over
(id, time chunk); the first change of a chunk gets its predecessor from the tails of the earlier
chunks, of which an id has a bounded number. So an id that holds a third of all rows is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import range_of
from ..session import shared_dir

UPSERT, DELETE = 1, 2


def parse_changes(oplog: DataFrame) -> DataFrame:
    """The changes of a log: seq, rec_type, ts, phash, id, gone.

    rec_type 1 needs a complete JSON object with an ``id``; rec_type 2 an id alone or such an object.
    Only keys of the outer object count. Ids are integers or strings of digits. Anything else
    (other types, null, empty or cut-off payloads, ids that are no number) is no change.
    ``gone``: a delete, or an upsert whose ``deleted`` is true.
    """
    text = F.col("payload").cast("string")
    rows = oplog.select(
        F.col("seq").cast("long").alias("seq"),
        F.col("rec_type").cast("int").alias("rec_type"),
        F.col("ts").cast("long").alias("ts"),
        F.unhex(F.sha2(F.col("payload").cast("binary"), 256)).alias("phash"),
        F.trim(text).alias("s"),
    ).where(F.col("rec_type").isin(UPSERT, DELETE) & (F.length("s") > 0))
    obj = F.from_json(
        "s",
        "id string, deleted string, _bad string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "primitivesAsString": "true"},
    )
    rows = rows.withColumn("is_obj", F.col("s").rlike(r"^\s*\{") & F.is_valid_utf8("s"))
    rows = rows.withColumn("o", F.when(F.col("is_obj"), obj))
    alone = F.regexp_extract("s", r'^\s*(?:([0-9]{1,19})|"([0-9]{1,19})")\s*$', 1)
    quoted = F.regexp_extract("s", r'^\s*(?:([0-9]{1,19})|"([0-9]{1,19})")\s*$', 2)
    raw = F.when(F.col("is_obj") & F.col("o._bad").isNull(), F.trim("o.id")).when(
        ~F.col("is_obj") & (F.col("rec_type") == DELETE), F.concat(alone, quoted)
    )
    rows = rows.withColumn("raw", raw)
    return rows.where(F.col("raw").rlike("^[0-9]{1,19}$")).select(
        "seq",
        "rec_type",
        F.coalesce("ts", F.lit(-(2**62))).alias("ts"),
        "phash",
        F.expr("try_cast(raw as bigint)").alias("id"),
        ((F.col("rec_type") == DELETE) | F.coalesce(F.lower("o.deleted") == "true", F.lit(False))).alias("gone"),
    ).where("id is not null and seq is not null")


def distinct_changes(oplog: DataFrame) -> DataFrame:
    """One row for each change, whatever the number of its deliveries; seq is the smallest of them."""
    return (
        parse_changes(oplog)
        .groupBy("rec_type", "ts", "phash", "id", "gone")
        .agg(F.min("seq").alias("seq"))
        .select("id", "ts", (F.col("rec_type") == DELETE).cast("int").alias("late"), "seq", (~F.col("gone")).alias("stays"))
    )


def apply_changes(oplog: DataFrame, base: DataFrame | None = None, rows_per_chunk: int = 500_000) -> DataFrame:
    """(id, seq) of every entity that exists after all changes; seq is that of the change that made its state.

    Changes apply by ts, at equal ts upserts before deletes, then by smaller seq. ``base`` (id, seq)
    holds the state before, under seq that no change has (negative ones, say).

    Nulls: rows without type, payload or seq are no changes; a null ts applies first. Repeated
    deliveries count once. An empty log gives the base, or an empty table. Further columns are not read.
    ``rows_per_chunk`` bounds the rows of one id that one task sorts, as far as their ts differ.
    """
    spark = oplog.sparkSession
    shared_dir(spark)
    changes = distinct_changes(oplog)
    if base is not None:
        changes = changes.unionByName(
            base.where("id is not null").select(
                F.col("id").cast("long").alias("id"), F.lit(-(2**63)).cast("long").alias("ts"), F.lit(0).alias("late"),
                F.col("seq").cast("long").alias("seq"), F.lit(True).alias("stays"),
            )
        )
    changes = changes.checkpoint()
    n = changes.count()
    cuts: list[float] = []
    if n > rows_per_chunk:
        parts = min(1024, -(-n // rows_per_chunk) * 2)
        cuts = sorted(set(changes.approxQuantile("ts", [i / parts for i in range(1, parts)], 0.2 / parts)))
    chunk = F.lit(0)
    if cuts:
        chunk = range_of(F.col("ts"), [int(c) for c in cuts])
    changes = changes.withColumn("chunk", chunk)
    w = Window.partitionBy("id", "chunk").orderBy("ts", "late", "seq")
    image = F.struct("seq", "stays")
    inner = changes.withColumn("prev", F.lag(image).over(w))
    signed = F.array(
        F.struct(F.col("seq").alias("seq"), F.col("stays").cast("long").alias("m")),
        F.struct(F.col("prev.seq").alias("seq"), (-F.coalesce(F.col("prev.stays").cast("long"), F.lit(0))).alias("m")),
    )
    parts_ = inner.select("id", F.explode(signed).alias("x")).select("id", "x.seq", "x.m").where("m <> 0")
    if cuts:
        tails = changes.groupBy("id", "chunk").agg(F.max_by(image, F.struct("ts", "late", "seq")).alias("tail"))
        before = F.lag("tail").over(Window.partitionBy("id").orderBy("chunk"))
        heads = tails.withColumn("prev", before).where("prev.stays").select(
            "id", F.col("prev.seq").alias("seq"), F.lit(-1).cast("long").alias("m")
        )
        parts_ = parts_.unionByName(heads)
    return parts_.groupBy("id", "seq").agg(F.sum("m").alias("m")).where("m > 0").select("id", "seq")


def final_state(oplog: DataFrame, rows_per_chunk: int = 500_000) -> DataFrame:
    """The entities that exist at the end with the fields of their last payload.

    Fields that the payload lacks are null, and so are numbers that are none. Values of ``scalar`` are text, those
    that are objects or lists their JSON. ``created_at`` is the payload's text.
    """
    state = apply_changes(oplog, rows_per_chunk=rows_per_chunk)
    body = oplog.select(F.col("seq").cast("long").alias("seq"), F.col("payload").cast("string").alias("s"))
    entity = F.from_json(
        "s",
        "collection string, modality string, content string, doc_id string, chunk_index string, "
        "caption string, content_hash string, source_ref string, tags array<string>, scalar map<string,string>, created_at string, "
        "char_offset string, terms array<struct<term: string, start: int, end: int>>, mime string, width string, height string, "
        "patches array<string>",
    )
    number = lambda name: F.expr(f"try_cast(e.{name} as int)").alias(name)
    return state.join(body, "seq").withColumn("e", entity).select(
        "id", "seq", "e.collection", "e.modality", "e.content", "e.doc_id",
        number("chunk_index"), "e.caption", "e.content_hash", "e.source_ref", "e.tags",
        "e.scalar", "e.created_at", number("char_offset"), "e.terms", "e.mime", number("width"), number("height"), "e.patches",
    )
