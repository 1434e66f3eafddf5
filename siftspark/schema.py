"""Schemas of the engine's tables."""

from pyspark.sql import types as T

_LONG, _INT, _BYTE, _DOUBLE, _BOOL, _TEXT, _BYTES, _TIME = (
    T.LongType(), T.IntegerType(), T.ByteType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.BinaryType(), T.TimestampType(),
)
_VECTOR = T.ArrayType(T.FloatType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TOKEN = _table(term=_TEXT, start=_INT, end=_INT)
SENTENCE = _table(start=_INT, end=_INT, vector=_VECTOR)
PATCH = _table(grid_row=_INT, grid_col=_INT, bbox=T.ArrayType(_DOUBLE), vector=_VECTOR)

COLLECTION = _table(name=_TEXT, dim=_INT, metric=_TEXT, index_type=_TEXT, created_at=_TIME)
ENTITY = _table(
    id=_LONG, collection=_TEXT, modality=_TEXT, vector=_VECTOR, scalar=T.MapType(_TEXT, _TEXT), source_ref=_TEXT, created_at=_TIME, deleted=_BOOL,
    content=_TEXT, doc_id=_TEXT, chunk_index=_INT, char_offset=_INT, terms=T.ArrayType(TOKEN), sentences=T.ArrayType(SENTENCE),
    content_hash=_TEXT, width=_INT, height=_INT, caption=_TEXT, tags=T.ArrayType(_TEXT), mime=_TEXT, patches=T.ArrayType(PATCH),
)
OPLOG = _table(seq=_LONG, log_file=_TEXT, rec_type=_BYTE, ts=_LONG, payload=_BYTES)
REQUEST = _table(
    qid=_LONG, at=_TIME, collection=_TEXT, query=_TEXT, top_k=_INT, metric=_TEXT, index_type=_TEXT, rrf_k=_INT,
    vector_weight=_DOUBLE, keyword_weight=_DOUBLE, modality=_TEXT, filter=_TEXT,
)
COST = _table(ts=_TIME, provider=_TEXT, model=_TEXT, tokens=_LONG, cny=_DOUBLE, ok=_BOOL, note=_TEXT)
