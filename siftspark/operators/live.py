"""Current and live rows of a versioned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hashable(t: T.DataType) -> bool:
    if isinstance(t, T.MapType):
        return False
    if isinstance(t, T.ArrayType):
        return _hashable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_hashable(f.dataType) for f in t.fields)
    return True


def current_rows(
    df: DataFrame,
    cols: list[str | Column],
    id_col: str = "id",
    ts_col: str = "created_at",
    deleted_col: str = "deleted",
) -> DataFrame:
    """The current row of every id: the one with the latest ``ts_col``.

    Returns id, deleted and ``cols``. Copies and older versions are folded before the shuffle
    (partial aggregation), so an id that holds a third of all rows costs no more than another.

    Nulls: a null id is dropped, a null time is the oldest, a null ``deleted`` is not deleted.
    Ties: at equal time a tombstone wins, then the row with the larger hash of its columns.
    An empty table gives an empty table. Other columns of df, whatever their names, are not read.
    """
    body = df.select(*cols)
    picked = [F.col(f"`{c}`") if isinstance(c, str) else c for c in cols]
    names = [f"c{i}" for i in range(len(picked))]
    keyed = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(ts_col).cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("t"),
        F.coalesce(F.col(deleted_col).cast("boolean"), F.lit(False)).alias("d"),
        *[c.alias(n) for c, n in zip(picked, names)],
    ).where("id is not null")
    hashed = [n for n, f in zip(names, body.schema.fields) if _hashable(f.dataType)]
    order = F.struct("t", "d", F.xxhash64(*hashed) if hashed else F.lit(0))
    out = keyed.groupBy("id").agg(F.max_by(F.struct("d", *names), order).alias("r"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("r.d").alias(deleted_col),
        *[F.col(f"r.{n}").alias(f.name) for n, f in zip(names, body.schema.fields)],
    )


def live_rows(df: DataFrame, cols: list[str | Column], **kw) -> DataFrame:
    """Current rows that are not deleted: id and ``cols``."""
    deleted = kw.get("deleted_col", "deleted")
    return current_rows(df, cols, **kw).where(~F.col(deleted)).drop(deleted)


def usable_vector(v: Column, dim: int | None) -> Column:
    """True where v has exactly ``dim`` finite numbers that are not all zero (any length if dim is None)."""
    inf = F.lit(float("inf"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == inf))
    some = F.exists(v, lambda x: x != 0)
    size = (F.size(v) == dim) if dim is not None else (F.size(v) > 0)
    return F.coalesce(v.isNotNull() & size & finite & some, F.lit(False))


def latest_wins(log: DataFrame, id_col: str = "id", seq_col: str = "seq", op_col: str = "op", delete_op="delete") -> DataFrame:
    """Recovery of a mutation log in arrival order: the last operation on an id decides, deletes remove it.

    Equal sequence numbers of one id: the row with the larger operation name wins.
    """
    names = [c for c in log.columns if c != id_col]
    best = log.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.max_by(F.struct(*names), F.struct(seq_col, op_col)).alias("_r")
    )
    return best.where(F.col(f"_r.{op_col}") != F.lit(delete_op)).select(id_col, *[F.col(f"_r.{c}").alias(c) for c in names])


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first k rows of every group; partial top-k before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
