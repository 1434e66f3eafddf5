"""Session helpers: shipping the package to workers, cutting lineage, scratch tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers started from now on import this package from where the driver does.

    On a cluster whose nodes don't see that folder, submit the package with --py-files instead.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    # A union of two tables that lie by one key is taken as lying by it, but adaptive execution may merge the partitions of
    # each otherwise; grouping without a shuffle then gives a group twice (seen with Spark 4.1).
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Unset is an error on a cluster; in local mode a temporary folder of this machine is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    got = spark.sparkContext.getCheckpointDir()
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="siftspark-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(df: DataFrame, what: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: columnar, compressed, survives lost executors.

    The table is deleted when the driver ends (a session that dies leaves it to the folder's owner).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftspark-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder that is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/siftspark-{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    return path


def release(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing will read again, before the driver ends."""
    for df in tables:
        for spark, path in [w for w in _written if w[1] == getattr(df, "_scratch", None)]:
            delete_path(spark, path)
            _written.remove((spark, path))


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the subfolders of a path that were written whole."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def _drop_all() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions this session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
