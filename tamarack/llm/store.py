"""Shared storage for intermediate results: written tables, shipped files, row keys.

Everything goes to the folder that the session names in ``spark.checkpoint.dir``, which all
executors and the driver share, so a lost executor loses nothing.  Only a local session without
that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.textkit import release as release_python

_TABLES: dict[str, list[tuple[SparkSession, str]]] = {}
_SHIPPED: set[str] = set()
_SCOPE = ["session"]


def shared_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        at = sc._jsc.sc().getCheckpointDir()
        root = at.get() if at.isDefined() else None
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tamarack-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@contextlib.contextmanager
def in_scope(scope: str):
    """Tables written inside belong to ``scope``, for ``drop_scope``."""
    _SCOPE.append(scope)
    try:
        yield
    finally:
        _SCOPE.pop()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns a DataFrame that reads it.

    The table goes when its scope is dropped, at the latest when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tamarack/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # its codec works on the heap, snappy's on direct buffers that only a full collection frees
    _TABLES.setdefault(_SCOPE[-1], []).append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_scope(scope: str) -> None:
    """Deletes the tables written in a scope; call it once nothing reads them any more."""
    for spark, path in _TABLES.pop(scope, []):
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Hands back what finished work left in the driver; the collection also has Spark drop broadcasts and
    shuffle files that nothing refers to any more.  For between the stages of a long job."""
    release_python()
    spark.sparkContext._jvm.java.lang.System.gc()


@atexit.register
def _drop_all() -> None:
    for scope in list(_TABLES):
        try:
            drop_scope(scope)
        except Exception:  # the session may be gone already; nothing is lost but disk space
            _TABLES.pop(scope, None)


def _put(spark: SparkSession, data: bytes, name: str) -> str:
    """Writes a file in the shared folder and returns its address."""
    fs, p = _fs(spark, f"{shared_root(spark)}/tamarack/files/{name}")
    out = fs.create(p, True)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()
    return fs.makeQualified(p).toString()


def ship_bytes(spark: SparkSession, data: bytes, name: str) -> str:
    """Makes ``data`` a file in every executor's file area, now and for executors that join later.

    Returns the name for ``SparkFiles.get``.  Equal content is shipped once per context."""
    name = f"{name}-{hashlib.sha256(data).hexdigest()[:24]}"
    key = f"{spark.sparkContext.applicationId}/{name}"
    if key not in _SHIPPED:
        spark.sparkContext.addFile(_put(spark, data, name))
        _SHIPPED.add(key)
    return name


def ship_package(spark: SparkSession) -> None:
    """Lets executors import this package where they don't have it on their path."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if top in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    key = f"{spark.sparkContext.applicationId}/package"
    if key in _SHIPPED:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for d, _, names in os.walk(os.path.join(top, "tamarack")):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), top))
    spark.sparkContext.addPyFile(_put(spark, data.getvalue(), f"tamarack-{uuid.uuid4().hex}.zip"))
    _SHIPPED.add(key)


def with_row_key(df: DataFrame, id_col: str) -> DataFrame:
    """Adds ``_rid``, a long that is different in every row and the same in every evaluation.

    Unique, non-null ids serve as they are; else the rows are numbered and written once."""
    bad = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(id_col).isNull() | (F.col("_n") > 1))
    if not bad.take(1):
        return df.withColumn("_rid", F.col(id_col).cast("long"))
    return write_table(df.withColumn("_rid", F.monotonically_increasing_id()), "keyed")


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Hints a broadcast when the measured size is under ``limit``; else Spark shuffles the join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
