"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, tuple[SparkSession, int]] = {}  # by path; with the thread that wrote it


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is set a temporary one is made on a local master, whose executors share the driver's disk; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder, which release() deletes, or the driver's end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark, threading.get_ident()
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and go on from the written table: lineage is cut and nothing is computed twice. It is deleted by forget() or release(), or when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete kept tables that nothing will read again: what was made from them has been written or collected."""
    for df in tables:
        path = getattr(df, "_kept_at", None)
        if path in _written:
            _delete(_written.pop(path)[0], path)


def keep_only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """keep() what make gives, and delete all that this thread kept on the way to it."""
    before = set(_written)
    out = keep(make(), name)
    _drop(p for p, (_, thread) in list(_written.items()) if p not in before and p != out._kept_at and thread == threading.get_ident())
    return out


def release() -> None:
    """Delete all that this thread has kept. Call it in a long session when the results of the library's operators have been read or written: frames that were made before can't be read afterwards."""
    _drop(p for p, (_, thread) in list(_written.items()) if thread == threading.get_ident())


def _drop(paths) -> None:
    for path in list(paths):
        _delete(_written.pop(path)[0], path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    while _written:
        path, (spark, _) = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before; the folder's owner then clears it
            pass
