"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import time
import uuid
import weakref
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Where the tables that settle() wrote lie, and those that are still there.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_OPEN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session that runs in one process (as in tests) gets a folder of
    this machine; on a cluster that is an error, since each machine would have another.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="assayer-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may already be stopped; the folder is scratch space
        pass


def settle(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back.

    Cuts the lineage, survives lost executors, and stays columnar (a later scan
    prunes columns). The files go away with the driver process, or by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/assayer-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    _OPEN.add(path)
    return found


def release(*tables: DataFrame | None) -> None:
    """Delete the files of settled tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = _PATHS.pop(df, None) if df is not None else None
        if path:
            _OPEN.discard(path)
            _remove(df.sparkSession, path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, written; all that it settled on the way is deleted."""
    before = set(_OPEN)
    found = settle(make())
    for path in _OPEN - before - {_PATHS[found]}:
        _OPEN.discard(path)
        _remove(found.sparkSession, path)
    sweep(found.sparkSession)
    return found


def sweep(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished queries soon; it does so when the driver's heap is collected, the second time. Nothing waits for it."""

    def collect() -> None:
        with contextlib.suppress(Exception):  # the session may stop meanwhile
            for _ in range(2):
                spark.sparkContext._jvm.System.gc()
                time.sleep(0.2)

    threading.Thread(target=collect, daemon=True).start()
