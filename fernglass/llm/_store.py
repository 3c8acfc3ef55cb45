"""Shared-folder storage for intermediate tables.

Intermediate results are written as Parquet below the folder that the session
names in ``spark.checkpoint.dir``, so they survive the loss of any executor and
carry file sizes from which Catalyst decides by itself whether a join side is
small enough to broadcast. They are removed after their last reader where that is
known (``dispose``), else when the driver's interpreter ends.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._words import forget_long

_KEY = "spark.checkpoint.dir"
_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share. Where unset, a temporary one of this machine for local sessions; a cluster has to name one."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{_KEY} names no folder that the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fernglass-")
        spark.conf.set(_KEY, root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then; the folder belongs to the cluster
        pass


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_root(spark)}/fernglass/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Commands run here remove their shuffle files as they end; else these stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, tag: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and fixes its content."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with _shuffles_removed(spark):
        df.write.options(**options).parquet(path, compression=compression)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[id(found)] = found, path
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Remove what was written to a ``new_path`` that nothing reads any more."""
    _delete(spark, path)


def collect_garbage(spark: SparkSession) -> None:
    """Lets go of finished jobs, so that Spark removes their shuffle files; for loops of many large jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dispose(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing reads any more."""
    for table in tables:
        _, path = _paths.pop(id(table))
        _delete(table.sparkSession, path)


#: Bytes of an Arrow batch that goes to a worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a worker is sent at once by bytes, where the session allows more; rows of text may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key).lower().removesuffix("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:  # with another unit it is larger, or unbounded
        spark.conf.set(key, BATCH_BYTES)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function whose worker gives its free memory back at the end: workers outlive their tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            forget_long()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


#: A size that Catalyst gives where it knows none.
UNKNOWN_BYTES = 1 << 55


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
