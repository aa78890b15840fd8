"""Session helpers: the shared work folder, staged tables, Arrow columns."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_ROWS = 2000
_STAGED: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session that runs in this one process (``local``) may leave it unset; its
    executors are threads of the driver, and a folder under /tmp serves all of them.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/inkstream-work"
    return base.rstrip("/")


def _sweep() -> None:
    for spark, path in _STAGED:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone at exit; the folder is scratch
            return


atexit.register(_sweep)


@contextmanager
def _slim_batches(spark: SparkSession):
    """Arrow batches of at most ``BATCH_ROWS`` rows meanwhile, as rows with whole texts are wide: what the JVM and a worker hold
    of a batch stays at a few megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, so
    a lost executor costs a re-read and never a recomputation. The tables go when
    the driver's process ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/inkstream/{name}-{uuid.uuid4().hex}"
    with _slim_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def small(table: DataFrame, most: int) -> DataFrame:
    """A written table, marked to be broadcast if it is counted to have ``most`` rows at most. Beyond that both sides of its
    join are plain shuffles, in which the optimizer can split a key with very many rows."""
    return F.broadcast(table) if table.count() <= most else table


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        if df is not None and getattr(df, "_staged_at", None):
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_at)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def released(run):
    """``run`` over a task's batches, after which the worker gives its freed memory back to the system.

    Workers live on between tasks and stages; what their allocators hold back would count against
    the executor while others work."""

    def call(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return call


def text_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty; no copy of the text
    where Arrow allows it. offsets has one entry more than the column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        wide = np.int32
    else:
        wide = np.int64
    _, offs, data = col.buffers()
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def pieces(offsets: np.ndarray, most: int):
    """Row ranges [lo, hi) of at most ``most`` bytes, or of one row that is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
