"""Keyed tables: append, upsert by staging and swapping, JSON batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import delta


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_master(spark: SparkSession, path: str) -> DataFrame | None:
    """The master table; None where there is none yet. One that can't be read raises: starting
    anew over it would lose what it holds."""
    return spark.read.parquet(path) if exists(spark, path) else None


def retire(spark: SparkSession, path: str) -> None:
    """Delete a folder that has served its purpose, if it is there."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def megabytes(spark: SparkSession, path: str) -> float:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() / 1e6 if fs.exists(p) else 0.0


def append_batch(spark: SparkSession, batch: DataFrame, path: str, stats: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append ``batch``, which may be computed from the table at ``path``, and return ``stats`` of it (a row or a few).

    The batch is written whole beside the table and measured there; its files then are renamed into the table, which
    costs no second write, and the folder goes. Files of a run that was broken off have that run's name and stay beside."""
    spark_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staged = f"{path.rstrip('/')}.batch-{uuid.uuid4().hex}"
    batch.write.parquet(staged)
    measured = stats(spark.read.parquet(staged))
    measured = spark.createDataFrame(measured.collect(), measured.schema)
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    for f in fs.listStatus(spark_path(staged)):
        if f.getPath().getName().endswith(".parquet"):
            fs.rename(f.getPath(), spark_path(p, f.getPath().getName()))
    retire(spark, staged)
    return measured


def swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace the table at ``path``, which ``df`` may be read from: write beside it, then rename."""
    staged, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").parquet(staged)
    fs, p = _fs(spark, path)
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if fs.exists(p):
        fs.delete(hp(old), True)
        fs.rename(p, hp(old))
    fs.rename(hp(staged), p)
    fs.delete(hp(old), True)


def upsert(spark: SparkSession, new: DataFrame, path: str, key: str, position: str) -> None:
    """Rows of ``new`` (the last of each key) replace those of the same key; other rows stay."""
    fresh = delta.keep_last(new, key, position)
    if exists(spark, path):
        old = spark.read.parquet(path)
        fresh = fresh.unionByName(delta.new_rows(old, fresh, key), allowMissingColumns=True)
    swap(spark, fresh, path)


def newest_first(master: DataFrame, position: str) -> DataFrame:
    return master.orderBy(F.col("batch_no").desc(), position)
