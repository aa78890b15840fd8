"""Incremental operators: new keys, append, keep-last, resume, batches, run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as S


def new_rows(batch: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch`` whose key isn't in ``master``; repeated new keys all stay."""
    return batch.join(master.select(key).distinct(), key, "left_anti")


def changed_rows(batch: DataFrame, master: DataFrame, key: str, content: str) -> DataFrame:
    """New keys, and known keys with other content (an option that plain delta detection doesn't have)."""
    seen = master.select(F.col(key), F.md5(content).alias("_hash")).distinct()
    return batch.withColumn("_hash", F.md5(content)).join(seen, [key, "_hash"], "left_anti").drop("_hash")


def append(new: DataFrame, master: DataFrame | None) -> DataFrame:
    """New rows and then old ones; columns that one side lacks are null. ``batch_no`` orders them."""
    if master is None:
        return new.withColumn("batch_no", F.lit(0))
    return new.withColumn("batch_no", F.lit(1)).unionByName(master.withColumn("batch_no", F.lit(0)), allowMissingColumns=True)


def keep_last(df: DataFrame, key: str, position: str) -> DataFrame:
    """Of the rows of a key the one with the greatest position (as when each overwrites the one before)."""
    best = df.groupBy(key).agg(F.max_by(F.struct("*"), position).alias("row"))
    return best.select("row.*")


def resume(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def numbered(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Rows numbered from 1 in the order of a numeric column, by counts of ranges and numbers within
    them, so that no task has more than its range. Equal values get any order among themselves."""
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(df.select(F.col(order).cast("double").alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    place = F.lit(0)
    for lo in range(0, len(bounds), 50):
        part = F.array(*[F.lit(float(b)) for b in bounds[lo : lo + 50]])
        place = place + F.size(F.filter(part, lambda b: b < F.col(order)))
    placed = df.withColumn("_range", place)
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(order))
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + within).drop("_range", "_before")


def batches(df: DataFrame, order: str, size: int = 10) -> DataFrame:
    """``batch``: which group of ``size`` rows a row is in."""
    return numbered(df, order, "_position").withColumn("batch", F.floor((F.col("_position") - 1) / size)).drop("_position")


def progress(df: DataFrame, order: str, every: int = 10) -> DataFrame:
    """(done, total) at every ``every``-th row."""
    total = df.count()
    marks = numbered(df, order, "done").where(F.col("done") % every == 0).select("done")
    return marks.select("done", F.lit(total).cast("long").alias("total"))


def rate(ok: Column, total: Column) -> Column:
    return F.when(total > 0, F.lit(100.0) * ok / total).otherwise(F.lit(0.0))


def run_stats(df: DataFrame, url: Column, ok: Column) -> DataFrame:
    """Totals, successes and failures, and those of node pages, with their rates."""
    node = S.is_node(url)
    sums = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.count_if(node).alias("node_total"), F.count_if(node & ok).alias("node_ok"),
    )
    return sums.select("*", rate(F.col("successful"), F.col("total")).alias("success_rate"), rate(F.col("node_ok"), F.col("node_total")).alias("node_success_rate"))
