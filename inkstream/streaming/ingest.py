"""Incremental ingestion as a file stream that ends when it has caught up.

Each micro-batch is matched against the master by key before anything costly is
done with it, and appended. A batch that is run again after a failure finds its
keys in the master and adds nothing, so the append is effectively once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators import delta
from ..sources import tables


def ingest(spark: SparkSession, folder: str, schema: StructType, master: str, checkpoint: str, key: str = "rag_id", transform: Callable[[DataFrame], DataFrame] | None = None, retry: str | None = None) -> None:
    """Append new rows of JSON files in ``folder`` to the Parquet table ``master``, once through.

    ``transform`` runs on new rows only. ``retry`` names a condition of master rows that don't count as
    done (failed ones), so that they are taken again; without it a failed row stays as it is."""

    def take(batch: DataFrame, batch_id: int) -> None:
        known = tables.read_master(spark, master)
        if known is not None:
            done = known.where(f"NOT coalesce({retry}, false)") if retry else known
            batch = delta.new_rows(batch, done, key)
        if transform is not None:
            batch = transform(batch)
        batch.dropDuplicates([key]).withColumn("batch_no", F.lit(batch_id).cast("long")).write.mode("append").parquet(master)

    stream = spark.readStream.schema(schema).json(folder)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
