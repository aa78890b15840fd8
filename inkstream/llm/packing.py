"""Best-fit packing planned over a histogram of lengths.

Documents become token pieces of at most ``window`` ids (a longer document is
cut; its first piece may be shorter). Only the histogram of piece lengths, at
most ``window`` counts whatever the input, reaches the driver. There best-fit
decreasing runs over counts: for each length from the longest, the open
sequences with the least sufficient room are filled, all equal ones at once, and
new ones are opened for the rest. The plan says, for ranks lo..hi of a length,
which sequences and which offset they take. Pieces find their slot by their rank
within their length; the rank is made of a running count over salted buckets and
the rank in the bucket, so a length that a third of all pieces have is spread
over many tasks.

Defined results: null and empty texts are the end id alone; null and repeated
doc_ids are packed like others, row by row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import tokens
from .shared import released, staged, text_column

WINDOW = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, lo long, hi long, sequence long, at long"


def cut(docs: DataFrame, window: int = WINDOW, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece of each document, with the CRC of its ids."""

    def run(batches):
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            buf, offsets = text_column(batch.column(1))
            ids_of = batch.column(0)
            for lo, hi, ids, counts in enc.rows(buf, offsets):
                upto = np.cumsum(counts)
                begin = upto - counts
                total = counts + 1
                n_pieces = -(-total // window)
                head = total - (n_pieces - 1) * window
                which, piece, start, length, crc = [], [], [], [], []
                for r in range(hi - lo):
                    own = np.empty(total[r], "<u4")
                    own[:-1] = ids[begin[r] : upto[r]]
                    own[-1] = end_id
                    at = 0
                    for k in range(n_pieces[r]):
                        size = int(head[r]) if k == 0 else window
                        which.append(lo + r)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(own[at : at + size]))
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), PIECES)


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, rank lo, rank hi, first sequence, offset)."""
    room: dict[int, list[tuple[int, int]]] = {}  # free ids -> ranges of sequences
    out, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        if length > window or length <= 0:
            raise ValueError(f"a piece of {length} ids in windows of {window}")

        def fill(lo: int, hi: int, free: int) -> None:
            """Put as many as fit into each of the sequences lo..hi, which have ``free`` ids of room."""
            nonlocal rank, left
            fit = free // length
            full = min(hi - lo, left // fit)
            if full:
                for k in range(fit):
                    out.append((length, rank + k * full, rank + (k + 1) * full, lo, window - free + k * length))
                rank, left = rank + fit * full, left - fit * full
                room.setdefault(free - fit * length, []).append((lo, lo + full))
                lo += full
            if lo < hi and left:  # fewer than ``fit`` are left: they share one sequence
                for k in range(left):
                    out.append((length, rank + k, rank + k + 1, lo, window - free + k * length))
                room.setdefault(free - left * length, []).append((lo, lo + 1))
                rank, left, lo = rank + left, 0, lo + 1
            if lo < hi:
                room.setdefault(free, []).append((lo, hi))

        while left:
            free = min((r for r in room if r >= length and room[r]), default=None)
            if free is None:
                new = -(-left // (window // length))
                opened += new
                fill(opened - new, opened, window)
            else:
                fill(*room[free].pop(), free)
                if not room[free]:
                    del room[free]
    return out


def pack(parts: DataFrame, window: int = WINDOW, bucket_rows: int = 500) -> DataFrame:
    """``parts`` (with doc_id, piece, start, length, ids_crc32) plus sequence_id and offset."""
    spark = parts.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= window rows
    slots = plan(histogram, window)
    # a length is dealt to as many buckets as its count asks for; at most ``window`` rows of two numbers
    dealt = spark.createDataFrame([(n, -(-c // bucket_rows)) for n, c in histogram.items()] or [(0, 1)], "length long, buckets long")
    salted = parts.join(F.broadcast(dealt), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    earlier = counts.select("length", "salt", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("n", F.row_number().over(order)).join(earlier, ["length", "salt"]).withColumn("rank", F.col("earlier") + F.col("n") - 1)
    table = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], PLAN).withColumnRenamed("length", "_length")
    if len(slots) <= 100_000:  # 40 bytes a slot; the number of slots depends on the window, not on the documents
        table = F.broadcast(table)
    fits = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(table, fits).select(
        *parts.columns, (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("at").alias("offset")
    )


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    return pack(staged(cut(docs, window, end_id, tokenizer), "pieces"), window)


def op3(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
