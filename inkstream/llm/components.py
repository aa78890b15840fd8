"""Connected components of a table of links.

Up to ``FEW`` links (16 bytes each; counted first) are united in one task. More
than that, whatever their number, are joined by large-star and small-star steps.
Each step is a join of the links with the least neighbour of each node; nothing
but two numbers (count and checksum, to see that nothing changed) reaches the
driver. The links after each step are a written table, so lineage stays short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import discard, staged

FEW = 1_000_000


def _unite(batches):
    """Union by least node over all links of the task."""
    parts = [np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, flat = np.unique(np.concatenate(parts, 1), return_inverse=True)
    u, v = flat.reshape(2, -1)
    parent = np.arange(len(nodes)).tolist()
    for a, b in zip(u.tolist(), v.tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    root = np.array(parent)
    while (root[root] != root).any():
        root = root[root]
    linked = np.bincount(root, minlength=len(nodes))[root] > 1
    yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], names=["node", "component"])


def _linked(df: DataFrame) -> DataFrame:
    return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _linked(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return _linked(links.join(least, "u").select("v", "m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) of every node with a link; the component is its least node. ``links`` has long columns u, v."""
    if links.count() <= few:
        return links.select("u", "v").repartition(1).mapInArrow(_unite, "node long, component long")
    now, sign = staged(_linked(links), "links"), None
    while True:
        r = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if (r[0], r[1]) == sign or not r[0]:
            break
        sign = (r[0], r[1])
        before, now = now, staged(_small_star(_large_star(now)), "links")
        discard(before)
    # every node now points at its component's least node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
