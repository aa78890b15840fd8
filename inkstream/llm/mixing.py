"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources in code-point order (null last) weigh 3, 1, 2 in turn. Together they
share ``share`` of all words; a target stops at ``cap`` times its source's size
and the excess is shared again by weight until none is above (water filling:
target = min(cap * size, level * weight), and the level is the largest of the
levels that result if the sources of the smallest cap per weight are capped).

Within a source a document is expected pi times: pi = min(cap, level * w) with
w = 2 ** (class / 4), where a document's class is the rounded binary logarithm of
its number of words and one (longer documents are favoured a little), or four
times that of the column ``priority``; the level is found by water filling over
the classes, so that the expected words are the target. A document gets floor(pi)
certain copies. What is left of the target is a fixed-size sample with inclusion
probabilities p = pi - floor(pi): documents are ranked by the odds of a random
number over the odds of p, and are taken in this order as long as their words
fit. At last one more document of the source is taken, the one whose size is
nearest to what is missing, if that brings the sum nearer. Where even that leaves
more than ``CLOSE`` of the sample (a source of few or very long documents), those
behind the first that doesn't fit are taken before, in the same order, as far as
they fit into the gap.

The texts are read once, for their sizes; all else works on a written table of
narrow rows. The running sum within a source is split over buckets of the rank
(about ``bucket_rows`` rows each), so that a source with a third of all rows is
spread over many tasks.

Defined results: a null text has size 0; a null source is a source, after all
others; null and repeated doc_ids are rows like any other (equal rows can't be
told apart, so which of them is taken makes no difference); an empty table gives
no rows; a source without words has target 0 and no document of it is taken; a
priority that is null or not positive counts as 1. Further columns are kept by
``mix`` and never clash with the names used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
CLOSE = 0.005  # of what a sample is to hold


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, share: float = 1.5, cap: int = 2) -> DataFrame:
    """rank, source, source_size, target of each source of (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row for each source from here on: pre-aggregated, and no larger than the list of sources
    ranked = by_source.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    )
    order = W.orderBy(F.col("source_size") * cap / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    leveled = ranked.select(
        "*",
        F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("used"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
    ).withColumn("level", (F.col("all_size") * F.lit(share) - F.col("capped")) / (F.col("all_weight") - F.col("used")))
    top = F.max("level").over(everything)
    return leveled.select(
        "rank", "source", "source_size",
        F.least((F.col("source_size") * cap).cast("double"), top * F.col("weight")).alias("target"),
    )


def class_rates(sizes: DataFrame, share: float = 1.5, cap: int = 2) -> DataFrame:
    """rank, source, klass, source_size, target, rate of each source and class of (source, klass, size)."""
    by_class = sizes.groupBy("source", "klass").agg(F.sum("size").alias("class_size"))
    targets = source_targets(by_class.select("source", F.col("class_size").alias("size")), share, cap).withColumnRenamed("source", "_source")
    weight = F.pow(F.lit(2.0), F.col("klass") / 4.0)
    of = W.partitionBy("rank")
    before = of.orderBy(F.desc("klass")).rowsBetween(W.unboundedPreceding, -1)  # the classes of larger weight are capped first
    leveled = (
        by_class.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("weight", weight).withColumn("load", F.col("weight") * F.col("class_size"))
        .withColumn("level", F.when(F.col("class_size") > 0, (F.col("target") - F.coalesce(F.sum(F.col("class_size") * cap).over(before), F.lit(0)))
                                    / (F.sum("load").over(of) - F.coalesce(F.sum("load").over(before), F.lit(0.0)))))
    )
    rate = F.coalesce(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.max("level").over(of)) * F.col("weight")), F.lit(0.0))
    return leveled.select("rank", "source", "klass", "source_size", "target", (F.floor(rate * 1e9 + 0.5) / 1e9).alias("rate"))


def _sized(docs: DataFrame, seed: str, priority: str | None) -> DataFrame:
    """id (equal for equal rows), doc_id, source, size, u, klass of each row; the only look at the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    prior = F.col(priority).cast("double") if priority else F.lit(None).cast("double")
    narrow = docs.select(
        F.col("doc_id"), F.col("source"), size.alias("size"), F.xxhash64("doc_id", "source", text).alias("id"),
        _uniform(F.lit(seed), F.col("doc_id"), F.md5(text)).alias("u"), *([prior.alias("prior")] if priority else []),
    )
    if priority:
        klass = F.floor(4 * F.log2(F.when(F.col("prior") > 0, F.col("prior")).otherwise(1.0)) + 0.5)
    else:
        klass = F.floor(F.log2(F.col("size") + 1.0) + 0.5)
    return narrow.select("id", "doc_id", "source", "size", "u", klass.cast("int").alias("klass"))


def _upto(rows: DataFrame, size: str, bucket: Column) -> DataFrame:
    """``rows`` with ``upto``, the sum of sizes within the rank in the order of pareto, doc_id and size, up to this row;
    and ``place``, the row's number in its bucket."""
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("rank", "bucket").agg(F.sum(size).alias("bucket_size"))
    earlier = sums.select("rank", "bucket", F.coalesce(F.sum("bucket_size").over(W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = W.partitionBy("rank", "bucket").orderBy("pareto", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(earlier, ["rank", "bucket"]).select("*", (F.col("earlier") + F.sum(size).over(within)).alias("upto"), F.row_number().over(within).alias("place")).drop("earlier")


def mix_plan(docs: DataFrame, share: float = 1.5, cap: int = 2, seed: str = "mix", bucket_rows: int = 4096, priority: str | None = None) -> DataFrame:
    """id, doc_id, size, source_size, target, rate, copies of each row."""
    sized = staged(_sized(docs, seed, priority), "mix-sizes")
    rates = staged(class_rates(sized.select("source", "klass", "size"), share, cap), "mix-rates").withColumnRenamed("source", "_source").withColumnRenamed("klass", "_klass")
    joined = (
        sized.join(rates, F.col("source").eqNullSafe(F.col("_source")) & (F.col("klass") == F.col("_klass")))
        .withColumn("whole", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.col("whole")).drop("_source", "_klass", "source", "klass")
    )
    certain = joined.where("p = 0").select("id", "doc_id", "size", "source_size", "target", "rate", F.col("whole").alias("copies"))
    # of each source, in one row: what the sample is to hold, and the mean odds, by which ranks are spread evenly over buckets
    lefts = joined.groupBy("rank").agg(
        (F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("left"), F.ceil(F.count_if(F.col("p") > 0) / bucket_rows).alias("buckets"),
        F.avg(F.when(F.col("p") > 0, F.col("p"))).alias("mean"),
    )
    sample = joined.where("p > 0").join(lefts, "rank").withColumn("pareto", F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))
    even = F.col("pareto") * F.col("mean") / (1 - F.col("mean"))
    bucket = F.least(F.floor(even / (1 + even) * F.col("buckets")), F.col("buckets") - 1).cast("long")
    placed = staged(_upto(sample, "size", bucket).withColumn("fits", F.col("upto") <= F.col("left")).drop("upto", "u", "p", "mean", "buckets"), "mix-order")
    gap = F.col("left") - F.col("filled")
    filled = placed.groupBy("rank").agg(F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("filled"))
    open_ = placed.where(~F.col("fits")).join(filled, "rank")
    off = open_.groupBy("rank").agg(F.min(F.abs(F.col("size") - gap)).alias("off"))
    wide = filled.join(lefts, "rank").join(off, "rank").where(F.least("off", gap) > F.col("left") * CLOSE).select("rank")
    behind = open_.join(wide, "rank", "left_semi").where(F.col("size") <= gap).withColumn("gap", gap).withColumnRenamed("bucket", "_bucket").withColumnRenamed("place", "_place")
    second = staged(_upto(behind, "size", F.col("_bucket")).where(F.col("upto") <= F.col("gap")).select("rank", F.col("_bucket").alias("bucket"), F.col("_place").alias("place"), "size"), "mix-behind")
    filled = filled.join(second.groupBy("rank").agg(F.sum("size").alias("more")), "rank", "left").select("rank", (F.col("filled") + F.coalesce("more", F.lit(0))).alias("filled"))
    taken = second.select("rank", "bucket", "place", F.lit(1).alias("also"))
    last = (
        placed.where(~F.col("fits")).join(taken, ["rank", "bucket", "place"], "left_anti").join(filled, "rank").where(F.abs(F.col("size") - gap) < gap)
        .groupBy("rank").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), "pareto", "doc_id", "bucket", "place")).alias("last"))
        .select("rank", "last.bucket", "last.place", F.lit(1).alias("also"))
    )
    chosen = placed.join(taken.unionByName(last), ["rank", "bucket", "place"], "left")
    extra = (F.col("fits") | F.col("also").isNotNull()).cast("long")
    return certain.unionByName(chosen.select("id", "doc_id", "size", "source_size", "target", "rate", (F.col("whole") + extra).alias("copies")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with its own columns. Whole rows are shuffled once,
    to meet their numbers of copies; equal rows share these out among themselves."""
    copies = mix_plan(docs, **options).groupBy("id").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies")).where("copies[0] > 0")
    packed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "source", F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("id"))
    met = packed.join(copies, "id")
    n = F.row_number().over(W.partitionBy("id").orderBy(F.lit(1)))
    repeated = met.select("row", F.element_at("copies", n).alias("n")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH counted AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sized AS (SELECT *, floor(log2(size + 1.0::DOUBLE) + 0.5::DOUBLE)::INT AS klass FROM counted),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM by_source),
weighted AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS weight FROM ranked),
leveled AS (
  SELECT *, ((SELECT sum(source_size) FROM weighted)::DOUBLE * 1.5 - coalesce(sum(source_size * 2) OVER o, 0)::DOUBLE)
            / ((SELECT sum(weight) FROM weighted) - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM weighted WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, rank, source_size, least((source_size * 2)::DOUBLE, (SELECT max(level) FROM leveled) * weight) AS target FROM leveled),
by_class AS (SELECT source, klass, sum(size)::BIGINT AS class_size FROM sized GROUP BY source, klass),
loaded AS (
  SELECT c.*, t.rank, t.target, t.source_size, pow(2.0::DOUBLE, klass / 4.0::DOUBLE) AS weight, pow(2.0::DOUBLE, klass / 4.0::DOUBLE) * class_size AS load
  FROM by_class c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
class_level AS (
  SELECT *, CASE WHEN class_size > 0 THEN (target - coalesce(sum(class_size * 2) OVER o, 0)) / (sum(load) OVER (PARTITION BY rank) - coalesce(sum(load) OVER o, 0)) END AS level
  FROM loaded WINDOW o AS (PARTITION BY rank ORDER BY klass DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rates AS (
  SELECT rank, source, klass, source_size, target, floor(coalesce(least(2.0::DOUBLE, greatest(0.0::DOUBLE, max(level) OVER (PARTITION BY rank)) * weight), 0) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS rate
  FROM class_level),
joined AS (
  SELECT s.doc_id, s.size, s.u, r.rank, r.source_size, r.target, r.rate, floor(r.rate)::BIGINT AS whole, r.rate - floor(r.rate) AS p
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source AND s.klass = r.klass),
lefts AS (SELECT rank, max(target) - sum(whole * size) AS remaining FROM joined GROUP BY rank),
sampled AS (SELECT *, u / (1 - u) / (p / (1 - p)) AS pareto FROM joined JOIN lefts USING (rank) WHERE p > 0),
placed AS (
  SELECT *, sum(size) OVER w <= remaining AS fits, row_number() OVER w AS place
  FROM sampled WINDOW w AS (PARTITION BY rank ORDER BY pareto, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
filled AS (SELECT rank, sum(CASE WHEN fits THEN size ELSE 0 END) AS filled FROM placed GROUP BY rank),
wide AS (
  SELECT p.rank FROM placed p JOIN filled f ON p.rank = f.rank WHERE NOT fits
  GROUP BY p.rank HAVING least(min(abs(size - (remaining - filled))), max(remaining - filled)) > max(remaining) * 0.005::DOUBLE),
behind AS (
  SELECT p.rank, p.place, size, remaining - filled AS gap, sum(size) OVER (PARTITION BY p.rank ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM placed p JOIN filled f ON p.rank = f.rank WHERE NOT fits AND size <= remaining - filled AND p.rank IN (SELECT rank FROM wide)),
second AS (SELECT rank, place, size FROM behind WHERE upto <= gap),
filled_more AS (SELECT rank, filled + coalesce((SELECT sum(size) FROM second s WHERE s.rank = f.rank), 0) AS filled FROM filled f),
last AS (
  SELECT p.rank, p.place, row_number() OVER (PARTITION BY p.rank ORDER BY abs(size - (remaining - filled)), pareto, doc_id, p.place) AS n
  FROM placed p JOIN filled_more m ON p.rank = m.rank
  WHERE NOT fits AND NOT EXISTS (SELECT 1 FROM second s WHERE s.rank = p.rank AND s.place = p.place) AND abs(size - (remaining - filled)) < remaining - filled),
also AS (SELECT rank, place FROM second UNION ALL SELECT rank, place FROM last WHERE n = 1)
SELECT doc_id, size, source_size, target, (whole * size)::BIGINT AS taken FROM joined WHERE p = 0
UNION ALL
SELECT p.doc_id, p.size, p.source_size, p.target, ((whole + CASE WHEN fits OR a.place IS NOT NULL THEN 1 ELSE 0 END) * p.size)::BIGINT
FROM placed p LEFT JOIN also a ON p.rank = a.rank AND p.place = a.place
"""
