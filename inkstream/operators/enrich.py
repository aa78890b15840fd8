"""Bibliographic lookup against a catalogue table, identity verification, official or fallback output."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import scalars as S

PAGE = "https://pubmed.ncbi.nlm.nih.gov"  # fixed value: where a record's page is


def _matched(docs: DataFrame, catalogue: DataFrame, key: Column, catalogue_key: Column) -> DataFrame:
    """``docs`` with ``_hit``, the catalogue's row of the same non-empty key with the least pmid. Rows without a key don't
    take part in the join, so that they aren't all sent to one task."""
    known = catalogue.withColumn("_key", catalogue_key).where("_key <> ''").groupBy("_key").agg(F.min_by(F.struct(*catalogue.columns), "pmid").alias("_hit"))
    keyed = docs.withColumn("_key", key)
    with_key = keyed.where("_key <> ''").join(known, "_key", "left").drop("_key")
    without = keyed.where("coalesce(_key, '') = ''").drop("_key").withColumn("_hit", F.lit(None).cast(known.schema["_hit"].dataType))
    return with_key.unionByName(without)


def lookup(docs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``docs`` (title, doi) with the catalogue's hit as struct ``hit``: by DOI, else by title; one hit at most.

    A search over free text has no counterpart in a table; ``sources.lookup`` asks a service for it."""
    title = lambda t: S.strip(S.normalize_title(S.search_title(F.col(t))))
    by_doi = _matched(docs, catalogue, S.normalize_doi(F.col("doi")), S.normalize_doi(F.col("doi"))).withColumnRenamed("_hit", "_by_doi")
    # what a DOI has found isn't looked up by title
    rest = _matched(by_doi, catalogue, F.when(F.col("_by_doi").isNull(), title("title")), title("title"))
    return rest.withColumn("hit", F.coalesce("_by_doi", "_hit")).drop("_by_doi", "_hit")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; order matters. Null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def verify(local_title: Column, local_doi: Column, hit_title: Column, hit_doi: Column, least: float = 0.9) -> Column:
    """struct(verified, use_doi): two DOIs decide alone; else the titles do."""
    a, b = S.normalize_doi(local_doi), S.normalize_doi(hit_doi)
    t, u = S.normalize_title(local_title), S.normalize_title(hit_title)
    there = lambda x: F.coalesce(x, F.lit("")) != ""
    alike = there(local_title) & there(hit_title) & ((t == u) | (similarity(t, u) >= least))
    both = there(local_doi) & there(hit_doi)
    return F.struct(F.when(both, a == b).otherwise(alike).alias("verified"), (both & (a == b)).alias("use_doi"))


def decided(least: float = 0.9) -> Column:
    """The decision on a document (title, doi) and its hit."""
    return verify(F.col("title"), F.col("doi"), F.col("hit.title"), F.col("hit.doi"), least)


def outcome(docs: DataFrame, decision: Column) -> DataFrame:
    """``docs`` (title, corpus, hit) as Title, Citation, Link, Corpus: the hit's if verified, else a fallback."""
    d = docs.withColumn("_d", decision)
    ok = F.col("hit").isNotNull() & F.coalesce(F.col("_d.verified"), F.lit(False))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Unknown Title"))
    cite = S.citation(F.col("hit.authors"), F.col("hit.year"), F.col("hit.title"), F.col("hit.journal"), F.col("hit.doi"))
    return d.select(
        *[c for c in docs.columns if c not in ("title", "corpus", "hit", "doi")],
        F.when(ok, F.col("hit.title")).otherwise(title).alias("Title"),
        F.when(ok, cite).otherwise(F.concat(F.lit("Document. "), title, F.lit(". (Unverified)"))).alias("Citation"),
        F.when(ok, S.hit_link(F.col("hit.doi"), F.col("hit.pmid"), F.col("_d.use_doi"), PAGE)).otherwise(F.lit(PAGE)).alias("Link"),
        F.col("corpus").alias("Corpus"),
    )


def split_failed(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep to the schema, dead letters with a reason)."""
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in ("Title", "Citation", "Link", "Corpus")], F.when(F.col("Corpus") == "", F.lit("Corpus is empty")))
    marked = enriched.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")
