"""Record schemas of the ingestion engine."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str, nullable: bool = True) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), nullable) for n in names])


LISTING = _strings("rag_id", "title", "webpage", "description", "date", "text", "scraped_at")
CLEAN = _strings("rag_id", "title", "webpage", "description", "date", "corpus")
MANIFEST = _strings("rag_id", "file", "corpus_hash")
WEB_RECORD = _strings("content", "source", "url", "date", "version", "title", "description", "rag_id")
EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("metadata", _strings("title", "doi"))])
HIT = T.StructType([
    *_strings("pmid", "title", "doi").fields, T.StructField("authors", T.ArrayType(T.StringType())),
    *_strings("journal", "year", "citation", "link").fields,
])
ENRICHED = _strings("Title", "Citation", "Link", "Corpus", nullable=False)
PDF_RECORD = _strings("content", "source", "url", "date", "version", "title", "citation")
PROBLEM = _strings("rag_id", "title", "webpage", "issue")
