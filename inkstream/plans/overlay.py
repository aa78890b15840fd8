"""Marker lines laid over documents.text, so that every cleaner rule has something to act on.

The documents themselves trigger none of the rules. The lines and conditions are
the same in the queries and in their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LINES = (  # (divisor, remainder, line)
    (7, 0, "Recommended Dosage"),
    (5, 1, "Full prescribing information for item will be posted."),
    (11, 0, "Dosage by weight:"),
    (22, 0, ""),
    (3, 0, "The application was granted priority review."),
    (4, 0, "\n".join(["filler"] * 16)),
    (9, 0, "Take 120 mg orally twice daily."),
    (13, 0, "A–B “quoted”  two  spaces"),
    (6, 0, "![fig](x.png) tail\\n"),
    (10, 0, "Author. (2019). T."),
)


def text(doc_id: str = "doc_id", base: str = "text") -> Column:
    return F.concat(F.col(base), *[F.when(F.col(doc_id) % d == r, F.lit("\n" + line)).otherwise("") for d, r, line in LINES])


def overlaid(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text().alias("text"))


def with_doi(spark, sf_dir: str) -> DataFrame:
    """DOI lines first, as only the beginning is searched."""
    line = lambda d, t: F.when(F.col("doc_id") % d == 0, F.concat(F.lit(t), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise("")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.concat(line(8, "See 10.1234/abc."), line(16, "References: 10.5678/zzz"), "text").alias("text"))


def _quoted(line: str) -> str:
    return "'" + line.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL = "SELECT doc_id, text" + "".join(f" || CASE WHEN doc_id % {d} = {r} THEN chr(10) || {_quoted(line)} ELSE '' END" for d, r, line in LINES) + " AS text FROM documents"
DOI_SQL = (
    "SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'See 10.1234/abc.' || doc_id || chr(10) ELSE '' END"
    " || CASE WHEN doc_id % 16 = 0 THEN 'References: 10.5678/zzz' || doc_id || chr(10) ELSE '' END || text AS text FROM documents"
)
