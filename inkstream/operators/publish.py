"""Retrieval records, JSON lines, combine statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S

VERSION = "1.0"


GENERIC = ("processed", "processed-json", "data")  # fixed values: folder names that name no source
DEFAULT_SOURCE = "fda_oncology"  # fixed value


def source_name(path: str) -> str:
    """A source's name from its folder. A generic name gives way to the nearest of the three folders above
    that is another; names with "fda" in them are one source."""
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    name = parts[-1] if parts else DEFAULT_SOURCE
    if name in GENERIC:
        above = reversed(parts[-4:-1])
        name = next((p for p in above if p.lower() not in GENERIC), DEFAULT_SOURCE)
    return DEFAULT_SOURCE if "fda" in name.lower() else name


def web_record(obj: Column, source: str, run_date: str) -> dict[str, Column]:
    """Columns of a web record from a map<string,string> of an object's keys; a key that is there with a
    null value counts as there. Without content the whole object's JSON stands for it."""
    has = lambda k: F.map_contains_key(obj, k)
    get = lambda k: F.try_element_at(obj, F.lit(k))
    empty = F.lit("")
    content = F.when(has("Corpus"), get("Corpus")).when(has("Description"), get("Description")).otherwise(empty)
    content = F.coalesce(F.nullif(content, empty), F.to_json(obj, {"ignoreNullFields": "false"}))
    date = F.coalesce(F.nullif(get("Date"), empty), F.lit(run_date))
    return {
        "content": S.clean_content_web(content), "source": F.lit(source), "url": F.when(has("Webpage"), get("Webpage")).otherwise(empty), "date": date, "version": F.lit(VERSION),
        "title": F.when(has("Title"), get("Title")), "description": F.when(has("Description"), get("Description")), "rag_id": F.when(has("RAG_ID"), get("RAG_ID")),
    }


def pdf_record(docs: DataFrame, source: str, run_year: str) -> DataFrame:
    """Title, Citation, Link, Corpus as a record; the date is the citation's year."""
    empty = F.lit("")
    return docs.select(
        *[c for c in docs.columns if c not in ("Title", "Citation", "Link", "Corpus")],
        S.clean_content(F.col("Corpus")).alias("content"), F.lit(source).alias("source"), F.coalesce("Link", empty).alias("url"),
        S.extract_year(F.coalesce("Citation", empty), F.lit(run_year)).alias("date"), F.lit(VERSION).alias("version"),
        F.coalesce("Title", empty).alias("title"), F.coalesce("Citation", empty).alias("citation"),
    )


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, as column ``value``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines at ``path``. ``order`` sorts within and across files (by ranges, not in one task)."""
    lines = (df.orderBy(*order) if order else df).select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines.write.mode("overwrite").text(path)


def combine_stats(objects: DataFrame, file: str, corrupt: Column) -> DataFrame:
    return objects.agg(
        F.count_distinct(file).alias("total_files"), F.count_if(~corrupt).alias("total_objects"), F.count_if(corrupt).alias("errors"),
    )
