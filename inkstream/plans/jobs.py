"""Whole runs: listing and pages, incremental ingest, split and clean, publish, PDF extraction, enrichment."""

from __future__ import annotations

import datetime
import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import AcquisitionConfig
from ..functions import scalars as S
from ..functions.rules import Rules
from ..operators import cleaner, delta, enrich, html, publish
from ..sources import acquire, json_files, pdf, tables

PDF_TEXT = "[PDF CONTENT - REQUIRES OCR]"  # fixed value: what stands for a PDF's text until it is converted
log = logging.getLogger(__name__)


def page_texts(fresh: DataFrame, pages: DataFrame) -> DataFrame:
    """(webpage, text) of the pages that ``fresh`` names. Pages are matched before they are parsed, as parsing is the costly
    part and no optimizer moves a join below a Python function; of a page that is there twice one is parsed."""
    wanted = fresh.select(F.col("webpage").alias("url")).where("url <> ''").distinct()
    met = pages.select("url", "html").join(wanted, "url", "left_semi").dropDuplicates(["url"])
    return met.select(F.col("url").alias("webpage"), html.main_content(F.col("html")).alias("text"))


def with_keys(listing: DataFrame) -> DataFrame:
    return listing.withColumn("rag_id", S.rag_id(S.key_base(F.col("webpage"), F.col("title"), F.col("date"))))


def unseen(spark: SparkSession, listing: DataFrame, master_path: str) -> tuple[str, DataFrame]:
    """The mode of a run (initial; delta; synchronized, if there is nothing new), and the rows that the master lacks."""
    keyed = with_keys(listing)
    master = tables.read_master(spark, master_path)
    if master is None:
        return "initial", keyed
    fresh = delta.new_rows(keyed, master, "rag_id")
    return ("synchronized" if fresh.isEmpty() else "delta"), fresh


def incremental(spark: SparkSession, listing: DataFrame, pages: DataFrame, master_path: str, run_time: str) -> DataFrame:
    """Listing rows (title, webpage, description, date, listing_pos) that the master lacks, with their page's
    text; appended to the master. Returns the run's statistics.

    ``pages`` (url, html) is a snapshot; fetching isn't part of the plan. Rows whose page gives no text enter
    the master as well and so aren't tried again. The batch is written beside the master, joins it by one rename,
    and its folder is retired; a run that was broken off before that leaves nothing in the master."""
    mode, fresh = unseen(spark, listing, master_path)
    texts = page_texts(fresh, pages)
    got = fresh.join(texts, "webpage", "left").withColumn("text", F.when(S.is_pdf(F.col("webpage")), F.lit(PDF_TEXT)).otherwise(F.coalesce("text", F.lit(""))))
    out = got.withColumn("scraped_at", F.lit(run_time)).withColumn("batch_no", F.lit(0 if mode == "initial" else 1))
    return tables.append_batch(spark, out, master_path, lambda batch: delta.run_stats(batch, F.col("webpage"), F.col("text") != ""))


@dataclass(frozen=True)
class Report:
    """How a run of the listing ended: mode (or empty, if the listing had no rows), counts, the first problems, seconds, megabytes."""

    mode: str
    counts: dict
    problems: list
    seconds: float
    megabytes: float


def watch(spark: SparkSession, list_url: str, master_path: str, run_time: str, make_fetch: Callable[[], acquire.Fetch] | None = None,
          config: AcquisitionConfig = AcquisitionConfig(), batch_path: str | None = None, partitions: int = 1, shown: int = 5) -> Report:
    """One run from the listing to the master: warm up, list, find what is new, fetch those pages, append.

    ``batch_path`` takes the new rows as JSON lines. An empty listing ends the run, and so does one that holds nothing new;
    then no batch is left behind. At most ``shown`` rows without text are reported."""
    began = time.monotonic()
    make_fetch = make_fetch or (lambda: acquire.http(config))
    fetch = make_fetch()
    acquire.reachable(list_url, fetch)
    rows = acquire.listing(spark, list_url, fetch)
    done = lambda mode, counts=None, problems=(), size=0.0: Report(mode, counts or {}, list(problems), time.monotonic() - began, size)
    if rows.isEmpty():
        log.error("%s: no rows", list_url)
        return done("empty")
    mode, fresh = unseen(spark, rows, master_path)
    if mode == "synchronized":
        log.info("nothing new")
        if batch_path:
            tables.retire(spark, batch_path)
        return done(mode)
    urls = fresh.select(F.col("webpage").alias("url")).where(S.is_fetchable(F.col("url")) & ~S.is_pdf(F.col("url")))
    fetched = f"{master_path.rstrip('/')}.pages"
    acquire.pages(urls, make_fetch, config, partitions).write.mode("overwrite").parquet(fetched)  # written, so that nothing is fetched twice
    pages = spark.read.parquet(fetched)
    counts = incremental(spark, rows, pages, master_path, run_time).first().asDict()
    new = tables.read_master(spark, master_path).where(F.col("scraped_at") == run_time)
    if batch_path:
        new.orderBy("listing_pos").select(F.to_json(F.struct(*[c for c in new.columns if c != "batch_no"])).alias("value")).write.mode("overwrite").text(batch_path)
    problems = [r.asDict() for r in first_problems(new, F.col("listing_pos"), shown).collect()]
    for p in problems:
        log.warning("%(rag_id)s: %(issue)s (%(webpage)s)", p)
    tables.retire(spark, fetched)
    report = done(mode, counts, problems, tables.megabytes(spark, master_path))
    log.info("%s: %s in %.1f s, %.1f MB", mode, counts, report.seconds, report.megabytes)
    return report


def first_problems(rows: DataFrame, order: Column, most: int = 5) -> DataFrame:
    """The first rows without text: rag_id, title, webpage, issue."""
    return rows.where("coalesce(text, '') = ''").orderBy(order).limit(most).select("rag_id", "title", "webpage", F.lit("No content").alias("issue"))


def daily(run: Callable[[], object], hour: int = 9, poll: float = 60.0, now: Callable[[], datetime.datetime] = datetime.datetime.now,
          sleep: Callable[[float], None] = time.sleep, days: int | None = None) -> int:
    """``run`` once a day from ``hour`` on, looking at the clock every ``poll`` seconds; a run that raises is logged, and the
    clock goes on. Returns how many runs there were, after ``days`` of them (without end if that is None)."""
    last, runs = None, 0
    while days is None or runs < days:
        at = now()
        if at.hour >= hour and at.date() != last:
            last, runs = at.date(), runs + 1
            try:
                run()
            except Exception:  # the next day's run is still due
                log.exception("the run of %s failed", last)
        else:
            sleep(poll)
    return runs


def split_and_clean(spark: SparkSession, cases: DataFrame, out_path: str, rules: Rules = Rules()) -> DataFrame:
    """Cases (rag_id, text, position, ...) cleaned and upserted by key; returns the manifest, which has every row."""
    kept = cases.where(F.coalesce("rag_id", F.lit("")) != "")
    clean = kept.withColumn("corpus", cleaner.clean(F.col("text"), rules)).drop("text", "scraped_at")
    tables.upsert(spark, clean, out_path, "rag_id", "position")
    return clean.select("rag_id", F.concat("rag_id", F.lit(".json")).alias("file"), F.md5("corpus").alias("corpus_hash"))


def combine(spark: SparkSession, folder: str, out: str, run_date: str, recursive: bool = True, add_source: bool = False, transform: bool = True) -> DataFrame:
    """JSON files of a folder as JSON lines at ``out``; returns the statistics. Each folder has its own output.

    ``add_source`` adds each object's file, and its path as seen from the working folder (the whole path, if it isn't below that)."""
    here = "file:" + os.getcwd().rstrip("/") + "/"
    relative = F.regexp_replace("file_path", "^file:/+", "file:/")
    relative = F.when(relative.startswith(here), F.substring(relative, len(here) + 1, 1 << 30)).otherwise(F.col("file_path"))
    rows = json_files.objects(json_files.files(spark, folder, recursive=recursive))
    good = rows.where(~F.col("corrupt"))
    if transform:
        cols = publish.web_record(F.col("obj"), publish.source_name(folder), run_date)
        value = F.struct(*[v.alias(k) for k, v in cols.items()], *([F.col("file_path").alias("_source_file"), relative.alias("_source_relative")] if add_source else []))
        lines = good.select("file_path", "obj_pos", F.to_json(value).alias("value"))
    else:
        lines = good.select("file_path", "obj_pos", F.to_json("obj", {"ignoreNullFields": "false"}).alias("value"))
    lines.orderBy("file_path", "obj_pos").select("value").write.mode("overwrite").text(out)
    return publish.combine_stats(rows, "file_path", F.col("corrupt"))


def objects_per_file(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """By base name: files of the same name in several folders count together."""
    rows = json_files.objects(json_files.files(spark, folder, recursive=recursive))
    return rows.where(~F.col("corrupt")).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))


def convert(spark: SparkSession, folder: str, out: str, source: str, run_year: str, transform: bool = True) -> DataFrame:
    """Enriched documents (Title, Citation, Link, Corpus) of a folder, not of those below it, as JSON lines."""
    rows = json_files.objects(json_files.files(spark, folder, recursive=False))
    good = rows.where(~F.col("corrupt"))
    if transform:
        names = ("Title", "Citation", "Link", "Corpus")
        docs = good.select("file_path", "obj_pos", *[F.try_element_at("obj", F.lit(n)).alias(n) for n in names])
        records = publish.pdf_record(docs, source, run_year)
        lines = records.select("file_path", "obj_pos", F.to_json(F.struct(*[c for c in records.columns if c not in ("file_path", "obj_pos")])).alias("value"))
    else:
        lines = good.select("file_path", "obj_pos", F.to_json("obj", {"ignoreNullFields": "false"}).alias("value"))
    lines.orderBy("file_path", "obj_pos").select("value").write.mode("overwrite").text(out)
    return publish.combine_stats(rows, "file_path", F.lit(False))


def extract_pdfs(spark: SparkSession, folder: str, out: str, make_converters: Callable[[], list[pdf.Converter]]) -> DataFrame:
    """PDF files of a folder that ``out`` doesn't hold yet, as JSON documents (stem, text, metadata of title and DOI).
    Returns how many were a success, failed (no text, or no converter that could read them) and were skipped."""
    files = pdf.files(spark, folder)
    done = spark.read.json(out).select("stem") if tables.exists(spark, out) and tables.megabytes(spark, out) > 0 else spark.createDataFrame([], "stem string")
    todo = delta.resume(files, done, "stem").withColumn("own", pdf.embedded(F.col("content"))).withColumn("text", pdf.text(make_converters)(F.col("content")))
    found = todo.select("stem", "text", F.struct(F.col("own.title").alias("title"), pdf.doi(F.col("text"), F.col("own.subject"), F.col("own.keywords")).alias("doi")).alias("metadata"))
    staged = f"{out.rstrip('/')}.batch"
    found.write.mode("overwrite").parquet(staged)  # converters run once
    batch = spark.read.parquet(staged)
    good, failed = pdf.split_failed(batch)
    good.write.mode("append").json(out)
    counts = {"success": good.count(), "failed": failed.count()}
    counts["skipped"] = files.count() - sum(counts.values())
    for r in failed.select("stem", "reason").limit(5).collect():
        log.warning("%s: %s", r["stem"], r["reason"])
    tables.retire(spark, staged)
    return spark.createDataFrame(list(counts.items()), "status string, n long")


def extracted(spark: SparkSession, folder: str) -> DataFrame:
    """stem, title, doi, corpus of extracted JSON documents; absent keys are null, and a text that is absent is empty."""
    read = spark.read.schema("stem string, text string, metadata struct<title:string,doi:string>").json(folder)
    name = S.stem(F.col("_metadata.file_path"))
    return read.select(F.coalesce("stem", name).alias("stem"), F.col("metadata.title").alias("title"), F.col("metadata.doi").alias("doi"), F.coalesce("text", F.lit("")).alias("corpus"))


def enrich_documents(spark: SparkSession, documents: DataFrame, done: DataFrame | None, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extracted documents (stem, title, doi, corpus) not done yet, enriched; and the dead letters."""
    todo = documents if done is None else delta.resume(documents, done, "stem")
    found = enrich.lookup(todo, catalogue)
    return enrich.split_failed(enrich.outcome(found, enrich.decided()))


def enrich_folder(spark: SparkSession, folder: str, out: str, failed: str, catalogue: DataFrame) -> DataFrame:
    """Extracted documents of a folder, enriched as JSON at ``out``; those that fail the schema at ``failed`` with the reason.
    Returns how many were a success, failed and were skipped, as ``out`` holds them already."""
    documents = extracted(spark, folder)
    done = spark.read.schema("stem string").json(out).select("stem") if tables.exists(spark, out) else None
    good, bad = enrich_documents(spark, documents, done, catalogue)
    skipped = 0 if done is None else documents.join(done.distinct(), "stem", "left_semi").count()
    staged = f"{out.rstrip('/')}.batch"
    marked = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    marked.write.mode("overwrite").parquet(staged)
    batch = spark.read.parquet(staged)
    counts = batch.agg(F.count_if(F.col("reason").isNull()).alias("success"), F.count_if(F.col("reason").isNotNull()).alias("failed")).first()
    batch.where("reason IS NULL").drop("reason").write.mode("append").json(out)
    if counts["failed"]:
        batch.where("reason IS NOT NULL").write.mode("append").json(failed)
    tables.retire(spark, staged)
    return spark.createDataFrame([("success", counts["success"]), ("failed", counts["failed"]), ("skipped", skipped)], "status string, n long")
