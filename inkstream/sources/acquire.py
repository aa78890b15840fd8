"""Fetching pages in front of the plan: one limiter a partition, retries, an outcome for each URL.

How a page is fetched is the caller's: ``make_fetch`` gives, for each worker, a function from a URL to
(status, body). Lost connections are tried again with growing waits; a refused node page is tried once more
after a longer wait; any other status but 200 is an empty page with its status as the issue. The work is split
into ``partitions``, which is how many requests run at once: the pause between requests is each partition's."""

from __future__ import annotations

import logging
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import AcquisitionConfig
from ..operators import html

log = logging.getLogger(__name__)

Fetch = Callable[[str], tuple[int, str]]
NODE_WAIT = 4.0  # fixed value: seconds before a refused node page is tried again


def one(url: str | None, fetch: Fetch, config: AcquisitionConfig, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str | None]:
    """(html, issue); an issue is None for a page that came."""
    if not url or "http" not in url:
        return "", "no address"
    if url.lower().endswith(".pdf"):
        return "", None  # text comes from the PDF source
    node, refused = "/node/" in url, False
    attempt = 1
    while True:
        sleep(config.node_delay if node else config.standard_delay)
        try:
            status, body = fetch(url)
        except ConnectionError:
            if attempt >= config.tries:
                return "", f"no connection after {attempt} tries"
            sleep(config.wait(attempt))
            attempt += 1
            continue
        if status == 200:
            return body, None
        if status == 403 and node and not refused:
            refused = True
            sleep(NODE_WAIT)
            continue
        return "", f"status {status}"


def pages(urls: DataFrame, make_fetch: Callable[[], Fetch], config: AcquisitionConfig = AcquisitionConfig(), partitions: int = 1) -> DataFrame:
    """url, html, issue of each distinct URL. Write the result before it is used: a plan that runs twice fetches twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch, done = make_fetch(), 0
        for batch in batches:
            rows = []
            for url in batch["url"]:
                if done and done % config.batch_rows == 0:
                    time.sleep(config.batch_pause)
                rows.append((url, *one(url, fetch, config)))
                done += 1
            yield pd.DataFrame(rows, columns=["url", "html", "issue"])

    return urls.select("url").distinct().repartition(partitions, "url").mapInPandas(run, "url string, html string, issue string")


def http(config: AcquisitionConfig = AcquisitionConfig(), limit: float | None = None) -> Fetch:
    """Fetches by HTTP under the engine's own name, with the standard library."""

    def fetch(url: str) -> tuple[int, str]:
        request = urllib.request.Request(url, headers={"User-Agent": config.user_agent, "Accept": "text/html"})
        try:
            with urllib.request.urlopen(request, timeout=limit or config.page_limit) as got:
                return got.status, got.read().decode(got.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as refused:
            return refused.code, ""
        except OSError as lost:
            raise ConnectionError(str(lost)) from lost

    return fetch


def reachable(url: str, fetch: Fetch) -> bool:
    """Whether the site answers; if not, that is logged and nothing more."""
    try:
        status, _ = fetch(url)
    except ConnectionError as lost:
        log.warning("%s: %s", url, lost)
        return False
    if status != 200:
        log.warning("%s: status %s", url, status)
    return status == 200


def listing(spark: SparkSession, url: str, fetch: Fetch) -> DataFrame:
    """The rows of the listing page's first table (title, description, date, webpage, listing_pos); none if the page can't be had."""
    try:
        status, body = fetch(url)
    except ConnectionError as lost:
        log.error("%s: %s", url, lost)
        status, body = 0, ""
    page = spark.createDataFrame([(body if status == 200 else "",)], "html string")
    rows = page.select(F.inline(html.listing_rows(F.col("html"), F.lit(url))))
    return rows.select("title", "description", "date", F.col("url").alias("webpage"), F.col("pos").alias("listing_pos"))
