"""Asking a bibliographic service in front of the plan: a search by DOI, by title and by free text, then the record.

How the service is asked is the caller's: ``make_ask`` gives, for each worker, a function from (endpoint,
parameters) to a body; whatever it raises counts as no answer and isn't tried again. The pause after an
answer is each partition's, so ``partitions`` times the rate is what the service sees."""

from __future__ import annotations

import os
import re
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import records_xml

Ask = Callable[[str, dict[str, str]], str]
SEARCH, FETCH = "esearch.fcgi", "efetch.fcgi"  # fixed values: endpoints
DATABASE, KEYED_PAUSE, OPEN_PAUSE = "pubmed", 0.1, 0.35  # fixed values: database, seconds between requests


@dataclass(frozen=True)
class Account:
    """Who asks. Both fields may be empty; requests with a key may follow each other sooner."""

    key: str = ""
    mail: str = ""

    @staticmethod
    def of(spark: SparkSession) -> "Account":
        """From the session's settings, else from the environment."""
        get = lambda name: spark.conf.get(f"spark.inkstream.lookup.{name}", os.environ.get(f"INKSTREAM_LOOKUP_{name.upper()}", ""))
        return Account(get("key"), get("mail"))

    @property
    def pause(self) -> float:
        return KEYED_PAUSE if self.key else OPEN_PAUSE

    def sign(self, parameters: dict[str, str]) -> dict[str, str]:
        signed = {"db": DATABASE, **parameters, "api_key": self.key, "email": self.mail}
        return {k: v for k, v in signed.items() if v}


def terms(title: str | None, doi: str | None) -> Iterator[tuple[str, str]]:
    """(kind, search term) in the order in which they are tried."""
    if doi and doi.strip():
        yield "doi", f'"{doi.strip()}"[DOI]'
    plain = " ".join(re.sub("[;:,]", " ", title or "").split())
    if plain:
        yield "title", f'"{plain}"[Title]'
        yield "text", plain


def first_id(body: str) -> str | None:
    """The first id of a search's answer."""
    try:
        return ET.fromstring(body).findtext(".//IdList/Id") or None
    except ET.ParseError:
        return None


def one(title: str | None, doi: str | None, ask: Ask, account: Account, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, str | None]:
    """(pmid, how it was found, the record's XML), as far as the service has them."""

    def answer(endpoint: str, parameters: dict[str, str]) -> str:
        try:
            body = ask(endpoint, account.sign(parameters))
        except Exception:  # no answer: the next step is tried
            return ""
        sleep(account.pause)
        return body

    for kind, term in terms(title, doi):
        if pmid := first_id(answer(SEARCH, {"term": term, "retmax": "1"})):
            return pmid, kind, answer(FETCH, {"id": pmid, "retmode": "xml"}) or None
    return None, None, None


def hits(docs: DataFrame, make_ask: Callable[[], Ask], account: Account, partitions: int = 1, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """title, doi, hit, found_by of each distinct (title, doi). Write the result before it is used: a plan that runs twice asks twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make_ask()
        for b in batches:
            found = [one(t, d, ask, account, sleep) for t, d in zip(b["title"], b["doi"])]
            yield pd.DataFrame({"title": b["title"], "doi": b["doi"], "pmid": [x[0] for x in found], "found_by": [x[1] for x in found], "xml": [x[2] for x in found]})

    asked = docs.select("title", "doi").distinct().repartition(partitions, "title", "doi")
    got = asked.mapInPandas(run, "title string, doi string, pmid string, found_by string, xml string")
    hit = records_xml.parse(F.col("xml"), F.col("pmid"))
    return got.withColumn("hit", hit).select("title", "doi", F.when(F.col("hit.title").isNotNull(), F.col("hit")).alias("hit"), "found_by")
