"""Bibliographic records as XML: plain fields here, names, citation and link from the scalar functions."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..functions import scalars as S
from ..operators.enrich import PAGE

# fixed values: where the fields of a record stand
RECORD = ".//PubmedArticle"
FIELDS = {"title": ".//ArticleTitle", "journal": ".//Journal/Title", "year": ".//PubDate/Year", "doi": ".//ArticleId[@IdType='doi']"}
PERSON, PERSON_FIELDS = ".//Author", {"last": "LastName", "first": "ForeName"}
UNKNOWN = "Unknown"

_TEXTS = [T.StructField(n, T.StringType()) for n in FIELDS]
_PEOPLE = T.StructField("people", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in PERSON_FIELDS])))
RAW = T.StructType([T.StructField("found", T.BooleanType()), *_TEXTS, _PEOPLE])


def fields(xml: str | None) -> dict:
    """The first record's texts (each up to its first child element) and people; ``found`` is false for anything else."""
    try:
        record = ET.fromstring(xml or "").find(RECORD)
    except ET.ParseError:
        record = None
    if record is None:
        return {"found": False, **dict.fromkeys(FIELDS), "people": []}
    texts = {name: record.findtext(path) or None for name, path in FIELDS.items()}
    people = [{name: person.findtext(path) or None for name, path in PERSON_FIELDS.items()} for person in record.iterfind(PERSON)]
    return {"found": True, **texts, "people": people}


@F.pandas_udf(RAW)
def _raw(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fields(x) for x in xml], columns=RAW.fieldNames(), dtype=object)


def parse(xml: Column, pmid: Column) -> Column:
    """A record as a hit struct; its fields are null where the XML holds no record."""
    xml, pmid = (F.col(x) if isinstance(x, str) else x for x in (xml, pmid))

    def hit(r):
        authors = F.filter(F.transform(r.people, lambda p: S.author_name(p["last"], p["first"])), lambda a: a.isNotNull())
        title, journal, year = (F.coalesce(r[n], F.lit(UNKNOWN)) for n in ("title", "journal", "year"))
        values = {
            "pmid": pmid, "title": title, "doi": r.doi, "authors": authors, "journal": journal, "year": year,
            "citation": S.citation(authors, year, title, journal, r.doi), "link": S.hit_link(r.doi, pmid, F.lit(True), PAGE),
        }
        return F.struct(*[F.when(r.found, v).alias(k) for k, v in values.items()])

    return F.element_at(F.transform(F.array(_raw(xml)), hit), 1)
