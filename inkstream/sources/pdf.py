"""PDF files as a table, and a seam for converters (OCR models aren't part of the engine)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import scalars as S

Converter = Callable[[bytes], "str | None"]


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, stem, content of each PDF."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return read.select("path", S.stem(F.col("path")).alias("stem"), "content")


def text(make_converters: Callable[[], list[Converter]]):
    """A column function of the content: the first converter that gives text. Converters are made once for each worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        converters = make_converters()

        def one(content):
            for convert in converters:
                try:
                    found = convert(content)
                except Exception:  # a converter that fails gives way to the next
                    continue
                if found:
                    return plain(found)
            return None

        for batch in batches:
            yield batch.map(one)

    return F.pandas_udf(run, T.StringType())


def plain(result: object) -> str:
    """Text of whatever a converter returns: text, or something that holds it."""
    if isinstance(result, str):
        return result
    for name in ("text", "markdown"):
        if isinstance(getattr(result, name, None), str):
            return getattr(result, name)
    get = getattr(result, "get_markdown", None)
    return get() if callable(get) else str(result)


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
FIELDS = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "subject", "keywords")])


def _literal(raw: bytes) -> str:
    """A PDF string: with a byte order mark it is UTF-16, else one byte a character."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("utf-8" if raw[:3] == b"\xef\xbb\xbf" else "latin-1", "replace").lstrip("\ufeff")


def field(content: bytes, name: str) -> str | None:
    """The last value of /Name in the file's uncompressed parts: (text) with its escapes, or <hex>. Null if there is none."""
    found = None
    for m in re.finditer(rb"/" + name.encode() + rb"\s*(?:\(((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)|<([0-9A-Fa-f\s]*)>)", content, re.S):
        if m[2] is not None:
            digits = re.sub(rb"\s", b"", m[2])
            found = _literal(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        else:
            octal = re.sub(rb"\\([0-7]{1,3})", lambda o: bytes([int(o[1], 8) & 255]), m[1])
            plain = re.sub(rb"\\(.)", lambda e: _ESCAPES.get(e[1].decode("latin-1"), e[1].decode("latin-1")).encode("latin-1"), octal, flags=re.S)
            found = _literal(plain)
    return found.strip() or None if found is not None else None


@F.pandas_udf(FIELDS)
def embedded(content: pd.Series) -> pd.DataFrame:
    """The file's own title, subject and keywords, as far as they can be read."""
    return pd.DataFrame([{n: field(bytes(c or b""), n.capitalize()) for n in FIELDS.fieldNames()} for c in content], columns=FIELDS.fieldNames(), dtype=object)


def doi(corpus: Column, subject: Column, keywords: Column) -> Column:
    """From the text, else from the file's own fields."""
    return F.coalesce(S.extract_doi(corpus), S.extract_doi(subject), S.extract_doi(keywords))


def split_failed(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with text, failures with a reason)."""
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    return extracted.where(~empty), extracted.where(empty).withColumn("reason", F.lit("no text"))
