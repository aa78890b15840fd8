import pytest
from pyspark.sql import functions as F

from inkstream.functions import scalars as S


def one(spark, column, **values):
    import pyspark.sql.types as T

    schema = T.StructType([T.StructField(k, T.ArrayType(T.StringType()) if isinstance(v, list) else T.StringType()) for k, v in values.items()])
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("x, want", [(" \t\u00a0\u2003a b\u001f\r\n", "a b"), ("", ""), (None, "")])
def test_strip(spark, x, want):
    assert one(spark, S.strip(F.col("x")), x=x) == want


@pytest.mark.parametrize("x, want", [("markdown='x'", "x"), ("markdown='x", "x"), ("x'", "x'"), ("markdown='a\nb'", "a\nb")])
def test_unwrap(spark, x, want):
    assert one(spark, S.unwrap_markdown(F.col("x")), x=x) == want


@pytest.mark.parametrize(
    "x, want",
    [
        ("https://doi.org/10.1234/x", "10.1234/x"[:0] or None), ("see 10.1234/abc.", "10.1234/abc"), ("10.1234/x", None), ("10.1234/abcd).,", "10.1234/abcd"),
        ("we were excited by 10.1234/abcd", None), ("References: 10.1234/abcd", None), ("", None), (None, None),
    ],
)
def test_extract_doi(spark, x, want):
    assert one(spark, S.extract_doi(F.col("x")), x=x) == want


def test_doi_beyond_the_beginning_is_not_seen(spark):
    assert one(spark, S.extract_doi(F.col("x")), x="a" * 5000 + " 10.1234/abcd") is None


@pytest.mark.parametrize("names, want", [([], "Unknown"), (["A"], "A"), (["A", "B"], "A, & B"), (["A", "B", "C"], "A, B, & C"), (["A", "B", "C", "D"], "A et al.")])
def test_authors(spark, names, want):
    assert one(spark, S.format_authors(F.col("x")), x=names) == want


def test_year_and_content(spark):
    assert one(spark, S.extract_year(F.col("x"), F.lit("2024")), x="A. (19). T (2019)") == "2019"
    assert one(spark, S.extract_year(F.col("x"), F.lit("2024")), x="none") == "2024"
    assert one(spark, S.clean_content(F.col("x")), x=" a ![f](x.png)b\\n\n\n\nc ") == "a b\n\nc"


def test_keys(spark):
    base = S.key_base(F.col("u"), F.col("t"), F.col("d"))
    assert one(spark, base, u="", t="T", d="D") == "T_D"
    assert one(spark, base, u=None, t=None, d=None) == "_"
    assert one(spark, S.rag_id(F.col("u")), u="") is None


@pytest.mark.parametrize("x, want", [("HTTPS://doi.org/10.1/X ", "10.1/x"), ("doi: 10.1/x", "10.1/x"), ("https://dx.doi.org/10.1/x", "https://dx.doi.org/10.1/x")])
def test_normalize_doi(spark, x, want):
    assert one(spark, S.normalize_doi(F.col("x")), x=x) == want


def test_normalize_title_keeps_accents_and_a_last_space(spark):
    assert one(spark, S.normalize_title(F.col("x")), x=" Été: on  ice!") == "été on ice "
