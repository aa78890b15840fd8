"""Small tables with every awkward row, and plain-Python versions of what the operators do."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return "".join(("w%x" % rng.randrange(vocabulary)) + (rng.choice([" ", " ", " ", " ", ".\n"]) if i + 1 < words else ".") for i in range(words))


def awkward():
    """Nulls in every column, empty and very long texts, repeated rows, ties, white space, non-ASCII."""
    a, b = prose(1, 120), prose(2, 300)
    rows = [
        (1, a, "en", "s1", len(a)), (2, a, "en", "s1", len(a)), (3, a + " more", "en", "s2", None), (4, "", "en", None, 0), (5, None, None, "s1", None),
        (6, " \t\n ", "fr", "s2", 4), (None, b, "fr", "s3", 1), (None, None, None, None, None), (7, "x" * 50_000, "de", "s3", 50_000), (8, prose(3, 20_000, 5000), "en", "s1", 1),
        (9, "é ü ñ 漢字 🙂 end", "es", "s2", 3), (10, "One two", "en", "s1", 7), (10, "One two", "en", "s1", 7), (11, b, "en", "s3", 1), (12, "ONE TWO", "en", "s1", 7),
        (13, "<|endoftext|> a  b   c\r\n\td", "en", "s1", 9), (14, "one", "en", "s9", 3),
    ]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)


CLASHING = ("row", "size", "score", "rank", "bucket", "copies", "u", "v", "key", "doc", "text_hash", "spans", "kept", "row_id", "sig", "salt", "length", "rep", "odd name: x")


def clashing(df):
    """Further columns with names that the operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING])
