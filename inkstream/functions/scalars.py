"""Scalar functions as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"[\s\x1c-\x1f]"
DOI = r"""(?i)10\.\d{4,}/[^\s\]\)>",;]+"""  # fixed value
DASHES_QUOTES = ("–—−‘’“”", "---''\"\"")


def rag_id(base: Column) -> Column:
    """MD5 of a non-empty key base, else null."""
    return F.when(base != "", F.md5(base))


def key_base(url: Column, title: Column, date: Column) -> Column:
    empty = F.lit("")
    return F.when(F.coalesce(url, empty) != "", url).otherwise(F.concat(F.coalesce(title, empty), F.lit("_"), F.coalesce(date, empty)))


def strip(x: Column) -> Column:
    """White space of any kind off both ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), f"(?U)^{SPACE}+|{SPACE}+$", "")


def fold_punct(x: Column) -> Column:
    return F.translate(x, *DASHES_QUOTES)


def collapse_spaces(x: Column) -> Column:
    return F.regexp_replace(x, " +", " ")


def collapse_newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\n{3,}", "\n\n")


def strip_images(x: Column) -> Column:
    return F.regexp_replace(x, r"(?d)!\[.*?\]\(.*?\)", "")


def unescape_newlines(x: Column) -> Column:
    return F.replace(x, F.lit("\\n"), F.lit("\n"))


def unwrap_markdown(x: Column) -> Column:
    """The inside of markdown='...'; a closing quote goes only if the opening was there."""
    inner = F.substring(x, 11, 1 << 30)
    return F.when(x.startswith("markdown='"), F.regexp_replace(inner, "'$", "")).otherwise(x)


def clean_content_web(x: Column) -> Column:
    """Unwrap, images, literal newlines."""
    return strip(unescape_newlines(strip_images(unwrap_markdown(x))))


def clean_content(x: Column) -> Column:
    """Images, literal newlines, runs of newlines, strip."""
    return strip(collapse_newlines(unescape_newlines(strip_images(F.coalesce(x, F.lit(""))))))


def extract_year(citation: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(citation, r"\((\d{4})\)", 1), F.lit("")), default)


def extract_doi(text: Column, most: int = 5000) -> Column:
    """The first acceptable DOI within the first ``most`` characters: ten characters or more, and not
    within reach of words that tell of a reference list."""
    head = F.substring(text, 1, most)
    found = F.transform(F.regexp_extract_all(head, F.lit(DOI), 0), lambda d: F.struct(d.alias("raw"), F.regexp_replace(d, r"[.,;:\])>]+$", "").alias("doi")))

    def around(x):
        return F.lower(F.substr(head, F.greatest(F.position(x.raw, head) - 100, F.lit(1)), F.lit(200)))

    good = F.filter(found, lambda x: (F.length(x.doi) >= 10) & x.doi.contains("/") & ~around(x).rlike("reference|cited|bibliography"))
    return F.get(F.transform(good, lambda x: x.doi), F.lit(0))


def normalize_title(x: Column) -> Column:
    """Lower case, everything but letters, digits and _ a space, runs of white space one space; the end isn't stripped."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " ")


def normalize_doi(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"^https?://doi\.org/", ""), r"^doi:\s*", "")


def search_title(x: Column) -> Column:
    return F.translate(strip(x), ";:,", "   ")


def format_authors(authors: Column) -> Column:
    """Unknown; A; A, & B; A, B, & C; A et al."""
    n = F.size(authors)
    listed = F.concat(F.array_join(F.slice(authors, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", & "), F.element_at(authors, -1))
    return (
        F.when(authors.isNull() | (n == 0), F.lit("Unknown")).when(n == 1, F.get(authors, F.lit(0)))
        .when(n <= 3, listed).otherwise(F.concat(F.get(authors, F.lit(0)), F.lit(" et al.")))
    )


def author_name(last: Column, first: Column) -> Column:
    """Last, First; or Last; null without a last name."""
    return F.when(F.coalesce(last, F.lit("")) != "", F.concat_ws(", ", last, F.nullif(first, F.lit(""))))


def citation(authors: Column, year: Column, title: Column, journal: Column, doi: Column) -> Column:
    tail = F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit(". https://doi.org/"), doi)).otherwise("")
    return F.concat(format_authors(authors), F.lit(". ("), year, F.lit("). "), title, F.lit(". "), journal, tail)


def hit_link(doi: Column, pmid: Column, use_doi: Column, page: str) -> Column:
    return F.when(use_doi & (F.coalesce(doi, F.lit("")) != ""), F.concat(F.lit("https://doi.org/"), doi)).otherwise(F.concat(F.lit(page), F.lit("/"), pmid))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def is_fetchable(url: Column) -> Column:
    return F.coalesce(url.contains("http"), F.lit(False))


def is_pdf(url: Column) -> Column:
    return F.coalesce(F.lower(url).endswith(".pdf"), F.lit(False))


def is_node(url: Column) -> Column:
    return F.coalesce(url.contains("/node/"), F.lit(False))
