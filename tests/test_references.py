"""References that are cut off, as in titles of limited length, against the queries' SQL."""

import duckdb
import pytest

from inkstream.operators import html
from inkstream.plans import queries as plans

ENDS = ("", " &amp;&amp", " &am", " &a", " &", " &quot", " &quo", " &amp;amp", " &amp;lt;", " &ampx;", " &check;", " &amp &amp;", " x&quoty")


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("cut"))
    page = "<html><head><title>{0}</title></head><body><div>{0}</div><article><h1>{0}</h1><p><b>{0}</b> &quot;" + "word " * 12 + "&amp; more{1}</p></article></body></html>"
    url = ("https://x.org/en/{0}", "https://x.org/fr/{0}?a=1&region=2&copy=3&amp", "https://x.org/fr/{0}?b='c'&amp;d=<e>&#39;")
    pages = [(i, url[i % 3].format(i), page.format(f"Title {i}{e}", e)) for i, e in enumerate(ENDS * 3)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", ["ingest_pages", "main_content", "page_blocks", "html_title", "listing_rows"])
def test_matches_sql(spark, cut, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{cut}/pages.parquet/*.parquet'")
    got = con.execute(plans.ORACLES[name])
    names = [c[0] for c in got.description]
    rows = [tuple(r) for r in plans.QUERIES[name](spark, cut).select(*names).collect()]
    want = got.fetchall()
    assert len(want) > 0 and sorted(rows, key=repr) == sorted(want, key=repr)


def test_references_in_attributes():
    row = "<table><tr><td><a href='https://x.org/?a=1&region=2&copy=3&amp;d=4&#39;'>T &amp;&nbsp</a><td>&eacute;&eacute<td>&apos;&#233</table>"
    assert html.rows(row) == [{"pos": 0, "title": "T &&nbsp", "description": "é&eacute", "date": "'é", "url": "https://x.org/?a=1&region=2&copy=3&d=4'"}]
