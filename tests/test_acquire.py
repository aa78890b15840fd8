from inkstream.config import AcquisitionConfig, accelerator
from inkstream.sources import acquire, lookup


def play(url, answers, **kw):
    waits, answers = [], iter(answers)

    def fetch(_):
        x = next(answers)
        if x is None:
            raise ConnectionError
        return x

    return acquire.one(url, fetch, AcquisitionConfig(**kw), waits.append), waits


def test_outcomes():
    assert play("https://x/a", [(200, "ok")]) == (("ok", None), [0.5])
    assert play("https://x/a", [None, None, (200, "ok")]) == (("ok", None), [0.5, 1.0, 0.5, 2.0, 0.5])
    assert play("https://x/a", [None] * 3)[0] == ("", "no connection after 3 tries")
    assert play("https://x/node/1", [(403, ""), (200, "ok")]) == (("ok", None), [2.0, 4.0, 2.0])
    assert play("https://x/node/1", [(403, ""), (403, "")])[0] == ("", "status 403")
    assert play("https://x/a", [(403, "")])[0] == ("", "status 403") and play("https://x/a", [(404, "")])[0] == ("", "status 404")
    assert play("", [])[0] == ("", "no address") and play("https://x/a.PDF", [])[0] == ("", None)


def test_pages(spark):
    urls = spark.createDataFrame([("https://x/1",), ("https://x/2",), ("https://x/1",), (None,)], "url string")
    quick = AcquisitionConfig(standard_delay=0, node_delay=0, batch_pause=0)
    got = {r.url: (r.html, r.issue) for r in acquire.pages(urls, lambda: lambda u: (200, u[-1]), quick, 2).collect()}
    assert got == {"https://x/1": ("1", None), "https://x/2": ("2", None), None: ("", "no address")}


LISTING = "<table><tr><th>x</table><table><tr><td>second table</table>"


def test_listing(spark):
    page = "<table><tr><th>Title<th>D<th>W<tr><td><a href=' /node/7 '>One</a><td>about one<td>May 1<tr><td>two cells<td>only<tr><td>Two<td>about <b>two</b><td>May 2</table>" + LISTING
    got = acquire.listing(spark, "https://x.org/list", lambda u: (200, page)).orderBy("listing_pos").collect()
    assert [tuple(r) for r in got] == [("One", "about one", "May 1", "https://x.org/node/7", 0), ("Two", "about two", "May 2", "", 1)]
    for broken in (lambda u: (500, page), lambda u: (200, "no table"), lambda u: (200, LISTING)):
        assert acquire.listing(spark, "https://x.org/list", broken).count() == 0

    def lost(_):
        raise ConnectionError("gone")

    assert acquire.listing(spark, "https://x.org/list", lost).count() == 0 and not acquire.reachable("https://x", lost)
    assert acquire.reachable("https://x", lambda u: (200, "")) and not acquire.reachable("https://x", lambda u: (503, ""))


def test_http_says_who_asks(monkeypatch):
    import io
    import urllib.error

    seen = []

    class Answer(io.BytesIO):
        status = 200
        headers = type("H", (), {"get_content_charset": staticmethod(lambda: "latin-1")})

    def opened(request, timeout):
        seen.append((request.get_header("User-agent"), timeout))
        if request.full_url.endswith("no"):
            raise urllib.error.HTTPError(request.full_url, 403, "no", {}, None)
        if request.full_url.endswith("lost"):
            raise urllib.error.URLError("lost")
        return Answer("é".encode("latin-1"))

    monkeypatch.setattr("urllib.request.urlopen", opened)
    fetch = acquire.http(AcquisitionConfig(user_agent="me"))
    assert fetch("https://x/a") == (200, "é") and fetch("https://x/no") == (403, "") and seen == [("me", 20.0), ("me", 20.0)]
    try:
        fetch("https://x/lost")
        raise AssertionError
    except ConnectionError:
        pass


def test_search_terms_and_pauses():
    assert list(lookup.terms("A; title: of,  things ", " 10.1/x ")) == [("doi", '"10.1/x"[DOI]'), ("title", '"A title of things"[Title]'), ("text", "A title of things")]
    assert list(lookup.terms(None, "")) == [] and lookup.Account("k").pause == 0.1 and lookup.Account().pause == 0.35
    assert lookup.Account("k", "m").sign({"id": "1"}) == {"db": "pubmed", "id": "1", "api_key": "k", "email": "m"} and lookup.Account().sign({"id": "1"}) == {"db": "pubmed", "id": "1"}
    asked, waits = [], []

    def ask(endpoint, parameters):
        asked.append((endpoint, parameters.get("term", parameters.get("id"))))
        if len(asked) == 1:
            raise OSError
        return {2: "<r><IdList/></r>", 3: "<r><IdList><Id>7</Id><Id>8</Id></IdList></r>"}.get(len(asked), "<x/>")

    assert lookup.one("T", "10.1/x", ask, lookup.Account("k"), waits.append) == ("7", "text", "<x/>")
    assert [a for a, _ in asked] == [lookup.SEARCH] * 3 + [lookup.FETCH] and waits == [0.1] * 3
    assert lookup.one(None, None, ask, lookup.Account()) == (None, None, None) and lookup.first_id("<broken") is None


def test_accounts_come_from_settings_or_environment(spark, monkeypatch):
    monkeypatch.setenv("INKSTREAM_LOOKUP_KEY", "from env")
    assert lookup.Account.of(spark) == lookup.Account("from env", "")
    spark.conf.set("spark.inkstream.lookup.mail", "a@b")
    assert lookup.Account.of(spark) == lookup.Account("from env", "a@b")
    spark.conf.unset("spark.inkstream.lookup.mail")
    assert accelerator(spark) == ("cpu", "float32")
