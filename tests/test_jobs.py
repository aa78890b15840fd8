import json

from pyspark.sql import functions as F

from inkstream import cli
from inkstream.config import AcquisitionConfig
from inkstream.operators import delta, enrich, publish
from inkstream.plans import jobs
from inkstream.sources import acquire, json_files, pdf, records_xml, tables
from inkstream.streaming.ingest import ingest


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_json_objects(spark, tmp_path):
    for name, value in {"a": {"Title": "t", "Corpus": None}, "b": [{"x": 1}, {"y": {"z": 2}}], "c": [], "d": "5", "e": "{broken", "sub/f": {"q": "é"}}.items():
        put(tmp_path / f"{name}.json", value)
    rows = json_files.objects(json_files.files(spark, str(tmp_path))).collect()
    good = {(r.file_name, r.obj_pos): r.obj for r in rows if not r.corrupt}
    assert good == {("a.json", 0): {"Title": "t", "Corpus": None}, ("b.json", 0): {"x": "1"}, ("b.json", 1): {"y": '{"z":2}'}, ("f.json", 0): {"q": "é"}}
    assert sorted(r.file_name for r in rows if r.corrupt) == ["c.json", "d.json", "e.json"]
    assert json_files.objects(json_files.files(spark, str(tmp_path), recursive=False)).where("file_name = 'f.json'").count() == 0


def test_combine_and_convert(spark, tmp_path):
    src = tmp_path / "in"
    put(src / "b.json", {"RAG_ID": "k", "Corpus": "", "Description": "d"})
    put(src / "a.json", [{"Description": "two\\n![i](x)"}, {"Corpus": "c", "Date": "", "Webpage": "u", "Title": "t"}])
    stats = jobs.combine(spark, str(src), str(tmp_path / "out"), "2024-01-01").first()
    assert (stats.total_files, stats.total_objects, stats.errors) == (2, 3, 0)
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    by = {x["content"]: x for x in got}
    assert by["two"] == {"content": "two", "source": "in", "url": "", "date": "2024-01-01", "version": "1.0", "description": "two\\n![i](x)"}
    assert by["c"]["date"] == "2024-01-01" and by["c"]["title"] == "t" and "rag_id" not in by["c"]
    assert any('"RAG_ID"' in x["content"] for x in got)
    put(tmp_path / "e" / "x.json", {"Title": "T", "Citation": "A. (2019). T. J", "Link": "l", "Corpus": "c"})
    jobs.convert(spark, str(tmp_path / "e"), str(tmp_path / "o2"), "pdf", "2024")
    assert json.loads(spark.read.text(str(tmp_path / "o2")).first()[0]) == {"content": "c", "source": "pdf", "url": "l", "date": "2019", "version": "1.0", "title": "T", "citation": "A. (2019). T. J"}
    assert cli.parser().parse_args(["combine", "-d", "a", "b", "-o", "x"]).directories == ["a", "b"]


def test_source_names():
    assert publish.source_name("/x/fda-site/processed-json") == "fda_oncology"
    assert publish.source_name("/x/reports/data/processed") == "reports" and publish.source_name("/data/data/data/data") == "fda_oncology"
    assert publish.source_name("/a/reports") == "reports"


def test_incremental_is_idempotent(spark, tmp_path):
    listing = spark.createDataFrame([("t", "https://x/node/1", "d", "May 1", 0), ("t2", "", "d", "May 2", 1), ("t3", "https://x/a.PDF", "d", "", 2)], "title string, webpage string, description string, date string, listing_pos int")
    pages = spark.createDataFrame([("https://x/node/1", f"<article><p>{'word ' * 20}</p></article>")], "url string, html string")
    path = str(tmp_path / "master")
    s = jobs.incremental(spark, listing, pages, path, "2024-01-01 00:00:00").first()
    assert (s.total, s.successful, s.node_ok) == (3, 2, 1)
    assert jobs.incremental(spark, listing, pages, path, "x").first().total == 0
    assert spark.read.parquet(path).count() == 3


def test_split_upserts(spark, tmp_path):
    cases = spark.createDataFrame([("k", "old", 0), ("k", "new", 1), ("", "x", 2), (None, "x", 3)], "rag_id string, text string, position int")
    assert jobs.split_and_clean(spark, cases, str(tmp_path / "c")).count() == 2
    assert [r.corpus for r in spark.read.parquet(str(tmp_path / "c")).collect()] == ["new"]
    jobs.split_and_clean(spark, spark.createDataFrame([("j", "z", 0)], cases.schema), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_stream_restart(spark, tmp_path):
    put(tmp_path / "in" / "1.json", '{"rag_id":"a","v":"1"}\n{"rag_id":"b","v":"2"}')
    go = lambda: ingest(spark, str(tmp_path / "in"), spark.createDataFrame([], "rag_id string, v string").schema, str(tmp_path / "m"), str(tmp_path / "ck"))
    go()
    put(tmp_path / "in" / "2.json", '{"rag_id":"b","v":"3"}\n{"rag_id":"c","v":"4"}')
    go(), go()
    assert sorted((r.rag_id, r.v) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("a", "1"), ("b", "2"), ("c", "4")]


def test_verify_matrix(spark):
    rows = [("T", "10.1/a", "U", "10.1/A"), ("T", "10.1/a", "T", "10.1/b"), ("A long title here", None, "A long title hers", "10.1/a"), ("A", "10.1/a", "zzzz", None), (None, None, "T", None)]
    df = spark.createDataFrame(rows, "t string, d string, ht string, hd string")
    got = [tuple(r.v) for r in df.select(enrich.verify(F.col("t"), F.col("d"), F.col("ht"), F.col("hd")).alias("v")).collect()]
    assert got == [(True, True), (False, False), (True, False), (False, False), (False, False)]


def test_xml_and_pdf(spark, tmp_path):
    xml = """<!DOCTYPE a SYSTEM "x.dtd"><A><PubmedArticle><ArticleTitle>Lead <i>it</i> end</ArticleTitle><Journal><Title>J</Title></Journal>
    <Author><LastName>L</LastName><ForeName>F</ForeName></Author><Author><CollectiveName>C</CollectiveName></Author><ArticleId IdType="doi">10.1/x</ArticleId></PubmedArticle></A>"""
    r = records_xml.fields(xml)
    assert (r["title"], r["people"], r["year"], r["doi"]) == ("Lead ", [{"last": "L", "first": "F"}, {"last": None, "first": None}], None, "10.1/x")
    assert not records_xml.fields("<broken")["found"] and not records_xml.fields(None)["found"]
    got = spark.createDataFrame([(xml, "7"), ("<x/>", "8"), (xml.replace('IdType="doi"', 'IdType="pii"'), "9")], "x string, p string").select(records_xml.parse("x", "p").alias("h")).collect()
    assert (got[0].h.link, got[0].h.authors, got[0].h.citation) == ("https://doi.org/10.1/x", ["L, F"], "L, F. (Unknown). Lead . J. https://doi.org/10.1/x")
    assert got[1].h.title is None and got[1].h.pmid is None and got[2].h.link == f"{enrich.PAGE}/9" and got[2].h.year == "Unknown"
    (tmp_path / "a.pdf").write_bytes(b"%PDF text")

    def bad(_):
        raise ValueError

    read = pdf.text(lambda: [bad, lambda b: b.decode()])
    found = pdf.files(spark, str(tmp_path)).withColumn("text", read("content"))
    assert [(r.stem, r.text) for r in found.collect()] == [("a", "%PDF text")] and pdf.split_failed(found)[1].count() == 0


def test_numbering_and_empty_tables(spark):
    df = spark.range(100).selectExpr("(id * 7) % 100 AS x")
    assert [r.position for r in delta.numbered(df, "x").orderBy("x").collect()] == list(range(1, 101))
    assert delta.numbered(df.limit(0), "x").count() == 0
    assert delta.append(df, None).count() == 100 and tables.read_master(spark, "/tmp/no-such-table") is None


def test_enrichment_run(spark):
    catalogue = spark.createDataFrame([("7", "A Title", "10.1/a", ["L, F"], "J", "2001"), ("9", "A title", None, [], "K", "2002")], "pmid string, title string, doi string, authors array<string>, journal string, year string")
    docs = spark.createDataFrame([("a", "x", "https://doi.org/10.1/A", "text"), ("b", "A title!", None, "text"), ("c", None, None, "text"), ("d", "x", None, ""), ("e", "x", None, "text")], "stem string, title string, doi string, corpus string")
    done = spark.createDataFrame([("e",)], "stem string")
    good, bad = jobs.enrich_documents(spark, docs, done, catalogue)
    rows = {r.stem: (r.Title, r.Citation, r.Link) for r in good.collect()}
    assert rows["a"] == ("A Title", "L, F. (2001). A Title. J. https://doi.org/10.1/a", "https://doi.org/10.1/a")
    assert rows["b"] == ("A Title", "L, F. (2001). A Title. J. https://doi.org/10.1/a", f"{enrich.PAGE}/7")
    assert rows["c"] == ("Unknown Title", "Document. Unknown Title. (Unverified)", enrich.PAGE) and set(rows) == {"a", "b", "c"}
    assert [(r.stem, r.reason) for r in bad.collect()] == [("d", "Corpus is empty")]


def test_small_operators(spark, tmp_path):
    from inkstream import schemas
    from inkstream.functions import scalars as S

    old = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, text string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], old.schema)
    assert sorted(r.k for r in delta.changed_rows(new, old, "k", "text").collect()) == ["b", "c"]
    publish.write_json_lines(new, str(tmp_path / "j"), ["k"])
    assert [json.loads(r.value)["k"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ["a", "b", "c"]
    both = delta.append(new.limit(1), old)
    assert [r.batch_no for r in tables.newest_first(both, "k").collect()] == [1, 0, 0]
    names = spark.createDataFrame([("L", "F"), ("L", None), (None, "F")], "l string, f string").select(S.author_name(F.col("l"), F.col("f")).alias("n"))
    assert [r.n for r in names.collect()] == ["L, F", "L", None]
    put(tmp_path / "o" / "x.json", [{"a": 1}, {"a": 2}])
    put(tmp_path / "o" / "sub" / "x.json", {"a": 3})
    assert [tuple(r) for r in jobs.objects_per_file(spark, str(tmp_path / "o")).collect()] == [("x.json", 3)]
    for s in (schemas.LISTING, schemas.CLEAN, schemas.MANIFEST, schemas.WEB_RECORD, schemas.EXTRACTED, schemas.PDF_RECORD, schemas.PROBLEM, schemas.ENRICHED):
        assert spark.createDataFrame([], s).count() == 0


PAGE = f"<article><p>{'word ' * 20}</p></article>"


def test_incremental_parses_only_what_is_new(spark, tmp_path):
    """The join is below the Python function; a broken-off batch leaves nothing, and no folder stays beside the master."""
    fresh = spark.createDataFrame([("https://x/1",)], "webpage string")
    pages = spark.createDataFrame([(f"https://x/{k % 3}", PAGE) for k in range(9)], "url string, html string")
    texts = jobs.page_texts(fresh, pages)
    plan = texts._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda word: next(i for i, x in enumerate(plan) if word in x)
    assert depth("ArrowEvalPython") < depth("LeftSemi") and texts.count() == 1
    listing = spark.createDataFrame([("t", "https://x/1", "d", "May 1", 0)], "title string, webpage string, description string, date string, listing_pos int")
    path = str(tmp_path / "m" / "master")
    jobs.incremental(spark, listing, pages, path, "now")
    assert [p.name for p in (tmp_path / "m").iterdir()] == ["master"]
    assert jobs.unseen(spark, listing, path)[0] == "synchronized" and jobs.unseen(spark, listing, path + "2")[0] == "initial"


def test_a_watch_from_listing_to_master(spark, tmp_path):
    def table(n):
        return "<table>" + "".join(f"<tr><td><a href='/{k}'>Title {k}</a><td>d<td>May {k}" for k in range(n)) + "<tr><td><a href='/node/9'>Node<td>d<td>May 9<tr><td><a href='/a.pdf'>PDF<td>d<td>May 8</table>"

    state = {"rows": 2}

    def make_fetch(rows):
        return lambda: lambda url: (200, table(rows)) if url.endswith("/list") else (403, "") if "/node/" in url else (200, PAGE)

    quick = AcquisitionConfig(standard_delay=0, node_delay=0, batch_pause=0)
    run = lambda: jobs.watch(spark, "https://x.org/list", str(tmp_path / "master"), f"run {state['rows']}", make_fetch(state["rows"]), quick, str(tmp_path / "batch"))
    acquire.NODE_WAIT, kept = 0, acquire.NODE_WAIT
    first = run()
    assert (first.mode, first.counts["total"], first.counts["successful"], first.counts["node_ok"]) == ("initial", 4, 3, 0) and first.megabytes > 0 and first.seconds > 0
    assert [p["webpage"] for p in first.problems] == ["https://x.org/node/9"] and spark.read.json(str(tmp_path / "batch")).count() == 4
    assert run().mode == "synchronized" and not (tmp_path / "batch").exists()
    state["rows"] = 3
    again = run()
    assert (again.mode, again.counts["total"]) == ("delta", 1) and [r.title for r in spark.read.json(str(tmp_path / "batch")).collect()] == ["Title 2"]
    state["rows"] = 0
    assert jobs.watch(spark, "https://x.org/list", str(tmp_path / "master"), "x", lambda: lambda u: (200, "nothing"), quick).mode == "empty"
    assert spark.read.parquet(str(tmp_path / "master")).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["batch", "master"]
    acquire.NODE_WAIT = kept


def test_the_daily_clock():
    import datetime

    at, waits, ran = [datetime.datetime(2024, 1, 1, 8, 58)], [], []

    def sleep(s):
        waits.append(s)
        at[0] += datetime.timedelta(seconds=s * 30)

    def run():
        ran.append(at[0])
        if len(ran) == 2:
            raise ValueError

    assert jobs.daily(run, now=lambda: at[0], sleep=sleep, days=3) == 3
    assert [x.day for x in ran] == [1, 2, 3] and all(x.hour == 9 for x in ran) and set(waits) == {60.0}


def test_pdf_extraction_run(spark, tmp_path):
    src, out = tmp_path / "pdf", str(tmp_path / "out")
    src.mkdir()
    (src / "a.pdf").write_bytes(b"%PDF /Title (A \\(small\\) t\\351st) /Subject (see 10.5555/subject1) TEXT")
    (src / "b.pdf").write_bytes(b"%PDF /Title <FEFF00C9006E> doi 10.1234/in.text TEXT")
    (src / "c.pdf").write_bytes(b"%PDF unreadable")

    def convert(content):
        if b"unreadable" in content:
            raise ValueError
        return "Text of " + content.decode("latin-1")[-30:]

    counts = lambda: {r.status: r.n for r in jobs.extract_pdfs(spark, str(src), out, lambda: [convert]).collect()}
    assert counts() == {"success": 2, "failed": 1, "skipped": 0}
    assert counts() == {"success": 0, "failed": 1, "skipped": 2}
    got = {r.stem: r for r in jobs.extracted(spark, out).collect()}
    assert (got["a"].title, got["a"].doi) == ("A (small) tést", "10.5555/subject1") and (got["b"].title, got["b"].doi) == ("Én", "10.1234/in.text")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out", "pdf"]


def test_enrichment_of_a_folder(spark, tmp_path):
    catalogue = spark.createDataFrame([("7", "A Title", "10.1/a", ["L, F"], "J", "2001")], "pmid string, title string, doi string, authors array<string>, journal string, year string")
    put(tmp_path / "in" / "a.json", {"stem": "a", "text": "corpus", "metadata": {"title": "A title"}})
    put(tmp_path / "in" / "b.json", {"metadata": {"title": "x"}})
    go = lambda: {r.status: r.n for r in jobs.enrich_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "failed"), catalogue).collect()}
    assert go() == {"success": 1, "failed": 1, "skipped": 0} and go() == {"success": 0, "failed": 1, "skipped": 1}
    assert [(r.stem, r.Title, r.Link) for r in spark.read.json(str(tmp_path / "out")).collect()] == [("a", "A Title", f"{enrich.PAGE}/7")]
    assert {(r.stem, r.reason) for r in spark.read.json(str(tmp_path / "failed")).collect()} == {("b", "Corpus is empty")}


def test_lookups_leave_rows_without_keys_out_of_the_join(spark):
    catalogue = spark.createDataFrame([("7", "A Title", "10.1/a"), ("8", "a title", None), ("9", None, None)], "pmid string, title string, doi string")
    docs = spark.createDataFrame([(k, None, None) for k in range(50)] + [(100, "A title", None), (101, "zzz", "10.1/A"), (102, "A title", "10.9/none")], "k int, title string, doi string")
    got = {r.k: r.hit and r.hit.pmid for r in enrich.lookup(docs, catalogue).collect()}
    assert len(got) == 53 and {k: v for k, v in got.items() if v} == {100: "7", 101: "7", 102: "7"}
    assert enrich.lookup(docs.limit(0), catalogue).count() == 0
    plan = enrich.lookup(docs, catalogue)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


def test_sources_of_combined_objects(spark, tmp_path, monkeypatch):
    put(tmp_path / "here" / "in" / "a.json", {"Corpus": "c"})
    monkeypatch.chdir(tmp_path / "here")
    jobs.combine(spark, str(tmp_path / "here" / "in"), str(tmp_path / "o"), "2024-01-01", add_source=True)
    assert json.loads(spark.read.text(str(tmp_path / "o")).first()[0])["_source_relative"] == "in/a.json"
    monkeypatch.chdir(tmp_path)
    (tmp_path / "else").mkdir()
    monkeypatch.chdir(tmp_path / "else")
    jobs.combine(spark, str(tmp_path / "here" / "in"), str(tmp_path / "o"), "2024-01-01", add_source=True)
    assert json.loads(spark.read.text(str(tmp_path / "o")).first()[0])["_source_relative"].endswith("/here/in/a.json")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(acquire, "http", lambda config: lambda url: (200, "<p>no table"))
    assert cli.main(["watch", "https://x.org/list", str(tmp_path / "m")]) == 1 and "empty" in capsys.readouterr().out
    put(tmp_path / "in" / "a.json", [{"RAG_ID": "k", "text": "A:\n\n\nB", "Title": "t"}])
    put(tmp_path / "bad" / "a.json", "{broken")
    assert cli.main(["combine", "-d", str(tmp_path / "in"), "-o", str(tmp_path / "o1")]) == 0
    assert cli.main(["combine", "-d", str(tmp_path / "bad"), "-o", str(tmp_path / "o2"), "--no-transform"]) == 1
    assert cli.main(["clean", str(tmp_path / "in"), str(tmp_path / "c")]) == 0 and [r.corpus for r in spark.read.parquet(str(tmp_path / "c")).collect()] == ["A:\n\nB"]
    put(tmp_path / "e" / "x.json", {"Title": "T", "Citation": "A. (2019). T. J", "Link": "l", "Corpus": "c"})
    assert cli.main(["convert", "-i", str(tmp_path / "e"), "-o", str(tmp_path / "o3"), "-s", "pdf"]) == 0
    assert json.loads(spark.read.text(str(tmp_path / "o3")).first()[0])["source"] == "pdf" and "total_files" in capsys.readouterr().out
