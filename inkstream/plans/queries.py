"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..functions.rules import Rules
from ..config import AcquisitionConfig
from ..operators import cleaner, delta, enrich, html, publish
from ..sources import acquire, lookup
from . import jobs, overlay

RUN_DATE, RUN_YEAR = "2024-01-01", "2024"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RULES = Rules()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _put(template: str, x: str) -> str:
    """``template`` with ``x`` at each {0}."""
    return template.replace("{0}", x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- keys and delta ----


@query("SELECT page_id, md5(url) AS rag_id FROM pages")
def rag_id_url(spark, d):
    return table(spark, d, "pages").select("page_id", S.rag_id(F.col("url")).alias("rag_id"))


BASE_SQL = "CASE WHEN lang <> 'en' THEN 'https://example.org/' || doc_id ELSE source || '_' || lang || doc_id END"


@query(f"SELECT doc_id, md5({BASE_SQL}) AS rag_id FROM documents")
def rag_id_fallback(spark, d):
    url = F.when(F.col("lang") != "en", F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))).otherwise("")
    base = S.key_base(url, F.col("source"), F.concat("lang", F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", S.rag_id(base).alias("rag_id"))


def _keyed_pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", S.rag_id(F.col("url")).alias("rag_id"))


def _master(pages):
    """What an earlier run took: pages under /en/."""
    return pages.where(F.col("url").contains("/en/"))


@query("SELECT page_id, md5(url) AS rag_id FROM pages WHERE md5(url) NOT IN (SELECT md5(url) FROM pages WHERE contains(url, '/en/'))")
def delta_new_rows(spark, d):
    pages = _keyed_pages(spark, d)
    return delta.new_rows(pages, _master(pages), "rag_id").select("page_id", "rag_id")


@query(
    "WITH old AS (SELECT page_id, md5(url) AS rag_id FROM pages WHERE contains(url, '/en/')) "
    "SELECT page_id, md5(url) AS rag_id, 1 AS batch_no FROM pages WHERE md5(url) NOT IN (SELECT rag_id FROM old) UNION ALL SELECT page_id, rag_id, 0 FROM old"
)
def master_append(spark, d):
    pages = _keyed_pages(spark, d).select("page_id", "rag_id", "url")
    old = _master(pages)
    return delta.append(delta.new_rows(pages, old, "rag_id"), old).drop("url")


@query("SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def keep_last_per_key(spark, d):
    return delta.keep_last(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def checkpoint_skip(spark, d):
    return delta.resume(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


# ---- URL predicates and metrics ----


@query("SELECT page_id, contains(url, 'http') AS fetchable, ends_with(lower(url), '.pdf') AS pdf, contains(url, '/node/') AS node FROM pages")
def url_class(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", S.is_fetchable(u).alias("fetchable"), S.is_pdf(u).alias("pdf"), S.is_node(u).alias("node"))


NODE_SQL = "CASE WHEN lang = 'en' THEN 'https://x.org/node/' || doc_id ELSE 'https://x.org/' || doc_id END"


def _scraped(spark, d):
    url = F.concat(F.when(F.col("lang") == "en", F.lit("https://x.org/node/")).otherwise(F.lit("https://x.org/")), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", "source", url.alias("url"), (F.length("text") > 500).alias("ok"))


@query(
    f"WITH s AS (SELECT {NODE_SQL} AS url, length(text) > 500 AS ok FROM documents), c AS (SELECT count(*) AS total, count(*) FILTER (ok) AS successful, "
    "count(*) FILTER (NOT ok) AS failed, count(*) FILTER (contains(url, '/node/')) AS node_total, count(*) FILTER (ok AND contains(url, '/node/')) AS node_ok FROM s) "
    "SELECT *, CASE WHEN total > 0 THEN 100.0::DOUBLE * successful / total ELSE 0 END AS success_rate, CASE WHEN node_total > 0 THEN 100.0::DOUBLE * node_ok / node_total ELSE 0 END AS node_success_rate FROM c"
)
def scrape_stats(spark, d):
    return delta.run_stats(_scraped(spark, d), F.col("url"), F.col("ok"))


@query(f"SELECT doc_id, {NODE_SQL} AS webpage, 'No content' AS issue FROM documents WHERE NOT length(text) > 500")
def problem_records(spark, d):
    return _scraped(spark, d).where(~F.col("ok")).select("doc_id", F.col("url").alias("webpage"), F.lit("No content").alias("issue"))


@query("SELECT page_id, (row_number() OVER (ORDER BY page_id) - 1) // 10 AS batch FROM pages")
def batch_assign(spark, d):
    return delta.batches(table(spark, d, "pages").select("page_id"), "page_id").select("page_id", "batch")


@query("SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'skipped' WHEN length(d.text) > 500 THEN 'success' ELSE 'failed' END AS status, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def status_counts(spark, d):
    done = table(spark, d, "labels").select("doc_id").distinct().withColumn("done", F.lit(True))
    docs = table(spark, d, "documents").select("doc_id", (F.length("text") > 500).alias("ok")).join(done, "doc_id", "left")
    return docs.groupBy(F.when(F.col("done"), "skipped").when(F.col("ok"), "success").otherwise("failed").alias("status")).agg(F.count(F.lit(1)).alias("n"))


# ---- scalars ----

LINES_SQL = f"SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM ({overlay.SQL})"
STRIP = r"regexp_replace({0}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, {_put(STRIP, 'line')} AS line FROM ({LINES_SQL})")
def strip_lines(spark, d):
    lines = overlay.overlaid(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), S.strip(F.col("line")).alias("line"))


FOLD_SQL = "translate({0}, '–—−‘’“”', '---''''\"\"')"


@query(f"SELECT doc_id, {_put(FOLD_SQL, 'text')} AS text FROM ({overlay.SQL})")
def fold_punct(spark, d):
    return overlay.overlaid(spark, d).select("doc_id", S.fold_punct(F.col("text")).alias("text"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM ({overlay.SQL})")
def collapse_ws(spark, d):
    return overlay.overlaid(spark, d).select("doc_id", S.collapse_newlines(S.collapse_spaces(F.col("text"))).alias("text"))


IMAGES_SQL = r"regexp_replace({0}, '!\[.*?\]\(.*?\)', '', 'g')"


@query(f"SELECT doc_id, {_put(IMAGES_SQL, 'text')} AS text FROM ({overlay.SQL})")
def strip_images(spark, d):
    return overlay.overlaid(spark, d).select("doc_id", S.strip_images(F.col("text")).alias("text"))


UNESCAPE_SQL = r"replace({0}, '\n', chr(10))"


@query(f"SELECT doc_id, {_put(UNESCAPE_SQL, 'text')} AS text FROM ({overlay.SQL})")
def unescape_nl(spark, d):
    return overlay.overlaid(spark, d).select("doc_id", S.unescape_newlines(F.col("text")).alias("text"))


WRAP_SQL = "CASE WHEN lang = 'en' THEN 'markdown=''' || text || '''' WHEN lang = 'fr' THEN 'markdown=''' || text ELSE text || '''' END"
UNWRAP_SQL = "CASE WHEN starts_with({0}, 'markdown=''') THEN regexp_replace(substr({0}, 11), '''$', '') ELSE {0} END"


@query(f"SELECT doc_id, {_put(UNWRAP_SQL, 'w')} AS text FROM (SELECT doc_id, {WRAP_SQL} AS w FROM documents)")
def unwrap_md(spark, d):
    quote, head = F.lit("'"), F.lit("markdown='")
    wrapped = F.when(F.col("lang") == "en", F.concat(head, "text", quote)).when(F.col("lang") == "fr", F.concat(head, "text")).otherwise(F.concat("text", quote))
    return table(spark, d, "documents").select("doc_id", S.unwrap_markdown(wrapped).alias("text"))


def _clean_content_sql(x: str) -> str:
    inner = _put(UNESCAPE_SQL, _put(IMAGES_SQL, x))
    return _put(STRIP, f"regexp_replace({inner}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, {_clean_content_sql('text')} AS text FROM ({overlay.SQL})")
def clean_content(spark, d):
    return overlay.overlaid(spark, d).select("doc_id", S.clean_content(F.col("text")).alias("text"))


YEAR_SQL = r"coalesce(nullif(regexp_extract({0}, '\((\d{4})\)', 1), ''), '2024')"


@query(f"SELECT doc_id, {_put(YEAR_SQL, 'text')} AS year FROM ({overlay.SQL})")
def extract_year(spark, d):
    return overlay.overlaid(spark, d).select("doc_id", S.extract_year(F.col("text"), F.lit(RUN_YEAR)).alias("year"))


@query(f"SELECT doc_id, md5(text) AS content_hash FROM ({overlay.SQL})")
def content_md5(spark, d):
    return overlay.overlaid(spark, d).select("doc_id", F.md5("text").alias("content_hash"))


# ---- line predicates and the cleaner ----


def _sql_string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


HEADERS_SQL = ", ".join(_sql_string(h) for h in RULES.headers)
CUT_SQL, BOILER_SQL, DOSE_SQL = (_sql_string("(?i)" + r) for r in (RULES.cutoff_re, RULES.boilerplate_re, RULES.dosage_re))
STRIPPED_SQL = f"SELECT doc_id, line_no, {_put(STRIP, 'line')} AS line FROM ({LINES_SQL})"
FLAGS_SQL = f"""
SELECT doc_id, line_no, line, line = '' AS blank, regexp_matches(line, {DOSE_SQL}) AS d, ends_with(line, ':') AS c, regexp_matches(line, {CUT_SQL}) AS cut,
       regexp_matches(line, {BOILER_SQL}) OR line IN ({HEADERS_SQL}) AS rm
FROM ({STRIPPED_SQL})"""
AHEAD = f"OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND {RULES.horizon} FOLLOWING)"
DECIDED_SQL = f"""
WITH f AS ({FLAGS_SQL}),
g AS (SELECT *, coalesce(bool_or(d) {AHEAD}, false) AS d15,
             max(CASE WHEN NOT blank AND NOT rm THEN line_no END) OVER b AS lk, max(CASE WHEN blank THEN line_no END) OVER b AS lb,
             max(CASE WHEN NOT blank AND NOT rm THEN line_no * 2 + c::INT END) OVER b % 2 = 1 AS lc
      FROM f WINDOW b AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, d OR (c AND d15) AS x, coalesce(lc AND (lb IS NULL OR lb < lk), false) AS pc FROM g),
i AS (SELECT *, coalesce(bool_or(x) {AHEAD}, false) AS fu FROM h),
decided AS (SELECT *, min(CASE WHEN cut AND NOT fu AND NOT pc THEN line_no END) OVER (PARTITION BY doc_id) AS n FROM i)
"""


def _flagged(spark, d):
    return cleaner.flagged_lines(overlay.overlaid(spark, d), "doc_id").withColumn("line_no", F.col("line_no").cast("long"))


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, line FROM ({STRIPPED_SQL}) WHERE regexp_matches(line, {BOILER_SQL})")
def boilerplate_lines(spark, d):
    lines = _flagged(spark, d).select("doc_id", "line_no", "line")
    return lines.where(F.col("line").rlike("(?id)" + RULES.boilerplate_re))


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, line FROM ({STRIPPED_SQL}) WHERE line IN ({HEADERS_SQL})")
def header_lines(spark, d):
    return _flagged(spark, d).where(F.col("line").isin(*RULES.headers)).select("doc_id", "line_no", "line")


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, line FROM ({STRIPPED_SQL}) WHERE regexp_matches(line, {CUT_SQL})")
def cutoff_lines(spark, d):
    return _flagged(spark, d).where("cut").select("doc_id", "line_no", "line")


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, line FROM ({STRIPPED_SQL}) WHERE regexp_matches(line, {DOSE_SQL})")
def dosage_lines(spark, d):
    return _flagged(spark, d).where("d").select("doc_id", "line_no", "line")


def _decided(spark, d):
    return cleaner.decided_lines(overlay.overlaid(spark, d), "doc_id").withColumn("line_no", F.col("line_no").cast("long"))


@query(DECIDED_SQL + "SELECT doc_id, line_no::BIGINT AS line_no, fu FROM decided WHERE cut")
def lookahead_followup(spark, d):
    return _decided(spark, d).where("cut").select("doc_id", "line_no", "fu")


@query(DECIDED_SQL + "SELECT doc_id, line_no::BIGINT AS line_no, pc FROM decided WHERE cut OR blank")
def lookback_colon(spark, d):
    return _decided(spark, d).where("cut OR blank").select("doc_id", "line_no", "pc")


@query(DECIDED_SQL + "SELECT doc_id, min(n)::BIGINT AS first_cut FROM decided GROUP BY doc_id")
def first_cut(spark, d):
    return _decided(spark, d).groupBy("doc_id").agg(F.min("n").cast("long").alias("first_cut"))


_FINISHED = _put(STRIP, "regexp_replace(regexp_replace(" + _put(FOLD_SQL, "joined") + ", ' +', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
CLEAN_SQL = DECIDED_SQL + f"""
SELECT doc_id, {_FINISHED} AS corpus
FROM (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER ((n IS NULL OR line_no < n) AND (NOT blank AND NOT rm OR blank AND pc)), '') AS joined FROM decided GROUP BY doc_id)"""


@query(CLEAN_SQL)
def clean_corpus(spark, d):
    return overlay.overlaid(spark, d).select("doc_id", cleaner.clean(F.col("text")).alias("corpus"))


@query(CLEAN_SQL)
def clean_corpus_by_window(spark, d):
    return cleaner.clean_by_window(overlay.overlaid(spark, d), "doc_id")


@query(f"SELECT doc_id, doc_id || '.json' AS file, md5(corpus) AS corpus_hash FROM ({CLEAN_SQL})")
def split_manifest(spark, d):
    clean = overlay.overlaid(spark, d).select("doc_id", cleaner.clean(F.col("text")).alias("corpus"))
    return clean.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("file"), F.md5("corpus").alias("corpus_hash"))


# ---- DOI and identity ----

DOI_RE = r"""(?i)10\.\d{4,}/[^\s\]\)>",;]+"""
EXTRACT_DOI_SQL = f"""
WITH t AS (SELECT doc_id, substr(text, 1, 5000) AS head FROM ({overlay.DOI_SQL})),
m AS (SELECT doc_id, head, regexp_extract_all(head, {_sql_string(DOI_RE)}) AS found FROM t),
u AS (SELECT doc_id, head, unnest(range(len(found))) AS k, unnest(found) AS raw FROM m),
g AS (SELECT doc_id, k, regexp_replace(raw, '[.,;:\\])>]+$', '') AS doi, lower(substr(head, greatest(instr(head, raw) - 100, 1), 200)) AS near FROM u)
SELECT d.doc_id, min_by(doi, k) FILTER (length(doi) >= 10 AND contains(doi, '/') AND NOT regexp_matches(near, 'reference|cited|bibliography')) AS doi
FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id"""


@query(EXTRACT_DOI_SQL)
def extract_doi(spark, d):
    return overlay.with_doi(spark, d).select("doc_id", S.extract_doi(F.col("text")).alias("doi"))


RAW_DOI_SQL = "CASE WHEN doc_id % 3 = 0 THEN 'https://doi.org/10.1234/P' || doc_id WHEN doc_id % 5 = 0 THEN 'doi: 10.1234/x' || doc_id WHEN doc_id % 7 = 0 THEN ' 10.1234/P' || doc_id || ' ' END"
NORM_DOI_SQL = r"regexp_replace(regexp_replace(lower(trim({0})), '^https?://doi\.org/', ''), '^doi:\s*', '')"


def _raw_doi():
    i = F.col("doc_id").cast("string")
    return (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1234/P"), i)).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("doi: 10.1234/x"), i))
        .when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" 10.1234/P"), i, F.lit(" ")))
    )


@query("SELECT doc_id, " + _put(NORM_DOI_SQL, f"coalesce({RAW_DOI_SQL}, '')") + " AS doi FROM documents")
def normalize_doi(spark, d):
    return table(spark, d, "documents").select("doc_id", S.normalize_doi(_raw_doi()).alias("doi"))


NORM_TITLE_SQL = r"regexp_replace(regexp_replace(lower({0}), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')"


@query(f"SELECT doc_id, {_put(NORM_TITLE_SQL, _put(STRIP, 'text'))} AS title FROM documents")
def normalize_title(spark, d):
    return table(spark, d, "documents").select("doc_id", S.normalize_title(F.col("text")).alias("title"))


@query(f"SELECT p_partkey, 2.0::DOUBLE * length(t) / (2 * length(t) + 3) AS ratio FROM (SELECT p_partkey, {_put(NORM_TITLE_SQL, _put(STRIP, 'p_name'))} AS t FROM part)")
def title_similarity(spark, d):
    """Of each title and the same with three more characters, which the ratio finds again as one block."""
    titles = table(spark, d, "part").select("p_partkey", S.normalize_title(F.col("p_name")).alias("title"))
    return titles.select("p_partkey", enrich.similarity(F.col("title"), F.concat(F.col("title"), F.lit(" ii"))).alias("ratio"))


# ---- enrichment ----

CATALOGUE_SQL = """
SELECT p_partkey::VARCHAR AS pmid, p_name AS title, CASE WHEN p_size > 10 THEN '10.1234/p' || p_partkey END AS doi,
       CASE p_size % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['Ash, A'] WHEN 2 THEN ['Ash, A', 'Birch, B'] WHEN 3 THEN ['Ash, A', 'Birch, B', 'Cedar, C'] ELSE ['Ash, A', 'Birch, B', 'Cedar, C', 'Dill, D'] END AS authors,
       p_brand AS journal, (1980 + p_size)::VARCHAR AS year
FROM part"""


def catalogue(spark, d):
    people = ["Ash, A", "Birch, B", "Cedar, C", "Dill, D"]
    pick = lambda n: F.array(*[F.lit(p) for p in people[:n]]) if n else F.array().cast("array<string>")
    size = F.col("p_size") % 5
    authors = F.when(size == 0, pick(0)).when(size == 1, pick(1)).when(size == 2, pick(2)).when(size == 3, pick(3)).otherwise(pick(4))
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("pmid"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("10.1234/p"), F.col("p_partkey").cast("string"))).alias("doi"),
        authors.alias("authors"), F.col("p_brand").alias("journal"), (F.col("p_size") + 1980).cast("string").alias("year"),
    )


ARTICLES_SQL = f"SELECT d.doc_id, p.p_name AS title, {RAW_DOI_SQL} AS doi, text AS corpus FROM documents d LEFT JOIN part p ON p.p_partkey = d.doc_id"


def articles(spark, d):
    titles = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    return table(spark, d, "documents").join(titles, "doc_id", "left").select("doc_id", "title", _raw_doi().alias("doi"), F.col("text").alias("corpus"))


_T = _put(NORM_TITLE_SQL, "translate(trim({0}), ';:,', '   ')")
LOOKUP_SQL = f"""
WITH cat AS ({CATALOGUE_SQL}), art AS ({ARTICLES_SQL}),
by_doi AS (SELECT {_put(NORM_DOI_SQL, 'doi')} AS k, min(pmid) AS pmid FROM cat WHERE doi IS NOT NULL GROUP BY 1),
by_title AS (SELECT {_put(_T, 'title')} AS k, min(pmid) AS pmid FROM cat GROUP BY 1),
found AS (SELECT a.*, coalesce(x.pmid, y.pmid) AS pmid FROM art a LEFT JOIN by_doi x ON x.k = {_put(NORM_DOI_SQL, 'a.doi')} LEFT JOIN by_title y ON y.k = {_put(_T, 'a.title')}),
hits AS (SELECT f.*, c.title AS h_title, c.doi AS h_doi, c.authors AS h_authors, c.journal AS h_journal, c.year AS h_year FROM found f LEFT JOIN cat c ON c.pmid = f.pmid),
judged AS (
  SELECT *, CASE WHEN doi IS NOT NULL AND h_doi IS NOT NULL THEN {_put(NORM_DOI_SQL, 'doi')} = {_put(NORM_DOI_SQL, 'h_doi')}
                 ELSE title IS NOT NULL AND h_title IS NOT NULL AND {_put(NORM_TITLE_SQL, 'trim(title)')} = {_put(NORM_TITLE_SQL, 'trim(h_title)')} END AS verified,
         doi IS NOT NULL AND h_doi IS NOT NULL AND {_put(NORM_DOI_SQL, 'doi')} = {_put(NORM_DOI_SQL, 'h_doi')} AS use_doi
  FROM hits)
"""


def found(spark, d):
    return enrich.lookup(articles(spark, d), catalogue(spark, d))


@query(LOOKUP_SQL + "SELECT doc_id, pmid, h_title AS title FROM hits")
def lookup_cascade(spark, d):
    return found(spark, d).select("doc_id", "hit.pmid", "hit.title")


@query(LOOKUP_SQL + "SELECT doc_id, coalesce(verified, false) AS verified, coalesce(use_doi, false) AS use_doi FROM judged")
def verify_doc(spark, d):
    x = found(spark, d).withColumn("v", enrich.decided())
    return x.select("doc_id", F.coalesce("v.verified", F.lit(False)).alias("verified"), F.coalesce("v.use_doi", F.lit(False)).alias("use_doi"))


_N = f"length({_put(NORM_TITLE_SQL, 'trim(h_title)')})"


@query(LOOKUP_SQL + f"""SELECT doc_id, coalesce(CASE WHEN doi IS NOT NULL AND h_doi IS NOT NULL THEN use_doi ELSE title IS NOT NULL AND h_title IS NOT NULL AND 2.0 * {_N} / (2 * {_N} + 3) >= 0.9 END, false) AS verified,
       coalesce(use_doi, false) AS use_doi FROM judged""")
def verify_by_similarity(spark, d):
    """Titles three characters longer than the hit's: alike from fourteen characters on."""
    x = found(spark, d).withColumn("title", F.concat(F.col("title"), F.lit(" ed"))).withColumn("v", enrich.decided())
    return x.select("doc_id", F.coalesce("v.verified", F.lit(False)).alias("verified"), F.coalesce("v.use_doi", F.lit(False)).alias("use_doi"))


AUTHORS_SQL = "CASE WHEN len({0}) = 0 THEN 'Unknown' WHEN len({0}) = 1 THEN {0}[1] WHEN len({0}) <= 3 THEN array_to_string({0}[1:-2], ', ') || ', & ' || {0}[-1] ELSE {0}[1] || ' et al.' END"


@query(f"SELECT pmid, {_put(AUTHORS_SQL, 'authors')} AS authors FROM ({CATALOGUE_SQL})")
def format_authors(spark, d):
    return catalogue(spark, d).select("pmid", S.format_authors(F.col("authors")).alias("authors"))


def _cite_sql(p: str = "") -> str:
    return f"{_put(AUTHORS_SQL, p + 'authors')} || '. (' || {p}year || '). ' || {p}title || '. ' || {p}journal || CASE WHEN {p}doi IS NOT NULL THEN '. https://doi.org/' || {p}doi ELSE '' END"


@query(f"SELECT pmid, {_cite_sql()} AS citation FROM ({CATALOGUE_SQL})")
def citation(spark, d):
    c = F.col
    return catalogue(spark, d).select("pmid", S.citation(c("authors"), c("year"), c("title"), c("journal"), c("doi")).alias("citation"))


ENRICHED_SQL = LOOKUP_SQL + f""", enriched AS (
SELECT doc_id, CASE WHEN verified THEN h_title ELSE coalesce(nullif(title, ''), 'Unknown Title') END AS "Title",
       CASE WHEN verified THEN {_cite_sql('h_')} ELSE 'Document. ' || coalesce(nullif(title, ''), 'Unknown Title') || '. (Unverified)' END AS "Citation",
       CASE WHEN verified AND use_doi AND h_doi IS NOT NULL THEN 'https://doi.org/' || h_doi WHEN verified THEN '{enrich.PAGE}/' || pmid ELSE '{enrich.PAGE}' END AS "Link",
       corpus AS "Corpus"
FROM judged)
"""


def enriched(spark, d):
    return enrich.outcome(found(spark, d), enrich.decided())


@query(ENRICHED_SQL + "SELECT * FROM enriched")
def enriched_doc(spark, d):
    return enriched(spark, d)


@query(ENRICHED_SQL + """SELECT doc_id, 'Corpus is empty' AS reason FROM (SELECT doc_id, CASE WHEN length("Corpus") < 200 THEN '' ELSE "Corpus" END AS c FROM enriched) WHERE c = ''""")
def dead_letter(spark, d):
    short = enriched(spark, d).withColumn("Corpus", F.when(F.length("Corpus") < 200, F.lit("")).otherwise(F.col("Corpus")))
    return enrich.split_failed(short)[1].select("doc_id", "reason")


@query(ENRICHED_SQL + """SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'skipped' WHEN length("Corpus") < 200 THEN 'failed' ELSE 'success' END AS status, count(*) AS n
FROM enriched e LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = e.doc_id GROUP BY 1""")
def enrichment_status(spark, d):
    """What a run over documents makes of them; labelled ones count as done."""
    done = table(spark, d, "labels").select("doc_id").distinct()
    short = F.when(F.length("corpus") < 200, F.lit("")).otherwise(F.col("corpus"))
    good, bad = jobs.enrich_documents(spark, articles(spark, d).withColumn("corpus", short).withColumn("stem", F.col("doc_id")), done.withColumnRenamed("doc_id", "stem"), catalogue(spark, d))
    skipped = articles(spark, d).join(done, "doc_id", "left_semi").select(F.lit("skipped").alias("status"))
    every = good.select(F.lit("success").alias("status")).unionByName(bad.select(F.lit("failed").alias("status"))).unionByName(skipped)
    return every.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _service():
    """A bibliographic service that knows DOIs of even length, titles of a length divisible by three, and texts by five."""

    def ask(endpoint, parameters):
        if endpoint == lookup.FETCH:
            i = parameters["id"]
            return f"<a><PubmedArticle><ArticleTitle>Title {i}</ArticleTitle><Journal><Title>J</Title></Journal><PubDate><Year>2001</Year></PubDate><Author><LastName>Ash</LastName><ForeName>A</ForeName></Author></PubmedArticle></a>"
        for mark, letter, by in (("[DOI]", "d", 2), ("[Title]", "t", 3), ("", "x", 5)):
            if parameters["term"].endswith(mark):
                n = len(parameters["term"].removesuffix(mark).strip('"'))
                return f"<r><IdList>{f'<Id>{letter}{n}</Id>' if n % by == 0 else ''}</IdList></r>"

    return ask


SERVICE_SQL = f"""
WITH art AS (SELECT DISTINCT title, doi FROM ({ARTICLES_SQL})), n AS (SELECT title, doi, length(trim(doi)) AS d, length(title) AS t FROM art),
f AS (SELECT *, CASE WHEN d % 2 = 0 THEN 'doi' WHEN t % 3 = 0 THEN 'title' WHEN t % 5 = 0 THEN 'text' END AS found_by FROM n),
p AS (SELECT *, CASE found_by WHEN 'doi' THEN 'd' || d WHEN 'title' THEN 't' || t WHEN 'text' THEN 'x' || t END AS pmid FROM f)
SELECT title, doi, found_by, pmid, 'Ash, A. (2001). Title ' || pmid || '. J' AS citation, '{enrich.PAGE}/' || pmid AS link FROM p"""


@query(SERVICE_SQL)
def service_lookup(spark, d):
    """The cascade of searches against a stand-in for the service."""
    found = lookup.hits(articles(spark, d), _service, lookup.Account("key"), partitions=2, sleep=lambda _: None)
    return found.select("title", "doi", "found_by", "hit.pmid", "hit.citation", "hit.link")


# ---- publish ----

WEB_KEYS = (("RAG_ID", "doc_id % 2 = 0", "md5('x' || doc_id)"), ("Title", "doc_id % 3 <> 0", "source"), ("Description", "doc_id % 5 <> 1", "lang"), ("Date", "doc_id % 7 <> 0", "'May ' || doc_id"), ("Webpage", "true", "'https://x.org/' || doc_id"), ("Corpus", "doc_id % 4 <> 3", "text"))


def web_objects(spark, d):
    """Objects as maps in which keys may be absent."""
    docs = overlay.overlaid(spark, d).join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    entry = lambda k, cond, v: F.when(F.expr(cond), F.struct(F.lit(k).alias("key"), F.expr(v).alias("value")))
    return docs.select("doc_id", F.map_from_entries(F.filter(F.array(*[entry(*x) for x in WEB_KEYS]), lambda e: e.isNotNull())).alias("obj"))


_HAS = {k: cond for k, cond, _ in WEB_KEYS}
_CONTENT = f"CASE WHEN {_HAS['Corpus']} THEN text WHEN {_HAS['Description']} THEN lang ELSE '' END"
WEB_SQL = f"""
SELECT doc_id, {_put(STRIP, _put(UNESCAPE_SQL, _put(IMAGES_SQL, _put(UNWRAP_SQL, 'content'))))} AS content, 'web' AS source, url, date, '1.0' AS version, title, description, rag_id
FROM (SELECT doc_id, CASE WHEN c <> '' THEN c ELSE '{{' || array_to_string(list_filter([CASE WHEN {_HAS['RAG_ID']} THEN '"RAG_ID":"' || md5('x' || doc_id) || '"' END, CASE WHEN {_HAS['Title']} THEN '"Title":"' || source || '"' END,
        CASE WHEN {_HAS['Date']} THEN '"Date":"May ' || doc_id || '"' END, '"Webpage":"https://x.org/' || doc_id || '"'], lambda v: v IS NOT NULL), ',') || '}}' END AS content,
        'https://x.org/' || doc_id AS url, CASE WHEN {_HAS['Date']} THEN 'May ' || doc_id ELSE '{RUN_DATE}' END AS date, CASE WHEN {_HAS['Title']} THEN source END AS title,
        CASE WHEN {_HAS['Description']} THEN lang END AS description, CASE WHEN {_HAS['RAG_ID']} THEN md5('x' || doc_id) END AS rag_id
      FROM (SELECT o.doc_id, o.text, d.source, d.lang, {_CONTENT.replace('doc_id', 'o.doc_id').replace('THEN text', 'THEN o.text')} AS c FROM ({overlay.SQL}) o JOIN documents d USING (doc_id)))"""


def web_records(spark, d):
    cols = publish.web_record(F.col("obj"), "web", RUN_DATE)
    return web_objects(spark, d).select("doc_id", *[v.alias(k) for k, v in cols.items()])


@query(WEB_SQL)
def rag_record_web(spark, d):
    return web_records(spark, d)


PDF_SQL = ENRICHED_SQL + f"""SELECT doc_id, {_clean_content_sql('"Corpus"')} AS content, 'pdf' AS source, "Link" AS url, {_put(YEAR_SQL, '"Citation"')} AS date, '1.0' AS version, "Title" AS title, "Citation" AS citation FROM enriched"""


@query(PDF_SQL)
def rag_record_pdf(spark, d):
    return publish.pdf_record(enriched(spark, d), "pdf", RUN_YEAR)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def passthrough(spark, d):
    return table(spark, d, "documents")


_JSON = ", ".join(["'\"doc_id\":' || doc_id"] + [f"""CASE WHEN {c} IS NOT NULL THEN '"{c}":' || to_json({c})::VARCHAR END""" for c in ("content", "source", "url", "date", "version", "title", "description", "rag_id")])


@query(f"SELECT '{{' || array_to_string(list_filter([{_JSON}], lambda v: v IS NOT NULL), ',') || '}}' AS value FROM ({WEB_SQL})")
def jsonl_lines(spark, d):
    return publish.json_lines(web_records(spark, d))


@query("SELECT count(DISTINCT source) AS total_files, count(*) FILTER (text <> '') AS total_objects, count(*) FILTER (text = '') AS errors FROM documents")
def combine_stats(spark, d):
    return publish.combine_stats(table(spark, d, "documents"), "source", F.col("text") == "")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def objects_per_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(source, 'all') AS source, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def multi_source_total(spark, d):
    return table(spark, d, "documents").rollup("source").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("source", F.lit("all")).alias("source"), "n")


# ---- HTML ----


_TITLE = r"trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g'))"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_entity}', {_sql_string(_char)})"


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", S.strip(F.regexp_replace(html.title_of(F.col("html")), r"\s+", " ")).alias("title"))


_INNER = _put(STRIP, "regexp_replace(b, '<[^>]*>', '', 'g')")
for _entity, _char in (("&quot;", '"'), ("&amp;", "&")):
    _INNER = f"replace({_INNER}, '{_entity}', '{_char}')"
BLOCKS_SQL = f"""SELECT page_id, url, list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<(?:p|h1)>(?:[^<]|</?b>|<br>)*'),
  lambda b: {{'tag': regexp_extract(b, '^<(\\w+)', 1), 'text': {_INNER}}}), lambda s: s.text <> '') AS blocks FROM pages"""
CONTENT_SQL = f"SELECT page_id, url, CASE WHEN length(t) > 50 THEN t ELSE '' END AS text FROM (SELECT page_id, url, array_to_string(list_transform(blocks, lambda s: s.text), chr(10) || chr(10)) AS t FROM ({BLOCKS_SQL}))"


@query(f"SELECT page_id, text FROM ({CONTENT_SQL})")
def main_content(spark, d):
    return table(spark, d, "pages").select("page_id", html.main_content(F.col("html")).alias("text"))


@query(f"SELECT page_id, seq::INT AS seq, s.tag AS tag, s.text AS text FROM (SELECT page_id, unnest(range(len(blocks))) AS seq, unnest(blocks) AS s FROM ({BLOCKS_SQL}))")
def page_blocks(spark, d):
    return table(spark, d, "pages").select("page_id", F.inline(html.page_blocks(F.col("html"))))


@query(f"SELECT page_id, 0 AS pos, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title, 'page ' || page_id AS description, 'May 1' AS date, url FROM pages")
def listing_rows(spark, d):
    """Each page's title and address as a table of one row, read back from HTML."""
    pages = table(spark, d, "pages").select("page_id", "url", S.strip(F.regexp_replace(html.title_of(F.col("html")), r"\s+", " ")).alias("title"))
    escaped = lambda x: reduce(lambda y, c: F.replace(y, F.lit(c[0]), F.lit(c[1])), (("&", "&amp;"), ("<", "&lt;"), ("'", "&#39;")), F.col(x))
    row = F.concat(F.lit("<table><tr><th>h</th></tr><tr><td><a href='"), escaped("url"), F.lit("'>"), escaped("title"), F.lit("</a><td>page "), F.col("page_id").cast("string"), F.lit("<td>May 1</table>"))
    return pages.select("page_id", F.inline(html.listing_rows(row, F.lit("https://x.org/list"))))


@query(f"SELECT page_id, length(text) > 50 AS kept FROM ({CONTENT_SQL})")
def min_length(spark, d):
    text = html.main_content(F.col("html"))
    return table(spark, d, "pages").select("page_id", text.alias("text")).select("page_id", (F.length("text") > 50).alias("kept"))


# ---- acquisition ----


def _stand_in():
    return lambda url: (404, "") if len(url) % 7 == 0 else (200, f"body of {url}")


@query("SELECT DISTINCT url, CASE WHEN length(url) % 7 = 0 THEN '' ELSE 'body of ' || url END AS html, CASE WHEN length(url) % 7 = 0 THEN 'status 404' END AS issue FROM pages")
def fetch_outcomes(spark, d):
    """Fetching through a stand-in for the network, without pauses."""
    return acquire.pages(table(spark, d, "pages"), _stand_in, AcquisitionConfig(standard_delay=0, node_delay=0, batch_pause=0), partitions=2)


@query(f"SELECT md5({NODE_SQL}) AS rag_id, source AS title, {NODE_SQL} AS webpage, 'No content' AS issue FROM documents WHERE NOT length(text) > 500 ORDER BY doc_id LIMIT 5")
def first_problems(spark, d):
    rows = _scraped(spark, d).select("doc_id", F.col("source").alias("title"), F.col("url").alias("webpage"), F.when(F.col("ok"), "text").otherwise("").alias("text"), S.rag_id(F.col("url")).alias("rag_id"))
    return jobs.first_problems(rows, F.col("doc_id"))


@query("SELECT n AS done, (SELECT count(*) FROM pages) AS total FROM (SELECT row_number() OVER (ORDER BY page_id) AS n FROM pages) WHERE n % 10 = 0")
def progress_marks(spark, d):
    return delta.progress(table(spark, d, "pages").select("page_id"), "page_id")


# ---- one run from end to end ----

INGESTED = f"SELECT page_id AS doc_id, text FROM ({CONTENT_SQL}) WHERE NOT contains(url, '/en/') AND text <> ''"
INGEST_SQL = f"""
SELECT c.doc_id AS page_id, {_put(STRIP, _put(UNESCAPE_SQL, _put(IMAGES_SQL, _put(UNWRAP_SQL, 'c.corpus'))))} AS content, 'web' AS source, p.url, '{RUN_DATE}' AS date, '1.0' AS version,
       NULL::VARCHAR AS title, NULL::VARCHAR AS description, md5(p.url) AS rag_id
FROM ({CLEAN_SQL.replace(overlay.SQL, INGESTED)}) c JOIN pages p ON p.page_id = c.doc_id"""


@query(INGEST_SQL)
def ingest_pages(spark, d):
    """New pages to clean, keyed records: delta before extraction, as extraction is the costly part."""
    pages = table(spark, d, "pages").select("page_id", "url", "html", S.rag_id(F.col("url")).alias("rag_id"))
    fresh = delta.new_rows(pages, _master(pages), "rag_id")
    text = fresh.select("page_id", "url", "rag_id", html.main_content(F.col("html")).alias("text")).where("text <> ''")
    clean = text.withColumn("corpus", cleaner.clean(F.col("text")))
    obj = F.create_map(F.lit("RAG_ID"), "rag_id", F.lit("Webpage"), "url", F.lit("Corpus"), "corpus")
    return clean.select("page_id", *[v.alias(k) for k, v in publish.web_record(obj, "web", RUN_DATE).items()])
