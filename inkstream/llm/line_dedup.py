"""Line dedup by winnowing over line hashes.

A line is deleted if it lies in a run of consecutive lines, of ``run_words``
words or more, that stands already at an earlier place (in the order of doc_id
and line). Lines are compared without white space at their ends; blank lines
don't count, and go where the lines around them go.

Grams are the shortest runs of ``gram_words`` words from each line, windows the
shortest runs of ``run_words`` words, forwards from each line and backwards from
each line. Of the grams in a window the one with the least hash is selected:
equal windows select equal grams, and neighbouring windows mostly the same one,
so these fingerprints are few and guaranteed. Their positions are joined over all
documents. Where one stands twice, its matches are extended both ways, window by
window: each window around it is held against the first place that has this very
window, and the later one is a match. Matches that meet or overlap are one
repeated run, as far as it goes in both directions; the runs of a document are
disjoint. Nothing is expanded to pairs of places; a passage that very many
documents share is one row for each of its places. Work and memory are linear in
a document's lines.

Defined results: null and empty texts stay as they are; among rows with equal
doc_id and equal text all are the same place and keep or lose the same lines;
rows with one doc_id and different texts are ordered by a hash of the text; null
doc_ids come first; an empty table gives no rows. Other columns are kept; if
there is an ``n_chars``, it is set to the new length.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .shared import pieces, released, small, staged, text_column
from .textscan import U, hash_ranges, mix, words

RUN_WORDS, GRAM_WORDS, FEW = 50, 25, 100_000
_BASE = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def _inverse(x: int) -> int:
    return pow(int(x), -1, 1 << 64)


class _Runs:
    """128-bit hashes of runs of lines, from prefix sums."""

    def __init__(self, h: np.ndarray):
        self.sums, self.undo = [], []
        n = len(h)
        with np.errstate(over="ignore"):
            for base in _BASE:
                power = np.cumprod(np.concatenate(([U(1)], np.full(max(n - 1, 0), base, U)))) if n else np.zeros(0, U)
                self.undo.append(np.cumprod(np.concatenate(([U(1)], np.full(max(n - 1, 0), U(_inverse(base)), U)))) if n else np.zeros(0, U))
                self.sums.append(np.concatenate(([U(0)], np.cumsum(h * power[:n]))))

    def hash(self, s: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[k][e + 1] - self.sums[k][s]) * self.undo[k][s] + (e - s).astype(U))


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least value of each range lo..hi (both included)."""
    table = [values]
    span = int((hi - lo + 1).max(initial=1))
    while (1 << len(table)) <= span:
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    level = np.log2(hi - lo + 1).astype(np.int64)
    level[(1 << level) > hi - lo + 1] -= 1
    out = np.empty(len(lo), values.dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << int(k)) + 1])
    return out


def windows(buf: np.ndarray, offsets: np.ndarray, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS):
    """(row, fingerprint, h1, h2, first line, last line) of all windows of the rows."""
    w = words(buf, offsets, hashed=False)
    none = np.zeros(0, np.int64)
    if not len(w.start):
        return none, none, none, none, none, none
    line_at = np.union1d(offsets[:-1][offsets[:-1] < len(buf)], np.flatnonzero(buf == 0x0A) + 1)
    line_at = line_at[line_at < len(buf)]
    of = np.searchsorted(line_at, w.start, "right") - 1
    line, first, count = np.unique(of, return_index=True, return_counts=True)  # lines that have words
    row = w.row[first]
    start, end = w.start[first], w.end[first + count - 1]
    number = line - np.searchsorted(line_at, offsets[:-1])[row]  # line number in its row
    h = hash_ranges(buf, start, end)
    runs = _Runs(h)
    upto = np.concatenate(([0], np.cumsum(count)))
    row_end = np.searchsorted(row, row, "right")  # one past the row's last line
    row_start = np.searchsorted(row, row, "left")
    i = np.arange(len(h))
    gram_end = np.searchsorted(upto, upto[i] + gram_words) - 1
    has_gram = gram_end < row_end
    gram = np.full(len(h), np.iinfo(U).max, U)
    gram[has_gram] = runs.hash(i[has_gram], gram_end[has_gram], 0)
    ahead = np.searchsorted(upto, upto[i] + run_words) - 1
    back = np.searchsorted(upto, upto[i + 1] - run_words, "right") - 1
    f, b = ahead < row_end, back >= row_start
    span = np.unique(np.stack((np.concatenate((i[f], back[b])), np.concatenate((ahead[f], i[b])))), axis=1)
    s, e = span
    if not len(s):
        return none, none, none, none, none, none
    last = np.searchsorted(gram_end, e, "right") - 1  # the last gram that ends within the window
    key = _least(gram, s, np.maximum(last, s))
    return row[s], key.view(np.int64), runs.hash(s, e, 0).view(np.int64), runs.hash(s, e, 1).view(np.int64), number[s], number[e]


def fingerprints(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(key, doc, text_hash, places): each document's fingerprints and the windows they speak for."""
    place = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])

    def run(batches):
        for batch in batches:
            buf, off = text_column(batch.column(2))
            for lo, hi in pieces(off, 1 << 20):
                row, key, h1, h2, s, e = windows(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], run_words, gram_words)
                order = np.lexsort((s, key, row))
                row, key, h1, h2, s, e = (x[order] for x in (row, key, h1, h2, s, e))
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))) if len(row) else row
                values = pa.StructArray.from_arrays([pa.array(h1), pa.array(h2), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], fields=list(place))
                rows = pa.array(lo + row[new])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[new]), batch.column(0).take(rows), batch.column(1).take(rows), pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), values)],
                    names=["key", "doc", "text_hash", "places"],
                )

    return docs.select("doc", "text_hash", "text").mapInArrow(released(run), "key long, doc long, text_hash long, places array<struct<h1:long,h2:long,s:int,e:int>>")


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(doc, text_hash, s, e): disjoint runs of lines that stand at an earlier place already. ``docs`` has doc, text_hash, text."""
    prints = staged(fingerprints(docs, run_words, gram_words), "line-prints")
    # a place counts once, so that repeated rows don't count as repeats of themselves;
    # within a place a fingerprint can speak for several windows, and any two may be equal
    often = prints.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("places")).alias("most")).where("n > 1 OR most > 1").select("key")
    at = prints.join(small(staged(often, "line-often"), FEW), "key").select("doc", "text_hash", F.inline("places"))
    at = staged(at, "line-places")
    first = at.groupBy("h1", "h2").agg(F.min(F.struct("doc", "text_hash", "s")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    later = at.join(small(staged(first, "line-firsts"), FEW), ["h1", "h2"]).where(F.struct("doc", "text_hash", "s") > F.col("first")).select("doc", "text_hash", "s", "e").distinct()
    order = W.partitionBy("doc", "text_hash").orderBy("s", "e")
    apart = F.col("s") > F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)) + 1
    runs = later.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("run", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("doc", "text_hash", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def _without(found: DataFrame) -> DataFrame:
    """row, text without the lines of its spans, n_lines and n_deleted of rows of (row, text, spans), and whether no line with words is left of a cut text."""
    schema = T.StructType([found.schema["row"], found.schema["text"], *[T.StructField(n, T.LongType()) for n in ("n_lines", "n_deleted")], T.StructField("emptied", T.BooleanType())])

    def run(batches):
        for b in batches:
            _, off = text_column(b.column(1))
            for lo, hi in pieces(off, 4 << 20):
                part = b.slice(lo, hi - lo)
                text, spans = part.column(1), part.column(2)
                cut = spans.is_valid()
                new, deleted, emptied = [], np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool)
                for r in np.flatnonzero(cut.to_numpy(zero_copy_only=False)).tolist():
                    lines = text[r].as_py().split("\n")
                    step = np.zeros(len(lines) + 1, np.int64)
                    for span in spans[r].as_py():
                        step[span["s"]] += 1
                        step[span["e"] + 1] -= 1
                    keep = np.cumsum(step[:-1]) == 0
                    kept = list(compress(lines, keep.tolist()))
                    new.append("\n".join(kept))
                    deleted[r] = len(lines) - len(kept)
                    emptied[r] = not any(x.strip(" \t\n\x0b\x0c\r") for x in kept)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pc.replace_with_mask(text, cut, pa.array(new, text.type)), pc.add(pc.cast(pc.fill_null(pc.count_substring(text, "\n"), 0), pa.int64()), 1), pa.array(deleted), pa.array(emptied)],
                    names=schema.names,
                )

    return found.mapInArrow(released(run), schema)


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS, drop_emptied: bool = False, counts: bool = False) -> DataFrame:
    """``docs`` without later repeated runs. ``drop_emptied`` leaves out documents that lose all their lines;
    ``counts`` adds n_lines and n_deleted."""
    low = F.lit(-(1 << 63))
    text = F.col("text").cast("string")
    others = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others).alias("row"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), low).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    runs = repeated_runs(packed.select("doc", "text_hash", F.coalesce("text", F.lit("")).alias("text")), run_words, gram_words)
    spans = runs.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    found = _without(packed.join(spans, ["doc", "text_hash"], "left").select("row", "text", "spans"))
    if drop_emptied:
        found = found.where("NOT emptied")
    out = {c: F.col("text") if c == "text" else F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[v.alias(k) for k, v in out.items()], *(["n_lines", "n_deleted"] if counts else []))


def op4(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), counts=True)


ORACLE = r"""
WITH numbered AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM documents),
bare AS (SELECT doc_id, no, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM numbered),
solid AS (
  SELECT *, row_number() OVER w AS k, sum(n) OVER w AS upto, sum(n) OVER w - n AS before
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM bare WHERE line <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
forwards AS (SELECT a.doc_id, a.k AS s, min(b.k) AS e FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.before >= 50 GROUP BY ALL),
backwards AS (SELECT b.doc_id, max(a.k) AS s, b.k AS e FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.before >= 50 GROUP BY ALL),
spans AS (SELECT doc_id, s, e FROM forwards UNION SELECT doc_id, s, e FROM backwards),
windows AS (
  SELECT p.doc_id, p.s, p.e, min(l.no) AS first_no, max(l.no) AS last_no, string_agg(l.line, chr(10) ORDER BY l.k) AS content
  FROM spans p JOIN solid l ON l.doc_id = p.doc_id AND l.k BETWEEN p.s AND p.e GROUP BY ALL),
repeated AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first_no) AS place FROM windows),
gone AS (SELECT DISTINCT n.doc_id, n.no FROM numbered n JOIN repeated r ON r.doc_id = n.doc_id AND r.place > 1 AND n.no BETWEEN r.first_no AND r.last_no),
kept AS (SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.no) AS text FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.no = n.no WHERE g.no IS NULL GROUP BY n.doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(len(string_split(d.text, chr(10))), 1)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_deleted
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN counted c ON c.doc_id = d.doc_id
"""
