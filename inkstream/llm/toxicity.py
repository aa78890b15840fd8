"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary documents, give each word's
probability byte by byte: a byte given the six before it in its word. The
highest order has counts of its own in each class (in how many documents a word
stands); both back off to the same interpolated Kneser-Ney model of lower order,
whose continuation counts are those of both classes together. So an expression
that is rare in either class still is judged by the pieces it is made of.

A document is judged by length-normalised differences of the two log-likelihoods:
of the whole text, by its words and by its bytes; of its distinct words, by the
root of their number; and, as a long text can be toxic in few places, of its most
toxic spans: the window of ``WINDOW`` words with the largest mean, the words whose
difference is above ``STRONG`` by the root of the number of words, the best word,
the mean of the best three, and the best word by the root of its length. A
logistic function of these gives the score; it is fitted on cross-fitted values
(each training document is measured by models that haven't seen its fold).

The labelled sample is bounded: at most about ``per_class`` training documents of
each class, picked by a hash of their id. Everything else covers all rows.

Defined results: null and empty texts get the score of a text in which nothing
speaks for either class; rows with null doc_ids are scored (their text for the
hash is empty); repeated rows are scored alike; labels that are null or repeated
with different values count as each value once; without labels of both classes
every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import pieces, released, staged, text_column
from .textscan import LOWER, U, _SPACE, words

APART = _SPACE.copy()
APART[[b for b in range(128) if not chr(b).isalnum()]] = True
WINDOW, FOLDS, DISCOUNT, PER_CLASS, STRONG, MEASURES = 8, 5, 0.75, 3000, 3.0, 8
NAMES = [f"m{k}" for k in range(MEASURES)]
_CTX = 6


@dataclass
class Model:
    gram: np.ndarray  # seven-byte keys, sorted
    gram_llr: np.ndarray
    context: np.ndarray  # six-byte keys, sorted
    context_llr: np.ndarray


def _keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seven-byte key at each byte of each word and at its end, and where each word's keys begin."""
    size = end - start
    room = size + _CTX + 1
    at = np.concatenate(([0], np.cumsum(room)[:-1]))
    flat = np.zeros(int(room.sum()), np.uint8)
    n = int(size.sum())
    within = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(at, size) + _CTX + within] = LOWER[buf[np.repeat(start, size) + within]]
    flat[at + room - 1] = 0x20
    key = np.zeros(len(flat), U)
    for k in range(_CTX + 1):
        key[k:] |= flat[: len(flat) - k].astype(U) << U(8 * k)
    count = size + 1
    begin = np.cumsum(count) - count
    take = np.repeat(at + _CTX, count) + np.arange(int(count.sum())) - np.repeat(begin, count)
    return key[take], begin


def _sums(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, [np.bincount(back, weights=w, minlength=len(distinct)) for w in weights]


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _shared(types: np.ndarray) -> np.ndarray:
    """Interpolated Kneser-Ney probability, of order six and below, of the last byte of each seven-byte type."""
    levels, k = [], _CTX
    grams = types
    while k >= 1:
        grams, (cont,) = _sums(grams & U((1 << 8 * k) - 1), np.ones(len(grams)))
        levels.append((k, grams, cont))
        k -= 1
    _, single, cont = levels[-1]
    p = (cont + 1) / (cont.sum() + 256)
    below = single
    for k, grams, cont in reversed(levels[:-1]):
        ctx, (total, kinds) = _sums(grams >> U(8), cont, np.ones(len(grams)))
        at = np.searchsorted(ctx, grams >> U(8))
        lower = p[np.searchsorted(below, grams & U((1 << 8 * (k - 1)) - 1))]
        p = (np.maximum(cont - DISCOUNT, 0) + DISCOUNT * kinds[at] * lower) / total[at]
        below = grams
    return p[np.searchsorted(below, types & U((1 << 8 * _CTX) - 1))]


def train(buf: np.ndarray, start: np.ndarray, end: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """From distinct words and in how many documents of each class they stand."""
    key, begin = _keys(buf, start, end)
    each = np.diff(np.append(begin, len(key)))
    gram, (ct, co) = _sums(key, np.repeat(toxic, each), np.repeat(ordinary, each))
    seen = (ct + co) > 0
    gram, ct, co = gram[seen], ct[seen], co[seen]
    lower = _shared(gram) if len(gram) else np.zeros(0)
    context, (tt, to, kt, ko) = _sums(gram >> U(8), ct, co, ct > 0, co > 0)
    at = np.searchsorted(context, gram >> U(8))

    def back(kinds, total):
        return np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)

    def prob(count, kinds, total):
        return np.where(total[at] > 0, np.maximum(count - DISCOUNT, 0) / np.maximum(total[at], 1), 0) + back(kinds, total)[at] * lower

    return Model(
        gram, (np.log(prob(ct, kt, tt)) - np.log(prob(co, ko, to))).astype(np.float32),
        context, (np.log(back(kt, tt)) - np.log(back(ko, to))).astype(np.float32),
    )


def word_llr(model: Model, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Toxic less ordinary log-likelihood of each word. A key that neither class has seen
    costs both the same lower-order probability, so only the weights of backing off differ."""
    if not len(start):
        return np.zeros(0)
    key, begin = _keys(buf, start, end)
    at, known = _lookup(model.gram, key)
    llr = np.zeros(len(key))
    llr[known] = model.gram_llr[at[known]]
    rest = np.flatnonzero(~known)
    at, known = _lookup(model.context, key[rest] >> U(8))
    llr[rest[known]] = model.context_llr[at[known]]
    return np.add.reduceat(llr, begin)


def measures(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length-normalised differences for each row; zeros for a row without words."""
    w = words(buf, offsets, apart=APART)
    n = len(offsets) - 1
    out = np.zeros((n, MEASURES))
    if not len(w.start):
        return out
    _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    own = word_llr(model, buf, w.start[first], w.end[first])
    llr, size = own[back], w.end - w.start + 1
    full = np.flatnonzero(w.count)
    begin = (np.cumsum(w.count) - w.count)[full]
    whole = np.add.reduceat(llr, begin)
    out[full, 0] = whole / w.count[full]
    out[full, 1] = whole / np.add.reduceat(size, begin)
    # distinct words, the strongest first within each row
    pair = np.unique(w.row * np.int64(len(own)) + back)
    row, value = pair // len(own), own[pair % len(own)]
    order = np.lexsort((-value, row))
    row, value = row[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kinds = np.maximum(np.bincount(row, minlength=n), 1)
    out[:, 2] = np.bincount(row, weights=value, minlength=n) / np.sqrt(kinds)
    total = np.concatenate(([0.0], np.cumsum(llr)))
    row_end = (np.cumsum(w.count))[w.row]
    i = np.arange(len(llr))
    stop = np.minimum(i + WINDOW, row_end)
    mean = (total[stop] - total[i]) / (stop - i)
    mean[(i + WINDOW > row_end) & (i != row_end - w.count[w.row])] = -np.inf
    out[full, 3] = np.maximum.reduceat(mean, begin)
    strong, toxic = value > STRONG, np.maximum(value, 0)
    out[:, 4] = np.bincount(row[strong], weights=value[strong], minlength=n) / np.sqrt(np.maximum(w.count, 1))
    out[:, 5] = np.bincount(row[place == 0], weights=toxic[place == 0], minlength=n)
    out[:, 6] = np.bincount(row[place < 3], weights=toxic[place < 3], minlength=n) / 3
    out[full, 7] = np.maximum.reduceat(llr / np.sqrt(size), begin)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the constant), and the means and scales of the inputs."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    b = np.zeros(a.shape[1])
    weight = weight / weight.mean()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        v = weight * np.maximum(p * (1 - p), 1e-6)
        penalty = ridge * len(x) / 100
        step = np.linalg.solve((a * v[:, None]).T @ a + penalty * np.eye(len(b)), a.T @ (weight * (y - p)) - penalty * b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b, mean, scale


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")


@dataclass
class Detector:
    model: Model | None
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(offsets) - 1)
        x = (measures(self.model, buf, offsets) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _sample_words(sample: DataFrame):
    """Distinct words of the sample and, for each fold and class, in how many documents they stand."""

    def run(batches):
        for b in batches:
            buf, off = text_column(b.column(0))
            slot = np.asarray(b.column(1).to_pylist(), np.int64)
            for lo, hi in pieces(off, 1 << 20):
                o = off[lo : hi + 1] - off[lo]
                part = LOWER[buf[off[lo] : off[hi]]]
                w = words(part, o, apart=APART)
                key, first = np.unique(np.column_stack((w.hash, w.row.astype(U))), axis=0, return_index=True) if len(w.row) else (None, np.zeros(0, np.int64))
                data = part.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([data[s:e] for s, e in zip(w.start[first].tolist(), w.end[first].tolist())], pa.binary()), pa.array(slot[lo:hi][w.row[first]], pa.int32())],
                    names=["word", "slot"],
                )

    return sample.select("text", "slot").mapInArrow(released(run), "word binary, slot int").groupBy("word").agg(
        *[F.count_if(F.col("slot") == i).cast("int").alias(f"n{i}") for i in range(2 * FOLDS)]
    )


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, per_class: int = PER_CLASS) -> Detector:
    """Learn from labelled documents outside the fold ``held_out``."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL").distinct()
    known = known.withColumn("fold", fold(F.col("doc_id")))
    if held_out is not None:
        known = known.where(F.col("fold") != held_out)
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Detector(None)
    share = {t: min(1.0, per_class / n) for t, n in sizes.items()}
    u = F.conv(F.substring(F.md5(F.concat(F.lit("tox|"), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    picked = known.where(u < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # about 2 * per_class rows of 16 bytes, whatever the input's size
    sample = staged(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
        .select("text", "toxic", "fold", (F.col("fold") * 2 + F.col("toxic")).alias("slot")),
        "toxic-sample",
    )
    table = _sample_words(sample).toArrow().combine_chunks()
    if not table.num_rows:
        return Detector(None)
    buf, off = text_column(table.column("word"))
    n = np.column_stack([table.column(f"n{i}").to_numpy() for i in range(2 * FOLDS)]).astype(float)
    start, end = off[:-1], off[1:]
    ordinary, toxic = n[:, 0::2], n[:, 1::2]
    final = train(buf, start, end, toxic.sum(1), ordinary.sum(1))
    folds = [i for i in range(FOLDS) if i != held_out]
    found = []
    for i in folds:  # one fold's model at a time, so that workers hold one
        rest = [j for j in folds if j != i]
        model = train(buf, start, end, toxic[:, rest].sum(1), ordinary[:, rest].sum(1))
        sent = sample.sparkSession.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            for b in batches:
                if b.num_rows:
                    x = np.vstack([measures(sent.value, buf[o[lo] : o[hi]], o[lo : hi + 1] - o[lo]) for buf, o in [text_column(b.column(0))] for lo, hi in pieces(o, 1 << 20)])
                    yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x[:, k]) for k in range(MEASURES))], names=["toxic", *NAMES])

        found.append(sample.where(F.col("fold") == i).select("text", "toxic").mapInArrow(released(run), "toxic int, " + ", ".join(f"{k} double" for k in NAMES)).toPandas())
        sent.unpersist()
    y = np.concatenate([f["toxic"].to_numpy() for f in found]).astype(float)
    x = np.vstack([f[NAMES].to_numpy() for f in found])
    if len(set(y)) < 2:
        return Detector(None)
    return Detector(final, *logistic(x, y, np.where(y == 1, 1 / share[1], 1 / share[0])))


def scored(docs: DataFrame, detector: Detector, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those of ``keep``) in the struct ``row``, and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(detector)
    packed = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            buf, off = text_column(b.column(1))
            for lo, hi in pieces(off, 1 << 20):
                s = sent.value.score(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s, pa.float64())], names=["row", "score"])

    return packed.mapInArrow(released(run), schema)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents whose score stays below ``threshold``, with their own columns."""
    kept = scored(docs, fit(docs, labels, **options)).where(F.col("score") < threshold)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=["doc_id"])
    doc_id = F.col("row").getField("doc_id")
    return found.select(doc_id.alias("doc_id"), (fold(doc_id) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
