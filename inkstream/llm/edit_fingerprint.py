"""Document fingerprints by randomised edit embedding.

A walk over a text's characters emits the character it stands on and then stays
or moves on, by a random bit that all texts share for this step and character
(Chakraborty, Goldenberg and Koucky's embedding). Texts a few edits apart soon
walk in step again, so their edit distance becomes a Hamming distance of the
walks. A fingerprint keeps four bits of the walk at ``SLOTS`` sampled steps. The
steps depend on the length's octave; half of those of one octave are shared with
the next, over which texts of neighbouring octaves are compared.

``near`` finds near copies by bit-sampled banding: keys of a few sampled slots
are joined, the candidates are verified on their whole fingerprints, and links
are united. Keys are made of slots that neighbouring octaves share, so that
texts on two sides of an octave's border meet. The documents of a key of few are
compared in pairs; more become a star, and where its documents stay apart, those
of different components are all compared, in blocks. So no pair that shares a key
is lost, whatever the key's size. Which pairs share one is randomised: ``recall``
in the tests holds it against all pairs.

Documents are paired with the next one in descending doc_id by buckets of ids:
each bucket also gets the first row of the bucket after it, so neighbours are
found without sorting everything in one task. A whole text is walked, whatever
its length.

Defined results: a null text is empty; an empty text's fingerprint has only
padding, and is wholly like another of that kind and unlike any other; null
doc_ids come last, equal doc_ids are ordered by a hash of the text, equal rows
are each other's neighbours; the only row of a table is its own neighbour; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import released, small, staged
from .textscan import U, mix, stream

SLOTS, STEPS, FIRST = 128, 1 << 10, 7
PAD, CHANCE = 16, 1 / 8
_BITS = (stream(STEPS * 256, 31) >> U(63)).astype(np.uint8).reshape(STEPS, 256)
_BITS[:, 255] = 0  # the mark after a text: the walk stays there
_SYMBOL = (stream(256, 32) >> U(60)).astype(np.uint8)
_SYMBOL[255] = PAD
_HEX = np.frombuffer(b"0123456789abcdef.", np.uint8)
BANDS, BAND_SLOTS, FEW = 10, 7, 1_000_000
BLOCK, TILE = 512, 512  # rows of a large key that stay together, and of these what is compared at a time


@lru_cache(None)
def steps(octave: int) -> np.ndarray:
    """The sampled steps of walks of up to 2**octave steps, ascending."""
    if octave <= FIRST:
        return np.arange(SLOTS)
    half = 1 << (octave - 1)
    u = np.unique(half + (stream(4 * SLOTS, 100 + octave) % U(half)).astype(np.int64))
    fresh = u[np.argsort(mix(u.astype(U)), kind="stable")][: SLOTS // 2] if len(u) >= SLOTS // 2 else u
    return np.concatenate((steps(octave - 1)[::2], np.sort(fresh)))


@lru_cache(None)
def shared_slots(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    _, i, j = np.intersect1d(steps(a), steps(b), return_indices=True)
    return i, j


def octaves(n: np.ndarray) -> np.ndarray:
    return np.maximum(FIRST, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def codes(texts: list[str]) -> np.ndarray:
    """One byte for each character; ASCII is itself, all else is hashed to 128..254."""
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = x.astype(np.uint8)
    far = np.flatnonzero(x >= 128)
    out[far] = 128 + (mix(x[far].astype(U)) % U(127)).astype(np.uint8)
    return out


def walk(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(octave of each text, its SLOTS symbols). All texts walk in step, the longest first."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-n, kind="stable")
    symbols = np.full((len(texts), SLOTS), PAD, np.uint8)
    octave = octaves(n)
    flat = np.full(int(n.sum()) + len(texts), 255, np.uint8)
    begin = np.cumsum(n + 1) - n - 1
    body = np.ones(len(flat), bool)
    body[begin + n] = False
    flat[body] = codes(texts)
    who, pos, stop = order, begin[order], (begin + n)[order]
    plan: dict[int, list[tuple[int, int]]] = {}
    for o in np.unique(octave).tolist():
        for slot, step in enumerate(steps(o).tolist()):
            plan.setdefault(step, []).append((o, slot))
    step = 0
    char, bit = np.empty(len(who), np.uint8), np.empty(len(who), np.uint8)
    while len(who):
        if step % 256 == 0:
            alive = pos < stop
            if not alive.all():
                who, pos, stop = who[alive], pos[alive], stop[alive]
                if not len(who):
                    break
            char, bit = char[: len(who)], bit[: len(who)]
            down = -octave[who]
        np.take(flat, pos, out=char, mode="clip")
        if step in plan:
            for o, slot in plan[step]:
                lo, hi = np.searchsorted(down, -o, "left"), np.searchsorted(down, -o, "right")
                if hi > lo:
                    symbols[who[lo:hi], slot] = _SYMBOL[char[lo:hi]]
        np.take(_BITS[step % STEPS], char, out=bit, mode="clip")
        pos += bit
        step += 1
    return octave, symbols


def text_of(octave: np.ndarray, symbols: np.ndarray) -> list[str]:
    """Fingerprints as text: the octave in two digits, then a hex digit or a dot for each slot."""
    rows = _HEX[symbols]
    return [f"{o:02d}{r.tobytes().decode()}" for o, r in zip(octave.tolist(), rows)]


def likeness(oa: np.ndarray, a: np.ndarray, ob: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Agreement of walks over the slots that both octaves share and either text reaches, less what chance gives; 0 to 1."""
    out = np.zeros(len(oa))
    pair = oa * 64 + ob
    for p in np.unique(pair).tolist():
        at = np.flatnonzero(pair == p)
        i, j = shared_slots(p // 64, p % 64)
        x, y = a[at][:, i], b[at][:, j]
        live = (x != PAD) | (y != PAD)
        count = live.sum(1)
        agree = ((x == y) & live).sum(1) / np.maximum(count, 1)
        out[at] = np.where(count > 0, np.maximum(0, (agree - CHANCE) / (1 - CHANCE)), float(p // 64 == p % 64))
    return out


def read(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Octaves and symbols of fingerprints in text form."""
    raw = np.frombuffer("".join(texts).encode(), np.uint8).reshape(len(texts), SLOTS + 2)
    digit = np.zeros(256, np.uint8)
    digit[_HEX] = np.arange(len(_HEX))
    return (raw[:, 0] - 48).astype(np.int64) * 10 + raw[:, 1] - 48, digit[raw[:, 2:]]


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_BATCH = 10_000_000  # characters that walk together


def _judge(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
    after = [*texts[1:], following]
    other = [edited(a, b) for a, b in zip(texts, after)]
    n = len(texts)
    octave, symbols = walk([*texts, following, *other])
    own, nxt, ed = slice(0, n), slice(1, n + 1), slice(n + 1, 2 * n + 1)
    rows = [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in other],
        text_of(octave[own], symbols[own]), text_of(octave[ed], symbols[ed]),
        likeness(octave[own], symbols[own], octave[ed], symbols[ed]), likeness(octave[own], symbols[own], octave[nxt], symbols[nxt]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, _KINDS)], names=[x.split()[0] for x in OUT.split(", ")])


def _bucketed(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """(bucket, border, doc_id, hash, text): a bucket's rows, and the row that comes after its last one (border 1)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id").agg(F.count(F.lit(1)), F.count("doc_id")).first()
    n = max(1, min(-(-rows[0] // bucket_rows), 100_000))
    nulls = max(1, min(-(-(rows[0] - rows[1]) // bucket_rows), 100_000))  # rows without an id are dealt by the text's hash, by which they are ordered
    bounds = docs.select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 and rows[1] else []
    bounds = np.unique(np.array(bounds, np.float64).astype(np.int64))

    def bucket(doc_id, text_hash) -> np.ndarray:
        k = np.searchsorted(bounds, doc_id.fill_null(0).to_numpy(zero_copy_only=False), "right") + 1
        at = text_hash.to_numpy(zero_copy_only=False).astype(np.float64) / 2.0**64 + 0.5
        return np.where(doc_id.is_null().to_numpy(zero_copy_only=False), np.minimum((at * nulls).astype(np.int64), nulls - 1) - nulls + 1, k).astype(np.int64)

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket(b.column(0), b.column(1))), *b.columns], names=["bucket", *b.schema.names])

    keyed = docs.withColumn("hash", F.xxhash64("text"))
    placed = keyed.select("doc_id", "hash").mapInArrow(released(place), "bucket long, doc_id long, hash long")
    # one row for each bucket: at most 100,000
    heads = {r["bucket"]: (r["h"]["doc_id"], r["h"]["hash"]) for r in placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "hash")).alias("h")).collect()}
    falling = sorted(heads, reverse=True)
    before = {k: falling[i - 1] for i, k in enumerate(falling)}  # the first bucket comes after the last

    def deal(batches):
        for b in batches:
            ids, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
            k = bucket(b.column(0), b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.zeros(len(k), np.int32)), *b.columns], names=["bucket", "border", *b.schema.names])
            first = [i for i, x in enumerate(k.tolist()) if heads[x] == (ids[i], hashes[i])]
            if first:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([before[int(k[i])] for i in first], pa.int64()), pa.array([1] * len(first), pa.int32()), *[c.take(pa.array(first)) for c in b.columns]],
                    names=["bucket", "border", *b.schema.names],
                )

    return keyed.select("doc_id", "hash", "text").mapInArrow(released(deal), "bucket long, border int, doc_id long, hash long, text string")


def fingerprints(docs: DataFrame, bucket_rows: int = 2000) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how alike it and its neighbours are."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = _bucketed(docs, bucket_rows).repartition("bucket").sortWithinPartitions("bucket", "border", F.col("doc_id").desc_nulls_last(), F.col("hash").desc())

    def run(batches):
        ids, texts, size, at = [], [], 0, None
        for b in batches:
            for bucket, border, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), (x.as_py() for x in b.column(4))):
                if texts and (border or size > _BATCH):
                    yield _judge(ids, texts, text)
                    ids, texts, size = [], [], 0
                if not border:
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)

    return dealt.mapInArrow(released(run), OUT)


@lru_cache(None)
def _picks(slots: int) -> np.ndarray:
    """Which of a level's slots each band samples."""
    take = {8: 3, 16: 6}.get(slots, BAND_SLOTS)
    return np.stack([np.sort(np.argsort(stream(slots * (k + 1), 500)[-slots:], kind="stable")[:take]) for k in range(BANDS)])


def _levels(octave: int, live: int, live_even: int) -> list[tuple[int, np.ndarray]]:
    """(level, slots) in which a fingerprint is looked up: the slots it shares with the octave below, and those that
    it shares with the octave above if it reaches far enough to be like a text of that. Within the first octave the
    number of slots that are reached takes the octave's place."""
    even = np.arange(0, SLOTS, 2)
    if octave > FIRST:
        return [(octave - 1, np.arange(SLOTS // 2))] + ([(octave, even)] if live_even >= SLOTS // 4 else [])
    v = max(3, int(live - 1).bit_length())
    below = [(v - 1, np.arange(1 << (v - 1)))] if v > 3 else []
    return below + ([(v, even if v == FIRST else np.arange(1 << v))] if live >= 0.6 * (1 << v) or v == 3 else [])


def band_keys(octave: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all bands of all fingerprints; those of empty texts have none."""
    live, even = (symbols != PAD).sum(1), (symbols[:, ::2] != PAD).sum(1)
    kinds: dict[tuple, list[int]] = {}
    for r, (o, n, e) in enumerate(zip(octave.tolist(), live.tolist(), even.tolist())):
        if n:
            for level, slots in _levels(o, n, e):
                kinds.setdefault((level, slots[-1], len(slots)), []).append(r)
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for (level, last, size), r in kinds.items():
        at = np.array(r)
        own = symbols[at][:, np.arange(size) * 2 if last >= size else np.arange(size)]
        for k, pick in enumerate(_picks(size)):
            with np.errstate(over="ignore"):
                h = np.full(len(at), U(level * BANDS + k + 1) * U(0x9E3779B97F4A7C15))
                for s in pick:
                    h = mix(h * U(17) + own[:, s].astype(U))
            rows.append(at)
            keys.append(h)
    return np.concatenate(rows), np.concatenate(keys)


def _bands(own: DataFrame) -> DataFrame:
    """(doc_id, key) of rows of doc_id and fingerprint."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                row, key = band_keys(*read(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(key.view(np.int64))], names=["doc_id", "key"])

    return own.mapInArrow(released(run), "doc_id long, key long")


def _groups(bands: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that several documents have, with the key's number of documents; and the candidate pairs: all of a key
    of ``few`` documents at most, else a star around the least document."""
    least = bands.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = staged(bands.join(small(staged(least, "band-leads"), FEW // 4), "key"), "bands")
    star = rows.where((F.col("n") > few) & (F.col("lead") != F.col("doc_id"))).select("lead", "doc_id")
    x = rows.where(F.col("n") <= few).select("key", "doc_id")
    pairs = x.withColumnRenamed("doc_id", "lead").join(x, "key").where("lead < doc_id").select("lead", "doc_id")
    return rows, star.unionByName(pairs)


def _verified(pairs: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    both = pairs.distinct().join(own, "doc_id").join(own.select(F.col("doc_id").alias("lead"), F.col("fingerprint").alias("other")), "lead")

    def run(batches):
        for b in batches:
            if b.num_rows:
                ok = likeness(*read(b.column(2).to_pylist()), *read(b.column(3).to_pylist())) >= threshold
                yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(ok)) for k in (0, 1)], names=["u", "v"])

    return staged(both.select("lead", "doc_id", "fingerprint", "other").mapInArrow(released(run), "u long, v long"), "print-links")


def across(octave: np.ndarray, symbols: np.ndarray, label: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of rows with a likeness of ``threshold`` or more: enough to join all rows that such pairs join. Rows of one label
    are joined already. If there are two sides, rows are compared with those of the other one only."""
    label, found = np.unique(label, return_inverse=True)[1], []
    order = np.lexsort((label, octave, side))
    turns = np.flatnonzero(np.diff(side[order] * 64 + octave[order])) + 1
    tiles = [run[k : k + TILE] for run in np.split(order, turns) for k in range(0, len(run), TILE)]
    for n, x in enumerate(tiles):
        for y in tiles[n:]:
            if side.any() and not side.all() and side[x[0]] == side[y[0]]:
                continue
            apart = label[x][:, None] != label[y]
            i, j = shared_slots(int(octave[x[0]]), int(octave[y[0]]))
            if not len(i) or not apart.any():
                continue
            a, b = np.ascontiguousarray(symbols[x][:, i].T), np.ascontiguousarray(symbols[y][:, j].T)
            agree = np.zeros(apart.shape, np.uint8)
            for p, q in zip(a, np.where(b == PAD, PAD + 1, b).astype(np.uint8)):
                agree += p[:, None] == q
            live = np.maximum((a != PAD).sum(0)[:, None], (b != PAD).sum(0))  # a walk that has ended stays so: either reaches what the longer one does
            u, v = np.nonzero(apart & (np.maximum(0, (agree / np.maximum(live, 1) - CHANCE) / (1 - CHANCE)) >= threshold))
            u, v = x[u], y[v]
            while len(u):
                for k in np.unique(u, return_index=True)[1].tolist():
                    if label[u[k]] != label[v[k]]:
                        label[label == label[v[k]]] = label[u[k]]
                        found.append((int(u[k]), int(v[k])))
                still = label[u] != label[v]
                u, v = u[still], v[still]
    return found


def _in_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links between the documents of a key that are in different components. ``rows`` has key, n (its number of
    documents), doc_id, component, fingerprint. They are dealt into blocks of about ``BLOCK`` rows, and every two blocks are a
    group of their own, so that no task holds more than two blocks of a key."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "doc_id"), F.col("blocks")).cast("int"))
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = every.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id", "component", "fingerprint")

    def compare(table: pa.Table) -> pa.Table:
        doc_id, component, own, low = (table.column(c).to_numpy() for c in ("doc_id", "component", "own", "low"))
        found = np.array(across(*read(table.column("fingerprint").to_pylist()), component, (own != low).astype(np.int64), threshold), np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(doc_id[found[:, 0]]), "v": pa.array(doc_id[found[:, 1]])})

    return staged(met.groupBy("key", "low", "high").applyInArrow(compare, "u long, v long"), "block-links")


def links(own: DataFrame, threshold: float = 0.8, few: int = 24) -> DataFrame:
    """(u, v): pairs of the fingerprints of ``own`` (doc_id, fingerprint; a doc_id may have several) that share a key and whose
    likeness is at least ``threshold``: as many as join all documents that such pairs join. All pairs of a key of ``few``
    documents at most are verified; a larger key is a star around its least document, and if its documents stay apart, all of
    different components are compared."""
    bands = staged(_bands(own), "band-keys")
    rows, pairs = _groups(bands, few)
    good = _verified(pairs, own, threshold)
    large = rows.where(F.col("n") > few).select("key", "n", "doc_id")
    now = large.join(components(good).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    now = staged(now, "large-bands")
    apart = now.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("key")
    still = now.join(small(staged(apart, "apart-bands"), FEW), "key", "left_semi")
    if still.isEmpty():
        return good
    return good.unionByName(_in_blocks(still.join(own, "doc_id"), threshold))


def near(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id and near_id of each document that is near another: the least doc_id that links of ``threshold`` or more lead
    to. Equal fingerprints are linked, and one of them is looked up for all."""
    own = prints.where("doc_id IS NOT NULL").select("doc_id", "fingerprint")
    classes = staged(own.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fingerprint"), "print-classes")
    found = links(classes, threshold)
    copies = own.join(classes.withColumnRenamed("doc_id", "rep"), "fingerprint").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    return components(found.unionByName(copies)).select(F.col("node").alias("doc_id"), F.col("component").alias("near_id"))


def op6(spark, sf_dir: str) -> DataFrame:
    prints = staged(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "prints")
    return prints.join(near(prints), "doc_id", "left").select("*", F.coalesce("near_id", "doc_id").alias("near")).drop("near_id").withColumnRenamed("near", "near_id")
