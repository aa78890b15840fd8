"""Language-model scoring with causal self-attention over subword ids, in numpy.

Base. Words are counted over all training documents (a shuffle of word hashes
and counts). A document's tokens are looked up in two ways: words with at least
a threshold count, of which there are at most ``HOT`` whatever the corpus, are
broadcast; the others are joined by their hash, one row for each occurrence of a
word, where by that threshold no key is hot. Both are exact.

Model. Words (with a space before each) become ids of a public byte-level BPE,
and a document ends with an end id. One attention layer looks at the ids so far,
in overlapping windows of 32 ids, of which the last 16 are scored, so that every
id is scored once with 16 or more ids of context (as far as the document has
them). Masks keep later ids and padding out; windows are computed in batches.
The layer's output, the current id's embedding and products of both give the
probability of the next id in two steps, that of a cluster and that of a member
of it. The 1024 most frequent ids are members of their own, in 32 clusters by the
ids that stand beside them; the others share the members of two more clusters, by
whether they begin a word and by frequency, in the shares of their counts.

Training. All windows of all training documents (but those that tune the weight, see
below) are looked at, alike whatever the corpus: by a hash of text and place they are dealt to rounds, of which there are
``ROUNDS``, and to shards, one for every ``SHARD`` windows begun. In each round every
shard goes on from the common parameters by Adam over its windows of that round, in
batches of ``BATCH`` and ``MOST_PASSES`` times, on the executors, and the results are
averaged there. Counts of words and ids and the neighbours of ids cover all training
documents or windows.

A word's probability is the product of its ids', mixed, with one weight for all,
with the word's share of the corpus. The weight is tuned on training documents
that give no windows (one in ``TUNED``), each without its own counts. For hot
words the mixture is finished where the model is computed; for the others the
model's probability of each occurrence goes through the join of the base, after
which it is finished alike: scores don't depend on ``HOT``.
A score is the log10 probability of the text's words and end.

Defined results: a null text is empty and has the end token alone; null doc_ids
are hashed as the empty string; equal rows are scored alike; an empty table
gives no rows; without training documents counts are 0 and the model is that of
its initial parameters. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import tokens
from .shared import discard, pieces, released, staged, text_column
from .textscan import LOWER, U, mix, words

END_ID, VOCAB, END_HASH = 50256, 50257, -1
HOT = 200_000
SHARD, ROUNDS, MOST_PASSES, BATCH, TUNED, IDS_PER_BYTE = 1 << 20, 4, 1, 128, 32, 0.4
BLOCK, KEY, VALUE, EMBED, CROSS = 16, 12, 16, 24, 16
CLUSTERS, MEMBERS, BESIDE, SUM_BLOCKS = 32, 32, 128, 64
SINGLE = CLUSTERS * MEMBERS
_PIECE, _TOGETHER = 2 << 20, 64


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)).cast("int")


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in ascending order, a place of each, and each hash's place among them.

    Upper bits with the places below them are sorted as one number, which is much faster than sorting places by hash;
    should two hashes have the same upper bits, ``np.unique`` does it."""
    low = U(max(len(h) - 1, 1).bit_length())
    mixed = np.sort(h >> low << low | np.arange(len(h), dtype=U))
    order = (mixed & ((U(1) << low) - U(1))).astype(np.int64)
    ordered = h[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(h)]
    first = np.flatnonzero(fresh)
    distinct = ordered[first]
    if (distinct[1:] >> low == distinct[:-1] >> low).any():
        return np.unique(h, return_index=True, return_inverse=True)
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return distinct, order[first], back


def _unique_words(buf: np.ndarray, w):
    """Hashes of the distinct words, each word's place among them, and their ids' places in the encoder's pool."""
    distinct, first, back = _distinct(w.hash)
    enc = tokens.encoder()
    if not len(distinct):
        return distinct, back, enc, np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = w.end[first] - w.start[first]
    room = size + 1
    at = np.cumsum(room) - room
    spaced = np.full(int(room.sum()), 0x20, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    spaced[np.repeat(at, size) + 1 + within] = LOWER[buf[np.repeat(w.start[first], size) + within]]
    place, count = enc.parts(spaced, at, at + room)
    return distinct, back, enc, place, count


def _gather(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    return pool[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


@dataclass
class Draw:
    """Which windows training looks at: at what rate (``plan`` takes all), and to how many shards and rounds they are dealt."""

    rate: float
    shards: int
    rounds: int


def plan(training: DataFrame) -> Draw:
    size = training.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return Draw(1.0, max(1, int(np.ceil(size * IDS_PER_BYTE / BLOCK / SHARD))), ROUNDS)


def gathered(docs: DataFrame, draw: Draw) -> DataFrame:
    """(kind, key, n, data) over the training documents: kind 0 are words by hash, kind 1 subword ids, with counts n that
    aren't summed yet; kind 2 are n windows (``_TOGETHER`` at most), of 33 ids each, with the number of their shard and round. ``docs`` has text, text_hash, tuned."""

    def run(batches):
        held, ids, n_docs = [], np.zeros(VOCAB, np.int64), 0
        names = ["kind", "key", "n", "data"]

        def merged():
            h = np.concatenate([x for x, _ in held])
            c = np.concatenate([x for _, x in held])
            distinct, back = np.unique(h, return_inverse=True)
            return distinct, np.bincount(back, weights=c, minlength=len(distinct)).astype(np.int64)

        def rows(kind, key, n, data=None):
            for lo in range(0, len(key), 200_000):
                k = key[lo : lo + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[lo : lo + 200_000]), pa.array([None] * len(k) if data is None else data, pa.binary())], names=names)

        for b in batches:
            buf, off = text_column(b.column(0))
            text_hash = b.column(1).to_numpy(zero_copy_only=False).view(U)
            tuned = b.column(2).to_numpy(zero_copy_only=False)
            n_docs += b.num_rows
            for lo, hi in pieces(off, _PIECE):
                part = buf[off[lo] : off[hi]]
                _, distinct, back, flat, sizes, _, _ = _sequence(part, off[lo : hi + 1] - off[lo])
                held.append((distinct, np.bincount(back, minlength=len(distinct))))
                ids += np.bincount(flat, minlength=VOCAB)
                w, where = _drawn(flat, sizes, text_hash[lo:hi], ~tuned[lo:hi], draw)
                order = np.argsort(where, kind="stable")
                key, at, n = np.unique(where[order], return_index=True, return_counts=True)
                w = w[order]
                cuts = -(-n // _TOGETHER)  # rows stay small, as tasks hold many of them
                begin = np.repeat(at, cuts) + _TOGETHER * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
                n = np.minimum(np.repeat(at + n, cuts) - begin, _TOGETHER)
                yield from rows(2, np.repeat(key, cuts), n.astype(np.int64), [w[i : i + k].tobytes() for i, k in zip(begin.tolist(), n.tolist())])
                if sum(len(x) for x, _ in held) > 3_000_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1_500_000:
                        yield from rows(0, held[0][0].view(np.int64), held[0][1])
                        held.clear()
        if held:
            h, n = merged()
            yield from rows(0, h.view(np.int64), n)
        if n_docs:
            yield from rows(0, np.array([END_HASH]), np.array([n_docs]))
            seen = np.flatnonzero(ids)
            yield from rows(1, seen, ids[seen])

    return docs.select("text", "text_hash", "tuned").mapInArrow(released(run), "kind int, key long, n long, data binary")


PAD_ID, START_ID = 65535, 65534  # what isn't an id of the vocabulary


def _blocks(ids: np.ndarray, sizes: np.ndarray):
    """Documents' ids as blocks of 16: what is scored from, what is scored, and where each id stands.

    A document of n ids (its end id included) is a padding block, then the start mark
    and its first n - 1 ids, filled up; ids[i] is predicted at place at[i]."""
    rows = -(-sizes // BLOCK) + 1
    base = (np.cumsum(rows) - rows) * BLOCK
    total = int(rows.sum()) * BLOCK
    given, target = np.full(total, PAD_ID, np.uint16), np.full(total, PAD_ID, np.uint16)
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(base + BLOCK - begin, sizes) + np.arange(len(ids))
    target[at] = ids
    given[at[1:]] = ids[:-1]
    given[base + BLOCK] = START_ID
    return given.reshape(-1, BLOCK), target.reshape(-1, BLOCK), at


def _drawn(ids: np.ndarray, sizes: np.ndarray, text_hash: np.ndarray, wanted: np.ndarray, draw: Draw):
    """(windows of 33 ids: 16 before, the one before the scored ones, and the 16 scored; shard * 4 + round of each)."""
    given, target, _ = _blocks(ids, sizes)
    rows = -(-sizes // BLOCK) + 1
    doc = np.repeat(np.arange(len(sizes)), rows)
    number = np.arange(len(given)) - np.repeat(np.cumsum(rows) - rows, rows)
    with np.errstate(over="ignore"):
        h = mix(text_hash[doc] + mix(number.astype(U) + U(1)))
    at = np.flatnonzero((number > 0) & wanted[doc] & ((h >> U(11)).astype(np.float64) < draw.rate * 2.0**53))
    deal = mix(h[at] ^ U(0xD6E8FEB86659FD93))
    where = (deal % U(draw.shards)).astype(np.int64) * ROUNDS + ((deal >> U(40)) % U(draw.rounds)).astype(np.int64)
    return np.concatenate((given[at - 1], given[at][:, :1], target[at]), 1), where


def _added(vectors: DataFrame, size: int) -> np.ndarray:
    """The sum of the vectors (float64, as bytes, in the column ``data``): within tasks, then over tasks by blocks of places."""
    edges = np.linspace(0, size, SUM_BLOCKS + 1).astype(np.int64)

    def within(batches):
        total = np.zeros(size)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SUM_BLOCKS)), pa.array([total[s:e].tobytes() for s, e in zip(edges, edges[1:])], pa.binary())], names=["block", "data"])

    def over(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("data"))
        return pa.table({"block": table.column("block")[:1].cast(pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    got = vectors.select("data").mapInArrow(within, "block long, data binary").groupBy("block").applyInArrow(over, "block long, data binary").toArrow().sort_by("block")
    return np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in got.column("data")]) if got.num_rows else np.zeros(size)


@dataclass
class Attention:
    """The maps from ids to context rows and to members of clusters, and the parameters as one vector."""

    context: np.ndarray  # id (or PAD_ID, START_ID) -> row of the tables
    cluster: np.ndarray  # id -> cluster
    member: np.ndarray  # id -> place in the cluster
    inside: np.ndarray  # id -> log probability among the ids of its place
    flat: np.ndarray
    mix: float = 0.0  # weight of the word's share of the corpus

    @property
    def p(self) -> dict[str, np.ndarray]:
        return views(self.flat)


PAD, START = SINGLE + 2, SINGLE + 3
ALL = CLUSTERS + 2
WIDE = VALUE + EMBED + CROSS
SHAPES = {  # query and embedding of the current id; key and value of each id; bias by distance; cluster; member
    "qe": (SINGLE + 4, KEY + EMBED), "kv": (SINGLE + 4, KEY + VALUE), "r": (2 * BLOCK,), "w1": (WIDE + 1, ALL), "w2": (ALL, WIDE + 1, MEMBERS),
}
PARAMETERS = sum(int(np.prod(x)) for x in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def _spaced() -> np.ndarray:
    """Ids that begin a word."""
    bpe = tokens.encoder().bpe
    return np.array([i != END_ID and bpe.decode_single_token_bytes(i)[:1] == b" " for i in range(VOCAB)])


def _top(n: np.ndarray) -> np.ndarray:
    """The most frequent ids, in this order."""
    return np.argsort(-n, kind="stable")[:SINGLE]


def neighbours(windows: DataFrame, n: np.ndarray) -> np.ndarray:
    """How often each of the most frequent ids stands after, and before, each of the ``BESIDE`` most frequent."""
    row = np.full(65536, SINGLE, np.int64)
    row[_top(n)] = np.arange(SINGLE)

    def run(batches):
        total = np.zeros((SINGLE + 1) * 2 * BESIDE)
        for b in batches:
            buf, off = text_column(b.column(0))
            for lo, hi in pieces(off, _PIECE):
                w = row[buf[off[lo] : off[hi]].view(np.uint16).reshape(-1, 33)[:, 16:]]
                left, right = w[:, :-1].ravel(), w[:, 1:].ravel()
                for centre, other, side in ((right, left, 0), (left, right, BESIDE)):
                    at = other < BESIDE
                    total += np.bincount(centre[at] * (2 * BESIDE) + other[at] + side, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    return _added(windows.select("data").mapInArrow(released(run), "data binary"), (SINGLE + 1) * 2 * BESIDE).reshape(SINGLE + 1, -1)[:SINGLE]


def clusters(beside: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(CLUSTERS, MEMBERS): the places of ids, halved again and again along the main direction of what stands beside them."""
    parts = [np.arange(SINGLE)]
    x = np.sqrt(beside)
    x /= np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)
    weight = np.sqrt(n + 1.0)[:, None]
    while len(parts) < CLUSTERS:
        halves = []
        for part in parts:
            y = x[part] - (x[part] * weight[part]).sum(0) / weight[part].sum()
            _, _, axis = np.linalg.svd(y * weight[part], full_matrices=False)
            order = np.argsort(y @ (axis[0] * np.sign(axis[0][np.argmax(np.abs(axis[0]))])), kind="stable")
            halves += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        parts = halves
    return np.stack(parts)


def untrained(n: np.ndarray, beside: np.ndarray, seed: int = 7) -> Attention:
    """The maps, and parameters that give every id about its share of the counts ``n``."""
    rng = np.random.default_rng(seed)
    top, spaced = _top(n), _spaced()
    smooth = n + 1.0
    cluster, member = np.zeros(VOCAB, np.int64), np.zeros(VOCAB, np.int64)
    for c, places in enumerate(clusters(beside, n[top])):
        cluster[top[places]], member[top[places]] = c, np.arange(MEMBERS)
    rest = np.argsort(-n, kind="stable")[SINGLE:]
    for c, ids in ((CLUSTERS, rest[spaced[rest]]), (CLUSTERS + 1, rest[~spaced[rest]])):
        cluster[ids], member[ids] = c, np.minimum(np.log2(np.arange(len(ids)) / 8 + 1) * 3, MEMBERS - 1).astype(np.int64)
    place = cluster * MEMBERS + member
    total = np.bincount(place, weights=smooth, minlength=ALL * MEMBERS)
    context = np.full(65536, PAD, np.int64)
    context[:VOCAB] = np.where(spaced, SINGLE, SINGLE + 1)
    context[top] = np.arange(SINGLE)
    context[START_ID] = START
    flat = np.zeros(PARAMETERS, np.float32)
    p = views(flat)
    for name, scale in (("qe", 0.1), ("kv", 0.1), ("w1", 0.1), ("w2", 0.1)):
        p[name][:] = rng.standard_normal(p[name].shape) * scale
    share = total.reshape(ALL, MEMBERS)
    p["w1"][-1] = np.log(share.sum(1) / share.sum())
    p["w2"][:, -1] = np.log(np.maximum(share, 1e-30) / share.sum(1, keepdims=True))
    p["w2"][:, :-1] *= share[:, None] > 0  # places without ids stay without probability
    p["w2"][:, -1][share == 0] = -100.0
    return Attention(context, cluster, member, np.log(smooth / total[place]), flat)


_GAP = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]  # how far each key is before each query
_LATER = np.where(_GAP < 0, -1e9, 0).astype(np.float32)
_BACK, _BEFORE = np.maximum(_GAP, 0), _GAP >= 0


def _inputs(p: dict[str, np.ndarray], both: np.ndarray):
    """both: (windows, 32) context rows, of which the last 16 are scored from. The inputs of the two steps, and what the gradients need."""
    qe, kv = np.take(p["qe"], both[:, BLOCK:], axis=0), np.take(p["kv"], both, axis=0)
    q, e, k, v = qe[..., :KEY], qe[..., KEY:], kv[..., :KEY], kv[..., KEY:]
    score = q @ k.transpose(0, 2, 1)
    score += p["r"][_BACK] + _LATER
    padded = both == PAD
    rows = np.flatnonzero(padded.any(1))  # few windows: the first and the last of a document
    score[rows] += np.where(padded[rows], np.float32(-1e9), np.float32(0))[:, None, :]
    np.minimum(score, 30, out=score)
    np.exp(score, out=score)
    total = score @ np.ones(2 * BLOCK, score.dtype)
    total += np.float32(1e-9)
    score *= np.reciprocal(total, out=total)[..., None]
    x = np.empty((*qe.shape[:2], WIDE + 1), qe.dtype)
    a = score @ v
    x[..., :VALUE], x[..., VALUE : VALUE + EMBED], x[..., -1] = a, e, 1
    np.multiply(a[..., :CROSS], e[..., :CROSS], out=x[..., VALUE + EMBED : -1])
    return x, (q, k, v, score, a, e)


def _softmax(logits: np.ndarray, at: np.ndarray, n: int) -> float:
    """The sum of -log softmax at one place of each row; the rows become its gradient over ``n``. Logits are cut at 85, within a float's range."""
    own = np.arange(len(at)) * logits.shape[1] + at
    flat = logits.reshape(-1)
    picked = np.take(flat, own)
    np.clip(logits, -85, 85, out=logits)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    loss = (np.log(total) - picked).sum()
    total *= n
    logits *= np.reciprocal(total, out=total)[:, None]
    flat[own] -= 1 / n
    return loss


def _steps(p: dict[str, np.ndarray], both: np.ndarray, cluster: np.ndarray, member: np.ndarray, live: np.ndarray, g: dict[str, np.ndarray]) -> float:
    """Mean loss over the live places; the gradients of all parameters are written to ``g``."""
    every, (q, k, v, att, a, e) = _inputs(p, both)
    at = np.flatnonzero(live)
    c = np.take(cluster, at)
    order = np.argsort(c.astype(np.uint8), kind="stable")  # few bits sort faster
    at, c = at[order], c[order]
    x, m = np.take(every.reshape(-1, WIDE + 1), at, axis=0), np.take(member, at)
    n = max(len(at), 1)
    d2, dx = np.empty((len(at), MEMBERS), x.dtype), np.empty_like(x)
    edges = np.searchsorted(c, np.arange(ALL + 1)).tolist()
    spans = [(j, lo, hi) for j, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
    for j, lo, hi in spans:
        np.dot(x[lo:hi], p["w2"][j], out=d2[lo:hi])
    loss = _softmax(d2, m, n)  # of all clusters at once
    g["w2"][:] = 0
    for j, lo, hi in spans:
        np.dot(x[lo:hi].T, d2[lo:hi], out=g["w2"][j])
        np.dot(d2[lo:hi], p["w2"][j].T, out=dx[lo:hi])
    d1 = x @ p["w1"]
    loss += _softmax(d1, c, n)
    np.dot(x.T, d1, out=g["w1"])
    dx += d1 @ p["w1"].T
    d = every  # its rows are in x
    d.reshape(-1, WIDE + 1)[at] = dx
    if len(at) < live.size:
        d[~live] = 0
    cross, da = d[..., VALUE + EMBED : -1].copy(), d[..., :VALUE].copy()
    dqe, dkv = np.empty((*live.shape, KEY + EMBED), x.dtype), np.empty((*both.shape, KEY + VALUE), x.dtype)
    dqe[..., KEY:] = d[..., VALUE : VALUE + EMBED]
    dqe[..., KEY : KEY + CROSS] += cross * a[..., :CROSS]
    da[..., :CROSS] += np.multiply(cross, e[..., :CROSS], out=cross)
    ds = da @ v.transpose(0, 2, 1)
    ds -= ((da * a) @ np.ones(VALUE, x.dtype))[..., None]  # da.a: the sum of the weights times their gradients
    ds *= att
    np.matmul(att.transpose(0, 2, 1), da, out=dkv[..., KEY:])
    np.matmul(ds, k, out=dqe[..., :KEY])
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :KEY])

    pairs = np.result_type(x.dtype, np.complex64)

    def spread(name, rows, value):
        rows = rows.astype(np.uint16).ravel()
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        g[name][:] = 0
        value = np.take(value.reshape(len(rows), -1), order, axis=0)
        g[name][rows[first]] = np.add.reduceat(value.view(pairs), first).view(value.dtype)  # columns are added two at a time

    spread("qe", both[:, BLOCK:], dqe)
    spread("kv", both, dkv)
    by_gap = np.ones(len(ds), ds.dtype) @ ds.reshape(len(ds), -1)
    g["r"][:] = np.bincount(_BACK.ravel(), weights=by_gap * _BEFORE.ravel(), minlength=2 * BLOCK)
    return loss / n


def descend(model: Attention, windows: np.ndarray, passes: int, span: tuple[float, float], seed: int, batch: int = BATCH, rate: float = 0.02) -> np.ndarray:
    """The parameters after ``passes`` passes of Adam over the windows (of 33 ids). ``span`` is what part of the whole training
    this is: the step falls from its beginning to its end."""
    rng = np.random.default_rng(seed)
    flat = model.flat.copy()
    gradient, m1, m2, spare = (np.zeros_like(flat) for _ in range(4))  # m1 and m2: sums of gradients, not yet divided by 10 and 100
    p, g = views(flat), views(gradient)
    context, cluster, member = model.context.astype(np.uint16), model.cluster.astype(np.uint8), model.member.astype(np.uint8)
    steps = max(1, -(-len(windows) // batch)) * passes
    t = 0
    for _ in range(passes):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            w = np.take(windows, order[lo : lo + batch], axis=0)
            both, target = np.take(context, w[:, :-1]), w[:, BLOCK + 1 :]
            live = target != PAD_ID
            known = target * live
            _steps(p, both, np.take(cluster, known), np.take(member, known), live, g)
            t += 1
            done = span[0] + (span[1] - span[0]) * t / steps
            step = rate * min(1, t / 50) * (1 - 0.95 * done)
            size = np.sqrt(0.01 / (1 - 0.99**t))
            m1 *= 0.9
            m1 += gradient
            m2 *= 0.99
            m2 += np.multiply(gradient, gradient, out=gradient)
            np.sqrt(m2, out=spare)
            spare += 1e-8 / size
            np.divide(m1, spare, out=spare)
            spare *= 0.1 * step / (1 - 0.9**t) / size
            flat -= spare
    return flat


def train(windows: DataFrame, n: np.ndarray, draw: Draw, passes: int | None = None) -> Attention:
    """``windows`` has key (shard * ROUNDS + round), n and data; ``n`` are the counts of ids."""
    total = windows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = untrained(n, neighbours(windows, n))
    if not total:
        return model
    passes = MOST_PASSES if passes is None else passes
    for r in range(draw.rounds):
        sent = windows.sparkSession.sparkContext.broadcast(model)
        span = (r / draw.rounds, (r + 1) / draw.rounds)

        def shard(table: pa.Table) -> pa.Table:
            key = table.column("key")[0].as_py()
            w = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, 33) for x in table.column("data")])
            flat = descend(sent.value, w, passes, span, key)
            return pa.table({"data": pa.array([np.append(flat.astype(np.float64), 1.0).tobytes()], pa.binary())})

        own = windows.where(F.pmod("key", F.lit(ROUNDS)) == r).select("key", "data")
        sums = _added(own.groupBy("key").applyInArrow(shard, "data binary"), PARAMETERS + 1)
        if sums[-1]:
            model.flat = (sums[:-1] / sums[-1]).astype(np.float32)
        sent.unpersist()
    return model


class _Tables:
    """What scoring needs of the parameters. Values have a last column of ones, which sums the weights; padding has neither value nor weight."""

    def __init__(self, model: Attention):
        p = model.p
        self.q, self.e = np.ascontiguousarray(p["qe"][:, :KEY]), np.ascontiguousarray(p["qe"][:, KEY:])
        self.k, self.v = np.ascontiguousarray(p["kv"][:, :KEY]), np.column_stack((p["kv"][:, KEY:], np.ones(SINGLE + 4, np.float32)))
        self.v[PAD] = 0
        self.bias = (p["r"][_BACK] + _LATER).astype(np.float32)
        self.calm = np.sqrt((self.q**2).sum(1).max() * (self.k**2).sum(1).max()) + p["r"].max() < 30  # else scores are cut at 30, as in training
        self.w1, self.w2 = p["w1"], p["w2"]
        most = np.abs(p["kv"][:, KEY:]).max(0), np.abs(self.e).max(0)
        most = np.concatenate((*most, most[0][:CROSS] * most[1][:CROSS], [1]))
        self.small = max((most @ np.abs(self.w1)).max(), (most @ np.abs(self.w2)).max()) < 85  # else logits are cut at 85

    def inputs(self, both: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The inputs of the two steps at some of the scored places."""
        own = both[:, BLOCK:]
        score = np.take(self.q, own, axis=0) @ np.take(self.k, both, axis=0).transpose(0, 2, 1)
        score += self.bias
        if not self.calm:
            np.minimum(score, 30, out=score)
        np.exp(score, out=score)
        out = np.take((score @ np.take(self.v, both, axis=0)).reshape(-1, VALUE + 1), place, axis=0)
        x = np.empty((len(place), WIDE + 1), np.float32)
        a, e = x[:, :VALUE], x[:, VALUE : VALUE + EMBED]
        np.divide(out[:, :VALUE], out[:, VALUE:] + np.float32(1e-9), out=a)
        e[:] = np.take(self.e, np.take(own, place), axis=0)
        np.multiply(a[:, :CROSS], e[:, :CROSS], out=x[:, VALUE + EMBED : -1])
        x[:, -1] = 1
        return x

    def log_share(self, logits: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log of the softmax of the logits, at one place of each row."""
        if not self.small:
            np.clip(logits, -85, 85, out=logits)
        picked = np.take(logits.reshape(-1), np.arange(len(at)) * logits.shape[1] + at)
        np.exp(logits, out=logits)
        return picked - np.log(logits @ np.ones(logits.shape[1], np.float32))


def id_log_probabilities(model: Attention, ids: np.ndarray, sizes: np.ndarray, batch: int = 256) -> np.ndarray:
    """Natural logarithm of each id's probability, given the ids before it in its document."""
    tables = _Tables(model)
    given, target, at = _blocks(ids, sizes)
    live = target != PAD_ID
    rows = np.flatnonzero(live.any(1))
    context, cluster, member = model.context.astype(np.uint16), model.cluster.astype(np.uint8), model.member.astype(np.uint8)
    got = np.zeros(target.shape, np.float32)
    for lo in range(0, len(rows), batch):
        r = rows[lo : lo + batch]
        place = np.flatnonzero(live[r].ravel())
        known = target[r].ravel()[place]
        order = np.argsort(cluster[known], kind="stable")
        place, known = place[order], known[order]
        x = tables.inputs(np.take(context, np.concatenate((given[r - 1], given[r]), 1)), place)
        c, m = cluster[known], member[known]
        value = tables.log_share(x @ tables.w1, c)
        logits = np.empty((len(c), MEMBERS), np.float32)
        edges = np.searchsorted(c, np.arange(ALL + 1)).tolist()
        for j, (s, e) in enumerate(zip(edges, edges[1:])):
            if e > s:
                np.dot(x[s:e], tables.w2[j], out=logits[s:e])
        value += tables.log_share(logits, m)  # of all clusters at once
        out = np.zeros(len(r) * BLOCK, np.float32)
        out[place] = value
        got[r] = out.reshape(-1, BLOCK)
    return got.ravel()[at].astype(np.float64) + np.take(model.inside, ids)


def part_log_probabilities(model: Attention, ids: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The model's log probability of each part (a word's ids, or an end id; ``parts`` has their numbers of ids)."""
    return np.add.reduceat(id_log_probabilities(model, ids, sizes), np.cumsum(parts) - parts)


def mixed(model: Attention, own: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log10 probability of each part: the model's (``own``, natural), mixed with the part's ``share`` of the corpus."""
    keep = model.mix * share
    return np.logaddexp(np.log1p(-model.mix) + own, np.log(keep, out=np.full(len(keep), -np.inf), where=keep > 0)) / np.log(10)


def _sequence(buf: np.ndarray, off: np.ndarray):
    """Words, their distinct hashes and places; the rows' ids with an end id each, and how many each row has;
    how many ids each word or end has, and which of these are ends."""
    w = words(buf, off)
    distinct, back, enc, at, size = _unique_words(buf, w)
    n = len(off) - 1
    own = np.bincount(w.row, weights=size[back], minlength=n).astype(np.int64) if len(back) else np.zeros(n, np.int64)
    ids = np.full(int(own.sum()) + n, END_ID, np.int64)
    body = np.ones(len(ids), bool)
    body[np.cumsum(own + 1) - 1] = False
    if len(back):
        ids[body] = _gather(enc.pool, at[back], size[back])
    parts = np.ones(len(back) + n, np.int64)
    last = np.zeros(len(parts), bool)
    last[np.cumsum(w.count + 1) - 1] = True
    if len(back):
        parts[~last] = size[back]
    return w, distinct, back, ids, own + 1, parts, last


@dataclass
class Scorer:
    hot: np.ndarray  # hashes, sorted
    hot_count: np.ndarray
    end_count: int
    tokens: int
    kinds: int
    model: Attention | None

    def find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are hot, and their counts (0 for others)."""
        if not len(self.hot):
            return np.zeros(len(distinct), bool), np.zeros(len(distinct))
        at = np.minimum(np.searchsorted(self.hot, distinct), len(self.hot) - 1)
        found = self.hot[at] == distinct
        return found, np.where(found, self.hot_count[at], 0).astype(np.float64)

    def shares(self, distinct: np.ndarray, back: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Each word's or end's share of the corpus, 0 for words that aren't hot."""
        out = np.full(len(last), self.end_count, np.float64)
        out[~last] = self.find(distinct)[1][back]
        return out / max(self.tokens, 1)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


def fit(docs: DataFrame, held_out: int = 1) -> tuple[Scorer, DataFrame]:
    """The scorer, and the table of all word counts (key, n). ``docs`` has fold, text and text_hash."""
    training = docs.where(F.col("fold") != held_out).withColumn("tuned", F.pmod(F.xxhash64(F.lit("tuned"), "text_hash"), F.lit(TUNED)) == 0)
    draw = plan(training)
    found = staged(gathered(training, draw), "lm-gathered")
    table = staged(found.where("kind < 2").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    by_size = {r["p"]: (r["k"], r["n"]) for r in table.where("kind = 0").groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()}  # <= 63 rows
    kinds, total = (sum(x[i] for x in by_size.values()) for i in (0, 1))
    power, held = max(by_size, default=0) + 1, 0
    while power > 0 and held + by_size.get(power - 1, (0, 0))[0] <= HOT:
        power -= 1
        held += by_size.get(power, (0, 0))[0]
    hot = table.where((F.col("kind") == 0) & (F.col("n") >= F.lit(1 << power))).select("key", "n").toArrow()  # <= HOT rows
    key, n = hot.column("key").to_numpy().view(U), hot.column("n").to_numpy()
    order = np.argsort(key)
    ids = table.where("kind = 1").select("key", "n").toArrow()  # <= VOCAB rows
    id_counts = np.zeros(VOCAB)
    id_counts[ids.column("key").to_numpy()] = ids.column("n").to_numpy()
    end = int(id_counts[END_ID])
    model = train(found.where("kind = 2").select("key", "n", "data"), id_counts, draw)
    discard(found)
    scorer = Scorer(key[order], n[order], end, int(total), int(kinds), model)
    counted = table.where("kind = 0").select("key", "n")
    model.mix = best_mix(training.where("tuned"), scorer, counted)
    return scorer, counted


GRID = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


def best_mix(docs: DataFrame, scorer: Scorer, table: DataFrame) -> float:
    """The weight of GRID under which the words of ``docs``, each document without its own counts, are likeliest."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    grid = np.array(GRID)

    def run(batches):
        s: Scorer = sent.value
        total = np.zeros(len(GRID))
        for b in batches:
            buf, off = text_column(b.column(0))
            for lo, hi in pieces(off, _PIECE):
                w, distinct, back, ids, sizes, parts, last = _sequence(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                own = part_log_probabilities(s.model, ids, sizes, parts)
                is_hot, count = s.find(distinct)
                pair = w.row * np.int64(max(len(distinct), 1)) + back
                _, at, times = np.unique(pair, return_inverse=True, return_counts=True)
                rest = np.maximum(s.tokens - (w.count + 1), 1)  # the corpus without this document
                hot = is_hot[back]
                share = np.concatenate((np.maximum(count[back] - times[at], 0)[hot] / rest[w.row][hot], (s.end_count - 1) / rest))
                value = np.concatenate((own[~last][hot], own[last]))
                total += np.logaddexp(np.log1p(-grid)[:, None] + value, np.log(grid[:, None] * share + 1e-300)).sum(1)
                others = np.flatnonzero(~hot)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct[back[others]].view(np.int64)), pa.array(own[~last][others]), pa.array(times[at[others]]), pa.array(rest[w.row[others]]), pa.array([None] * len(others), pa.list_(pa.float64()))],
                    names=["key", "own", "times", "rest", "sums"],
                )
        yield pa.RecordBatch.from_arrays([*(pa.array([None], k) for k in (pa.int64(), pa.float64(), pa.int64(), pa.int64())), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["key", "own", "times", "rest", "sums"])

    found = staged(docs.select("text").mapInArrow(released(run), "key long, own double, times long, rest long, sums array<double>"), "lm-tuning")
    hot = found.where("sums IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)).alias(f"g{i}") for i in range(len(GRID))]).first()
    share = F.greatest(F.coalesce("n", F.lit(0)) - F.col("times"), F.lit(0)) / F.col("rest")
    rare = found.where("sums IS NULL").join(table, "key", "left").agg(
        *[F.coalesce(F.sum(F.when(share > 0, F.log(F.exp("own") * (1 - x) + share * x)).otherwise(F.col("own") + float(np.log1p(-x)))), F.lit(0.0)).alias(f"g{i}") for i, x in enumerate(GRID)]
    ).first()
    total = [a + b for a, b in zip(hot, rare)]
    return GRID[int(np.argmax(total))] if any(total) else 0.0


_ROWS = "doc long, text_hash long, fold int, doc_id long, n_tokens long, hot_known long, hot_base double, hot_score double, rare array<struct<key:long,own:double>>"


def _scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    rare_kind = pa.struct([("key", pa.int64()), ("own", pa.float64())])

    def run(batches):
        s: Scorer = sent.value
        for b in batches:
            buf, off = text_column(b.column(4))
            for lo, hi in pieces(off, _PIECE):
                m = hi - lo
                w, distinct, back, ids, sizes, parts, last = _sequence(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                is_hot, count = s.find(distinct)
                value = np.where(is_hot, s.base(count), 0)
                own = part_log_probabilities(s.model, ids, sizes, parts)
                each = mixed(s.model, own, s.shares(distinct, back, last))
                each[~last] = np.where(is_hot[back], each[~last], 0)  # the others are mixed after the join
                score = np.add.reduceat(each, np.cumsum(w.count + 1) - w.count - 1)
                base = np.bincount(w.row, weights=value[back], minlength=m) + s.base(s.end_count)
                known = np.bincount(w.row, weights=is_hot[back], minlength=m).astype(np.int64) + (s.end_count > 0)
                pick = np.flatnonzero(~is_hot[back])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(w.row[pick], np.arange(m + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(distinct[back[pick]].view(np.int64)), pa.array(own[~last][pick])], fields=list(rare_kind)),
                )
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(lo, m) for k in range(4)), pa.array(w.count + 1), pa.array(known), pa.array(base), pa.array(score), lists],
                    names=[x.split()[0] for x in _ROWS.split(", ")],
                )

    return docs.select("doc", "text_hash", "fold", "doc_id", "text").mapInArrow(released(run), _ROWS)


def scores(docs: DataFrame, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), text.alias("text"), fold(F.col("doc_id")).alias("fold"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("text_hash"))
    scorer, table = fit(docs, held_out)
    found = staged(_scored(docs, scorer), "lm-scores")
    # one row for each occurrence of a word that isn't hot
    rare = found.select("doc", "text_hash", F.inline("rare")).join(table, "key", "left")
    count = F.coalesce("n", F.lit(0))
    lift = F.log10((count + 0.5) / F.lit(scorer.tokens + 0.5 * (scorer.kinds + 1)))
    mix = scorer.model.mix
    keep = count * F.lit(mix / max(scorer.tokens, 1))
    score = F.when(keep > 0, F.log10(F.exp("own") * (1 - mix) + keep)).otherwise((F.col("own") + float(np.log1p(-mix))) / float(np.log(10)))
    sums = rare.groupBy("doc", "text_hash").agg(F.sum(score).alias("rare_score"), F.sum(lift).alias("rare_base"), F.count("n").alias("rare_known"))
    copies = found.groupBy("doc", "text_hash").agg(F.count(F.lit(1)).alias("copies"))  # equal rows have equal sums
    sums = sums.join(copies, ["doc", "text_hash"]).select("doc", "text_hash", (F.col("rare_score") / F.col("copies")).alias("rare_score"), (F.col("rare_base") / F.col("copies")).alias("rare_base"), (F.col("rare_known") / F.col("copies")).cast("long").alias("rare_known"))
    return found.drop("rare").join(sums, ["doc", "text_hash"], "left").select(
        "doc_id", (F.col("fold") == held_out).alias("held_out"), "n_tokens", (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(scorer.tokens).cast("long").alias("train_tokens"), (F.col("hot_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
