"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Sets are put in bands by size. For a band whose sets have at most M shingles,
two linked sets x <= y (x in the band, so y <= 1.25 x) differ in at most
D = floor((x + y) / 9) shingles. The universe of shingles is hashed into n > D
segments, each set falls into n subsets, and the subsets of the band's sets are
indexed, for a few segments with the one-deletion neighbourhoods as well. The
larger set of a pair spends D + 1 points: one point on a segment finds sets
that agree there, two points (through deletions) those that differ in at most
one shingle. Two sets that differ in D shingles can't escape all of them.
Points go where they cost least: a subset of few shingles, most of all an empty
one, is shared by chance and gets none as long as others are left.

Signatures are packed into blobs by hash bucket, so that a signature is 17 bytes
in a shuffle, and runs of equal signatures become stars: (signature, least
document, other document). A task that holds a signature many times sends one
of its documents on and the others as star edges, so no group is ever gathered
or expanded to all pairs. Star edges are verified exactly on the documents'
shingle sets. Where an edge of a signature fails and its ends stay in different
components, the signature is open: more stars around other documents are
verified, and then, if few of its documents probe, those with all others across
components. The documents of larger open signatures (sets that share a subset by
chance, or a passage) are told apart by their rarest shingles, counted over these
documents: two linked sets share one of the rarest fifth. Groups of such a
shingle are followed in the same way; what is large and apart even then is
compared block by block. So no link between different texts is lost. Equal
sets are classes: one document of each stands for all. Before sets are compared,
sizes and parity sketches (which differ in no more bits than the sets do in
shingles) rule out pairs that can't be linked; they never rule out a link.

Defined results: null and empty texts, and texts without words, have no
shingles and are linked with nothing; fewer than five words are one shingle;
rows that share a doc_id are one document, linked if any of its texts is; rows
with a null doc_id get their count and a null component; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .components import components
from .shared import pieces, released, small, staged, text_column
from .textscan import U, mix, stream, words

NGRAM = 5
_WEIGHT = stream(16, 21)
_SEGMENT, _TOKEN = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
INDEX, PROBE = 1, 2
SHARED = 0.1  # how likely a shingle is to be shared by chance, for the costs
PER_BUCKET = 400_000
SKETCH = 16
STARS, PER_SALT, OFTEN = 3, 500, 50_000
FEW = 1_000_000


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and how many each has."""
    w = words(buf, offsets)
    rows = len(offsets) - 1
    with np.errstate(over="ignore"):
        if len(w.hash) >= n:
            s = sum(w.hash[k : len(w.hash) - n + 1 + k] * _WEIGHT[k] for k in range(n))
            same = w.row[: len(s)] == w.row[n - 1 :]
            s, row = mix(s[same]), w.row[: len(s)][same]
        else:
            s, row = np.zeros(0, U), np.zeros(0, np.int64)
        count = np.maximum(w.count - n + 1, 0)
        few = np.flatnonzero((w.count > 0) & (w.count < n))
        begin = np.cumsum(w.count) - w.count
        short = np.zeros(len(few), U)
        for k in range(n - 1):
            has = w.count[few] > k
            short[has] += w.hash[begin[few[has]] + k] * _WEIGHT[k]
        short = mix(short + w.count[few].astype(U) * _WEIGHT[n])
    at = np.concatenate(([0], np.cumsum(count)))
    sets, sizes, short_at = [], np.zeros(rows, np.int64), dict(zip(few.tolist(), range(len(few))))
    for r in range(rows):
        if r in short_at:
            x = short[short_at[r] : short_at[r] + 1]
        else:
            x = np.sort(s[at[r] : at[r + 1]])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        sets.append(x)
        sizes[r] = len(x)
    return (np.concatenate(sets) if sets else s), sizes


def set_keys(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, as two signed longs."""
    out = np.zeros((2, len(sizes)), U)
    full = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[full]
    with np.errstate(over="ignore"):
        for k in range(2):
            if len(full):
                out[k, full] = np.add.reduceat(mix(flat * _WEIGHT[8 + k] + _WEIGHT[10 + k]), begin)
    return out[0].view(np.int64), out[1].view(np.int64)


def _bounds() -> np.ndarray:
    edges = [4]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 2, edges[-1] * 3 // 2))
    return np.array(edges, np.int64)


EDGES = _bounds()  # band b: sizes EDGES[b] up to EDGES[b + 1] - 1
_MOST = EDGES[1:] - 1
_DIFFER = (_MOST + _MOST * 5 // 4) // 9  # D, at most
# segments and how many of them are deletable: one point more than D + 1. Small sets get fewer and larger segments,
# as a subset of no or one shingle is shared by chance; large ones enough second points to leave such subsets out.
SEGMENTS = np.where(_DIFFER < 10, (2 * _DIFFER + 5) // 3, _DIFFER + 2)
DELETABLE = np.where(_DIFFER < 10, _DIFFER + 2 - SEGMENTS, SEGMENTS // 8)


def signatures(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, role) of all subsets that are indexed or probed."""
    rows = np.flatnonzero(sizes >= EDGES[0])
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.uint8)
    m = sizes[rows]
    high = np.searchsorted(EDGES, m, "right") - 1
    low = np.maximum(np.searchsorted(EDGES, -(-4 * m // 5), "right") - 1, 0)
    each = high - low + 1
    row = np.repeat(rows, each)  # an entry for each band that a set is looked up in
    band = np.repeat(high, each) - (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each))
    own = band == np.repeat(high, each)
    begin = np.cumsum(sizes) - sizes
    size = sizes[row]
    entry = np.repeat(np.arange(len(row)), size)
    token = flat[np.repeat(begin[row] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    n = SEGMENTS[band]
    base = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        seg = (mix(token * _SEGMENT + band[entry].astype(U)) % n[entry].astype(U)).astype(np.int64)
        code = mix(token ^ _TOKEN)
    slot = base[entry] + seg
    total = int(n.sum())
    filled = np.bincount(slot, minlength=total)
    part = np.bincount(slot, weights=(code & U(0xFFFFFFFF)).astype(float), minlength=total).astype(U)
    part += np.bincount(slot, weights=(code >> U(32)).astype(float), minlength=total).astype(U) << U(32)
    of = np.repeat(np.arange(len(row)), n)
    number = np.arange(total) - base[of]
    place = mix(band[of].astype(U) * U(1 << 40) + number.astype(U))
    deletable = number < DELETABLE[band[of]]
    # points: the D + 1 cheapest of all first points and, on deletable segments, second points
    need = (np.minimum(sizes[row], _MOST[band]) + sizes[row]) // 9 + 1
    second = np.flatnonzero(deletable)
    cost = np.concatenate((SHARED ** np.minimum(filled, 12.0), filled[second] * SHARED ** np.maximum(np.minimum(filled[second], 12.0) - 1, 0) + 0.01 * (filled[second] + 1)))
    cost[total:] = np.maximum(cost[total:], cost[second])  # a second point never comes before the first
    who = np.concatenate((of, of[second]))
    order = np.lexsort((cost, who))
    all_points = np.bincount(who, minlength=len(row))
    rank = np.empty(len(who), np.int64)
    rank[order] = np.arange(len(who)) - np.repeat(np.cumsum(all_points) - all_points, all_points)
    chosen = rank < need[who]
    points = chosen[:total].astype(np.int64)
    points[second] += chosen[total:] & chosen[second]
    lost = np.bincount(who[total:], weights=chosen[total:] & ~chosen[second], minlength=len(row))  # ties may rank a second point first
    for e in np.flatnonzero(lost):
        free = np.flatnonzero(points[base[e] : base[e] + n[e]] == 0)[: int(lost[e])]
        points[base[e] + free] = 1
    role = np.where(own[of], INDEX, 0) | np.where(points == 1, PROBE, 0)
    keep = role > 0
    with np.errstate(over="ignore"):
        exact = mix(part + place)
        out_row, out_sig, out_role = [row[of[keep]]], [exact[keep]], [role[keep].astype(np.uint8)]
        # one-deletion neighbourhoods: the subset, and the subset less each of its shingles
        near = deletable & (own[of] | (points == 2))
        near_role = (np.where(own[of], INDEX, 0) | np.where(points == 2, PROBE, 0)).astype(np.uint8)
        out_row.append(row[of[near]])
        out_sig.append(mix(exact[near] ^ _SEGMENT))
        out_role.append(near_role[near])
        t = np.flatnonzero(near[slot])
        out_row.append(row[entry[t]])
        out_sig.append(mix(mix(part[slot[t]] - code[t] + place[slot[t]]) ^ _SEGMENT))
        out_role.append(near_role[slot[t]])
    return np.concatenate(out_row), np.concatenate(out_sig), np.concatenate(out_role)


def _stars(sig: np.ndarray, node: np.ndarray, role: np.ndarray):
    """Runs of equal signatures: star edges (sig, least node, node, roles), and one row of each signature.

    A row's role byte has the document's own role and, two bits up, the joint role of all it stands for;
    an edge's has the node's role and, two bits up, that of the least node."""
    order = np.lexsort((node, sig))
    sig, node, role = sig[order], node[order], role[order]
    first = np.concatenate(([True], sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    joint = np.bitwise_or.reduceat(role >> 2, at) if len(at) else role
    run = np.cumsum(first) - 1
    edge = node != node[at][run]
    roles = (role & 3) | (role[at][run] & 3) << 2
    return (sig[edge], node[at][run][edge], node[edge], roles[edge]), (sig[at], node[at], (role[at] & 3) | joint << 2)


_BLOB = "bucket long, sig binary, node binary, role binary, lead binary"


def _emit(docs: DataFrame, buckets: int) -> DataFrame:
    """Signatures of all documents as blobs by bucket; copies within a task are already stars (``lead`` set)."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            sig, node, role = (np.concatenate(x) for x in zip(*held))
            (es, el, en, er), (sig, node, role) = _stars(sig, node, role | role << 2)
            out = []
            for s, a, r, l in ((sig, node, role, None), (es, en, er, el)):
                b = (s % U(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                b, s, a, r = b[order], s[order], a[order], r[order]
                l = l[order] if l is not None else None
                cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
                for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(b)]):
                    out.append((int(b[lo]), s[lo:hi].tobytes(), a[lo:hi].tobytes(), r[lo:hi].tobytes(), b"" if l is None else l[lo:hi].tobytes()))
            for lo in range(0, len(out), 64):
                part = out[lo : lo + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part], pa.int64()), *(pa.array([x[k] for x in part], pa.binary()) for k in range(1, 5))],
                    names=["bucket", "sig", "node", "role", "lead"],
                )

        for batch in batches:
            buf, off = text_column(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in pieces(off, 1 << 20):
                flat, sizes = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                row, sig, role = signatures(flat, sizes)
                held.append((sig, ids[lo + row], role))
                size += len(sig)
                if size > 750_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(released(run), _BLOB)


def _runs(blobs: DataFrame) -> DataFrame:
    """(sig, lead, node, roles) star edges of all signatures that meet an indexed and a probing document."""

    def run(table: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        rows, edges = [(none.astype(U), none, none.astype(np.uint8))], [(none.astype(U), none, none, none.astype(np.uint8))]
        for s, a, r, l in zip(*(table.column(c).to_pylist() for c in ("sig", "node", "role", "lead"))):
            s, a, r = np.frombuffer(s, U), np.frombuffer(a, np.int64), np.frombuffer(r, np.uint8)
            if l:
                edges.append((s, np.frombuffer(l, np.int64), a, r))
            else:
                rows.append((s, a, r))
        more, (s, _, role) = _stars(*(np.concatenate(x) for x in zip(*rows)))
        e = [np.concatenate(x) for x in zip(more, *edges)]
        if len(s):
            live = role >> 2 == INDEX | PROBE
            at = np.minimum(np.searchsorted(s, e[0]), len(s) - 1)
            e = [x[live[at]] for x in e]
        return pa.table({"sig": e[0].view(np.int64), "lead": e[1], "node": e[2], "roles": e[3].astype(np.int32)})

    return blobs.groupBy("bucket").applyInArrow(run, "sig long, lead long, node long, roles int")


def _sketches(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SKETCH words of 64 bits for each set: the parity of the shingles in each of 64 * SKETCH cells.
    Two sketches differ in no more bits than their sets in shingles, so they can rule a link out."""
    cells = 64 * SKETCH
    h = mix(flat ^ _TOKEN)
    cell = (h % U(cells)).astype(np.int64) + np.repeat(np.arange(len(sizes)), sizes) * cells
    odd = (np.bincount(cell, minlength=len(sizes) * cells) & 1).astype(np.uint8).reshape(len(sizes), cells)
    return np.packbits(odd, axis=1).view("<i8")


def _may_link(a: str, b: str, percent: int):
    """A column: sizes and sketches of the rows ``a`` and ``b`` leave a link possible. Exact; it never rules out a link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & (differ * 9 <= na + nb)


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of percent / 100 or more."""
    a = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b"))

    def run(batches):
        for batch in batches:
            keep = []
            cols = [text_column(batch.column(k)) for k in (2, 3)]
            both = cols[0][1] + cols[1][1]
            for lo, hi in pieces(both, 1 << 20):
                sets = []
                for buf, off in cols:
                    flat, sizes = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    sets.append(np.split(flat, np.cumsum(sizes)[:-1]))
                for r, (x, y) in enumerate(zip(*sets)):
                    least, most = sorted((len(x), len(y)))
                    if not least or 100 * least < percent * most:
                        continue
                    z = np.sort(np.concatenate((x, y)))
                    common = int((z[1:] == z[:-1]).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        keep.append(lo + r)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["u", "v"])

    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(released(run), "u long, v long")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """The pairs that are links, as a written table; None if there are no pairs."""
    pairs = staged(pairs, "pairs")
    n = pairs.count()
    if not n:
        return None
    needed = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    if n <= FEW:  # 16 bytes a pair; more than that are joined by a shuffle
        needed = F.broadcast(needed)
    texts = staged(docs.join(needed, "doc_id", "left_semi").distinct(), "candidates")
    return staged(_verify(pairs, texts, percent), "verified")


def _keyed(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            buf, off = text_column(batch.column(1))
            for lo, hi in pieces(off, 1 << 20):
                flat, sizes = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                h1, h2 = set_keys(flat, sizes)
                sketch = _sketches(flat, sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(h1), pa.array(h2), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH))],
                    names=["doc_id", "n_shingles", "h1", "h2", *(f"s{k}" for k in range(SKETCH))],
                )

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(released(run), "doc_id long, n_shingles long, h1 long, h2 long, " + ", ".join(f"s{k} long" for k in range(SKETCH)))


def _across(pairs: DataFrame, group: DataFrame, good: DataFrame, copies: DataFrame, docs: DataFrame, percent: int):
    """Components and links after the pairs are verified."""
    more = _verified(pairs, docs, percent)
    if more is None:
        return group, good
    good = good.unionByName(more)
    return staged(components(good.unionByName(copies)), "components"), good


_FIELDS = ["node", "role", "n", "component", *[f"s{k}" for k in range(SKETCH)]]


def _meet(x: str, y: str):
    """A column: one of the two roles is of an indexed document, and the other of a probing one."""
    return (F.col(x).bitwiseAND(INDEX) > 0) & (F.col(y).bitwiseAND(PROBE) > 0) | (F.col(x).bitwiseAND(PROBE) > 0) & (F.col(y).bitwiseAND(INDEX) > 0)


def _candidates(x: DataFrame, y: DataFrame, on: list[str], which, percent: int) -> DataFrame:
    """Distinct pairs (u, v) of the rows of x and y (aliased so) that agree on ``on``, are apart and may be links."""
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    return (
        x.join(y, same & which & (F.col("x.component") != F.col("y.component")) & _meet("x.role", "y.role") & _may_link("x", "y", percent))
        .select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()
    )


def _still_apart(ends: DataFrame, group: DataFrame) -> DataFrame:
    """The rows of ``ends`` with their components and their signature's number of rows, of signatures with two components or more."""
    now = ends.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    now = staged(now, "apart-ends")
    sizes = (
        now.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("role").bitwiseAND(PROBE) > 0).alias("probers"), F.min("component").alias("c0"), F.max("component").alias("c1"))
        .where("c0 <> c1 AND probers > 0").select("sig", "members", "probers")
    )
    return now.join(small(staged(sizes, "apart-sizes"), FEW), "sig")


def _settle(ends: DataFrame, group: DataFrame, good: DataFrame, copies: DataFrame, docs: DataFrame, percent: int, upto: int):
    """Follow open signatures: stars around documents that hashes pick, then the probing documents of signatures that have
    ``upto`` of these at most with all others. Returns components, links, and the rows of the larger signatures that are still apart (or None)."""
    now = _still_apart(ends, group)
    salts = F.ceil(F.col("members") / PER_SALT).cast("int")  # a signature's leads meet the others in so many groups
    leads = now.groupBy("sig").agg(*[F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), *_FIELDS)).alias(f"lead{k}") for k in range(STARS)], F.max(salts).alias("salts"))
    leads = leads.select("sig", "salts", F.inline(F.array(*[f"lead{k}" for k in range(STARS)]))).select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = now.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    stars = _candidates(leads.alias("x"), salted.alias("y"), ["sig", "salt"], F.col("x.node") != F.col("y.node"), percent)
    group, good = _across(stars, group, good, copies, docs, percent)
    now = staged(_still_apart(ends, group), "apart-ends")
    few = now.where(F.col("probers") <= upto)
    probing = few.where(F.col("role").bitwiseAND(PROBE) > 0)
    group, good = _across(_candidates(probing.alias("x"), few.alias("y"), ["sig"], F.col("x.node") != F.col("y.node"), percent), group, good, copies, docs, percent)
    large = now.where(F.col("probers") > upto).drop("component", "members", "probers")
    if large.isEmpty():
        return group, good, None
    return group, good, staged(_still_apart(large, group), "large")


def _often(counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(threshold, shingles in ascending order, counts) of the shingles with at least a threshold count, a power of two; at most ``OFTEN``."""
    by_power = {r["p"]: r["n"] for r in counts.groupBy(F.floor(F.log2("df")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # <= 63 rows
    power, held = max(by_power, default=0) + 1, 0
    while power > 1 and held + by_power.get(power - 1, 0) <= OFTEN:
        power -= 1
        held += by_power.get(power, 0)
    top = counts.where(F.col("df") >= F.lit(1 << power)).toArrow()  # <= OFTEN rows
    order = np.argsort(top.column("sig").to_numpy())
    return 1 << power, top.column("sig").to_numpy()[order], top.column("df").to_numpy()[order]


def _prefixes(large: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(sig, node, role) for the rarest shingles of the documents in ``large``: of n shingles all but the
    ceil(percent * n / 100) - 1 most frequent, counted over these documents. Two linked sets share one of them at least.

    The most frequent shingles are broadcast with their counts, so that what is joined with its count is rare."""
    nodes = staged(large.select(F.col("node").alias("doc_id")).distinct(), "large-nodes")
    texts = staged(docs.join(small(nodes, FEW), "doc_id", "left_semi").select("doc_id", "text", F.xxhash64("text").alias("h")).distinct(), "large-texts")

    def each(batches):
        for b in batches:
            buf, off = text_column(b.column(0))
            for lo, hi in pieces(off, 1 << 20):
                flat, _ = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for at in range(0, len(flat), 500_000):
                    yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + 500_000].view(np.int64))], names=["sig"])

    counts = staged(texts.select("text").mapInArrow(released(each), "sig long").groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "large-counts")
    least, often, how_often = _often(counts)
    sent = docs.sparkSession.sparkContext.broadcast((often, how_often))

    def ranked(batches):
        """Shingles that aren't often, with the number of those that are (``above``); and of these the ones within the prefix (``sure``)."""
        often, how_often = sent.value
        for b in batches:
            buf, off = text_column(b.column(1))
            for lo, hi in pieces(off, 1 << 20):
                flat, sizes = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                sig, row = flat.view(np.int64), np.repeat(np.arange(hi - lo), sizes)
                place = np.minimum(np.searchsorted(often, sig), max(len(often) - 1, 0))
                is_often = often[place] == sig if len(often) else np.zeros(len(sig), bool)
                above = np.bincount(row[is_often], minlength=hi - lo)
                need = -(-sizes * percent // 100)
                o = np.flatnonzero(is_often)
                o = o[np.lexsort((sig[o], -how_often[place[o]], row[o]))]
                rank = np.arange(len(o)) - (np.cumsum(above) - above)[row[o]] + 1
                sure = o[rank >= need[row[o]]]
                at = np.concatenate((np.flatnonzero(~is_often), sure))
                for k in range(0, len(at), 500_000):
                    i = at[k : k + 500_000]
                    rows = pa.array(lo + row[i])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(rows), b.column(2).take(rows), pa.array(sig[i]), pa.array((need - above)[row[i]]), pa.array(is_often[i])], names=["node", "h", "sig", "need", "sure"]
                    )

    found = staged(texts.select("doc_id", "text", "h").mapInArrow(released(ranked), "node long, h long, sig long, need long, sure boolean"), "large-shingles")
    # what stands in one document alone is its rarest; its number says how many of the others belong to the prefix
    rare = found.where("NOT sure").join(counts.where(F.col("df") < F.lit(least)), "sig")
    rest = rare.select("*", F.row_number().over(W.partitionBy("node", "h").orderBy(F.desc("df"), "sig")).alias("rank")).where("rank >= need")
    return rest.select("sig", "node").unionByName(found.where("sure").select("sig", "node")).distinct().withColumn("role", F.lit(INDEX | PROBE))


def _blocks(large: DataFrame, block: int) -> DataFrame:
    """Pairs that may be links, across the components of signatures of any size: the rows are dealt into blocks of about
    ``block`` rows and every two blocks are a group of their own, so that no task holds more than two blocks' rows of a signature."""
    dealt = large.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    x = dealt.select("*", every).where("own <= other").withColumn("bx", F.col("own")).withColumn("by", F.col("other"))
    y = dealt.select("*", every).where("other <= own").withColumn("bx", F.col("other")).withColumn("by", F.col("own"))
    which = (F.col("x.bx") != F.col("x.by")) | (F.col("x.node") < F.col("y.node"))
    return _candidates(x.alias("x"), y.alias("y"), ["sig", "bx", "by"], which, 80)


def linked(docs: DataFrame, percent: int = 80, pairs_upto: int = 64, block: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``.

    In open signatures up to ``pairs_upto`` probing documents are compared with all; ``block`` rows of a larger one stay together.
    Both change the cost and never the result."""
    if percent != 80:
        raise ValueError("the bands and bounds here are those of a similarity of 0.8")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = staged(_keyed(docs), "sets")
    stats = keyed.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    buckets = max(1, -(-int(stats[0]) // PER_BUCKET))
    # written, so that both sides of the join are plain shuffles and a class of very many copies can be split
    classes = staged(keyed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")), "set-classes")
    members = staged(keyed.where("doc_id IS NOT NULL AND n_shingles > 0").join(classes, ["h1", "h2", "n_shingles"]).select("doc_id", "rep"), "classes")
    sets = staged(
        keyed.join(members.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi")
        .select("doc_id", F.col("n_shingles").alias("n"), *[f"s{k}" for k in range(SKETCH)]).distinct(),
        "sketches",
    )
    raw = staged(_runs(_emit(docs, buckets)), "runs")
    lead_role, node_role = F.shiftright("roles", 2), F.col("roles").bitwiseAND(3)
    edges = (
        raw.join(members.select(F.col("doc_id").alias("lead"), F.col("rep").alias("a")), "lead")
        .join(members.select(F.col("doc_id").alias("node"), F.col("rep").alias("b")), "node")
        .where("a <> b")
        .select("sig", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"),
                F.when(F.col("a") < F.col("b"), lead_role).otherwise(node_role).alias("ru"), F.when(F.col("a") < F.col("b"), node_role).otherwise(lead_role).alias("rv"))
        .distinct()
    )
    edges = staged(edges, "edges")

    pairs = (
        edges.where(_meet("ru", "rv")).select("u", "v").distinct()
        .join(sets.alias("x"), F.col("u") == F.col("x.doc_id")).join(sets.alias("y"), F.col("v") == F.col("y.doc_id"))
        .where(_may_link("x", "y", percent)).select("u", "v")
    )
    good = _verified(pairs, docs, percent)
    if good is None:
        good = spark.createDataFrame([], "u long, v long")
    copies = members.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    group = staged(components(good.unionByName(copies)), "components")
    # signatures of more than two documents with an edge that isn't a link and whose ends are still apart stay open
    many = edges.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig")
    apart = (
        edges.join(good, ["u", "v"], "left_anti")
        .join(group.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
        .join(group.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
        .where("coalesce(cu, u) <> coalesce(cv, v)").select("sig").distinct().join(many, "sig", "left_semi")
    )
    ends = (
        edges.join(small(staged(apart, "apart"), FEW), "sig", "left_semi")
        .select("sig", F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("ru").alias("role")), F.struct(F.col("v").alias("node"), F.col("rv").alias("role")))))
        .groupBy("sig", "node").agg(F.bit_or("role").alias("role"))
        .join(sets, F.col("node") == F.col("doc_id")).drop("doc_id")
    )
    for deeper in (True, False):
        group, good, large = _settle(staged(ends, "open"), group, good, copies, docs, percent, pairs_upto)
        if large is None:
            break
        if deeper:
            ends = _prefixes(large, docs, percent).join(sets, F.col("node") == F.col("doc_id")).drop("doc_id")
        else:
            group, good = _across(_blocks(large, block), group, good, copies, docs, percent)
    return keyed.join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each group stays: the one with the least doc_id. Rows with a null doc_id stay."""
    found = linked(docs)
    drop = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_doc_id")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"))
    kept = packed.join(drop, F.col("key") == F.col("_doc_id"), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op1(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s
  FROM w),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS common
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  WITH RECURSIVE r(doc_id, other) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.doc_id, p.y FROM r JOIN pairs p ON p.x = r.other)
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, r.component_id FROM sized s JOIN reach r USING (doc_id)
"""
