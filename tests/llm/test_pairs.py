"""N-gram Jaccard join and line dedup against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from inkstream.llm import line_dedup, ngram_join
from inkstream.llm.components import components
from inkstream.llm.shared import text_column

from .helpers import clashing, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def brute(rows):
    """doc_id -> (size, component) over rows (doc_id, text)."""
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def edited(rng, words, share):
    w = list(words)
    for _ in range(max(1, int(len(w) * share))):
        k = rng.randrange(len(w))
        w[k] = "e%x" % rng.randrange(10**6)
    return w


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, i = [], 0
    shared = prose(99, 60).split()
    for family in range(40):
        base = prose(1000 * seed + family, rng.choice([3, 5, 7, 9, 12, 20, 40, 80, 200, 500]), 10_000).split()
        for _ in range(rng.randint(1, 7)):
            w = edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06]))
            if rng.random() < 0.3:
                w = w + shared
            rows.append((i, " ".join(w), "en", "s", 1))
            i += 1
    got = ngram_join.linked(documents(spark, rows)).collect()
    want = brute([r[:2] for r in rows])
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(shingle_set(rows[r.doc_id][1])) for r in got)
    assert len(set(want.values())) < len(rows) - 20


def test_one_large_family_and_a_common_passage(spark):
    rng = random.Random(5)
    base, passage = prose(7, 90, 5000).split(), prose(8, 40, 5000).split()
    rows = [(k, " ".join(edited(rng, base, 0.025)), "en", "s", 1) for k in range(150)]
    rows += [(1000 + k, " ".join(prose(500 + k, 25, 9000).split() + passage), "en", "s", 1) for k in range(150)]
    got = {r.doc_id: r.component_id for r in ngram_join.linked(documents(spark, rows)).collect()}
    assert got == brute([r[:2] for r in rows])


def test_short_chains_whose_ends_are_not_linked(spark):
    rows = []
    for k in range(40):
        b = prose(3000 + k, 14, 10_000).split()
        texts = [b[:-1] + ["last"], b, ["first"] + b[1:]]
        for i, j in enumerate([(0, 1, 2), (1, 0, 2), (0, 2, 1)][k % 3]):
            rows.append((10 * k + i, " ".join(texts[j]), "en", "s", 1))
    got = {r.doc_id: r.component_id for r in ngram_join.linked(documents(spark, rows)).collect()}
    assert got == brute([r[:2] for r in rows]) == {i: i - i % 10 for i, *_ in rows}


def test_chains_of_all_sizes_whose_least_id_is_linked_to_one_end_only(spark):
    rows, i = [], 0
    for k in range(600):
        n = 13 + k * 7 % 81
        m = max(1, (n - 4) // 9 // 2 + (k % 3 == 0))
        b = prose(9000 + k, n, 50_000).split()
        front, back = ["f%d" % x for x in range(m)] + b[m:], b[:-m] + ["b%d" % x for x in range(m)]
        rows += [(i, " ".join(front), "en", "s", 1), (i + 1, " ".join(b), "en", "s", 1), (i + 2, " ".join(back), "en", "s", 1)]
        i += 3
    got = {r.doc_id: r.component_id for r in ngram_join.linked(documents(spark, rows)).collect()}
    wrong = [k for k in range(600) if {j: got[j] for j in range(3 * k, 3 * k + 3)} != brute([r[:2] for r in rows[3 * k : 3 * k + 3]])]
    assert wrong == []


@pytest.mark.parametrize("upto,block", [(1, 2), (2, 5), (4, 256)])
def test_large_open_signatures_lose_no_link(spark, upto, block):
    """Texts that share a passage, some of them just below and some just above the threshold; every way of following groups."""
    rng = random.Random(11)
    passage = prose(21, 60, 5000).split()
    rows = []
    for k in range(120):
        own = prose(700 + k // 2, rng.choice([8, 10, 12, 14]), 90_000).split()
        if k % 2:
            own[rng.randrange(len(own))] = "edit%d" % k
        rows.append((k, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]), "en", "s", 1))
    got = {r.doc_id: r.component_id for r in ngram_join.linked(documents(spark, rows), pairs_upto=upto, block=block).collect()}
    want = brute([r[:2] for r in rows])
    assert got == want
    assert len(set(want.values())) > 20


@pytest.mark.parametrize("often", [0, 40, 50_000])
def test_prefixes_are_the_rarest_shingles(spark, monkeypatch, often):
    monkeypatch.setattr(ngram_join, "OFTEN", often)
    rng = random.Random(12)
    passages = [prose(60 + k, 30, 5000).split() for k in range(4)]
    rows = [(k, " ".join(prose(800 + k, rng.choice([3, 9, 20]), 90_000).split() + [w for p in rng.sample(passages, rng.randint(0, 3)) for w in p]), "en", "s", 1) for k in range(60)]
    rows.append((99, rows[0][1], "en", "s", 1))
    df = documents(spark, rows)
    got = {(r.node, r.sig) for r in ngram_join._prefixes(df.selectExpr("doc_id AS node"), df.select("doc_id", "text"), 80).collect()}
    sets, count = {}, {}
    for i, t, *_ in rows:
        buf, off = text_column(pa.array([t]))
        sets[i] = ngram_join.shingles(buf, off)[0].view(np.int64).tolist()
        for x in sets[i]:
            count[x] = count.get(x, 0) + 1
    want = set()
    for i, x in sets.items():
        by = sorted(x, key=lambda v: (-count[v], v))
        want |= {(i, v) for v in by[-(-len(by) * 80 // 100) - 1 :] if count[v] > 1}
    assert got == want and want


def test_bounds_of_the_bands():
    for n in (4, 5, 9, 10, 99, 1000, 12345):
        band = int(np.searchsorted(ngram_join.EDGES, n, "right")) - 1
        most = (n + n * 5 // 4) // 9
        assert ngram_join.SEGMENTS[band] + ngram_join.DELETABLE[band] > most and ngram_join.DELETABLE[band] <= ngram_join.SEGMENTS[band]


def test_signatures_find_sets_that_differ_as_much_as_allowed():
    rng = np.random.default_rng(3)
    for size in (9, 18, 40, 100, 300, 900):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, size * 2).astype(np.uint64))[:size]
            y = x
            while True:  # swap and drop until the pair is just linked
                z = np.unique(np.concatenate((y[rng.permutation(len(y))[: len(y) - 1]], rng.integers(0, 2**63, rng.integers(0, 2)).astype(np.uint64))))
                common = len(np.intersect1d(x, z))
                if 100 * common < 80 * (len(x) + len(z) - common) or len(z) == 0:
                    break
                y = z
            row, sig, role = ngram_join.signatures(np.concatenate((x, y)), np.array([len(x), len(y)]))
            met = {}
            for r, s, k in zip(row.tolist(), sig.tolist(), role.tolist()):
                met.setdefault(s, {}).setdefault(r, 0)
                met[s][r] |= k
            ok = any(len(v) == 2 and (v[0] & 1 and v[1] & 2 or v[0] & 2 and v[1] & 1) for v in met.values())
            assert ok or not len(y)


def test_awkward_rows(spark):
    df = clashing(documents(spark))
    got = ngram_join.linked(df).collect()
    assert len(got) == df.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[1] == {(116, 1)} and by[2] == {(116, 1)} and by[4] == {(0, 4)} and by[5] == {(0, 5)} and by[6] == {(0, 6)}
    assert {c for _, c in by[3]} == {1} and by[10] == {(1, 10)} and by[12] == {(1, 10)} and {c for _, c in by[None]} == {None}
    kept = ngram_join.distinct_documents(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7, 8, 9, 10, 10, 11, 13, 14]
    assert ngram_join.linked(df.limit(0)).count() == 0


def test_component_search(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (200, 200)]
    for few in (0, 1000):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), few).collect()}
        assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_lines(rows, least=50):
    """doc_id -> text without lines that lie in a run of ``least`` words that stands earlier."""
    first, found = {}, []
    for d, text in sorted(rows):
        lines = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((text or "").split("\n"))]
        lines = [(i, x) for i, x in lines if x]
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(lines[b][1].split())
                if words >= least:
                    key = "\n".join(x for _, x in lines[a : b + 1])
                    found.append((d, lines[a][0], lines[b][0], key))
                    first.setdefault(key, (d, lines[a][0]))
    gone = {}
    for d, s, e, key in found:
        if (d, s) > first[key]:
            gone.setdefault(d, set()).update(range(s, e + 1))
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone.get(d, ())) for d, t in rows}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    pool = [prose(k, rng.randint(1, 30), 300).replace("\n", " ") for k in range(60)] + ["", "  ", prose(77, 70).replace("\n", " ")]
    runs = [[rng.choice(pool) for _ in range(rng.randint(2, 8))] for _ in range(12)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(rng.randint(1, 5)):
            lines += rng.choice(runs) if rng.random() < 0.5 else [prose(10_000 * d + len(lines), rng.randint(1, 40)).replace("\n", " ")]
        rows.append((d, "\n".join(lines), "en", "s", 1))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, rows), counts=True).collect()}
    want = brute_lines([r[:2] for r in rows])
    assert {d: r.text for d, r in got.items()} == want
    assert sum(r.n_deleted for r in got.values()) > 100 and all(r.n_chars == len(r.text) for r in got.values())


def test_runs_are_disjoint_and_maximal(spark):
    a = [prose(10 + k, 12).replace("\n", " ") for k in range(40)]
    rows = [(1, "\n".join(a)), (2, "\n".join(a[:10] + ["other words here"] + a[20:33])), (3, "\n".join(a[20:33] + a[:10]))]
    df = spark.createDataFrame([(d, d, t) for d, t in rows], "doc long, text_hash long, text string")
    assert sorted(tuple(r) for r in line_dedup.repeated_runs(df).collect()) == [(2, 2, 0, 9), (2, 2, 11, 23), (3, 3, 0, 22)]


def test_line_dedup_is_linear_in_lines(spark):
    """One long document twice: every line goes from the second."""
    import time

    took = []
    for n in (500, 10_000, 40_000):
        text = "\n".join("line %d has words %x" % (k, k * 2654435761 % 2**32) for k in range(n))
        rows = [(1, text, "en", "s", 1), (2, "first\n" + text + "\nlast", "en", "s", 1)]
        began = time.time()
        got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, rows), counts=True).collect()}
        took.append(time.time() - began)
        assert got[1].n_deleted == 0 and got[2].text == "first\nlast" and got[2].n_deleted == n and got[2].n_lines == n + 2
    assert took[2] - took[0] < 8 * max(took[1] - took[0], 0.5)


def test_line_dedup_awkward_rows(spark):
    df = clashing(documents(spark))
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    texts = {}
    for r in out.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[1][0] and texts[2] == [""] and texts[5] == [None] and texts[4] == [""] and texts[10] == ["One two"] * 2
    left = {r.doc_id for r in line_dedup.dedup_lines(df, drop_emptied=True).collect()}
    assert 2 not in left and {1, 4, 5, 6} <= left
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
