"""Edit-embedding fingerprints."""

import hashlib
import random

import numpy as np

from inkstream.llm import edit_fingerprint as E

from .helpers import awkward, clashing, documents, prose


def walk_slowly(text):
    """One text's walk, step by step."""
    octave = int(E.octaves(np.array([len(text)]))[0])
    code = E.codes([text]) if text else np.zeros(0, np.uint8)
    wanted = {int(s): i for i, s in enumerate(E.steps(octave))}
    out, pos = [E.PAD] * E.SLOTS, 0
    for step in range(max(wanted) + 1):
        if pos >= len(code):
            break
        if step in wanted:
            out[wanted[step]] = int(E._SYMBOL[code[pos]])
        pos += int(E._BITS[step % E.STEPS, code[pos]])
    return octave, out


def test_walk_equals_the_slow_walk():
    rng = random.Random(1)
    texts = ["", "a", "é漢🙂", "x" * 300] + [prose(k, rng.randint(1, 400)) for k in range(60)]
    octave, symbols = E.walk(texts)
    for t, o, s in zip(texts, octave.tolist(), symbols.tolist()):
        assert (o, s) == walk_slowly(t)
    o, s = E.read(E.text_of(octave, symbols))
    assert np.array_equal(o, octave) and np.array_equal(s, symbols)


def test_steps_are_nested():
    for o in range(E.FIRST, 22):
        s = E.steps(o)
        assert len(s) == E.SLOTS and (np.diff(s) > 0).all() and s[-1] < 1 << o
        if o > E.FIRST:
            assert len(E.shared_slots(o, o - 1)[0]) >= E.SLOTS // 2


def test_likeness_falls_with_edits():
    rng = random.Random(2)
    means = []
    for edits in (0, 2, 8, 40, 400):
        pairs = []
        for k in range(30):
            t = prose(k, 300, 5000)
            x = list(t)
            for _ in range(edits):
                i = rng.randrange(len(x))
                x[i : i + 1] = rng.choice([[], ["q"], [x[i], "q"]])
            pairs.append((t, "".join(x)))
        oa, a = E.walk([p[0] for p in pairs])
        ob, b = E.walk([p[1] for p in pairs])
        means.append(float(E.likeness(oa, a, ob, b).mean()))
    assert means[0] == 1 and means == sorted(means, reverse=True) and means[1] > 0.85 and means[-1] < 0.3


def test_fingerprints_of_documents(spark):
    rows = [r for r in awkward() if r[0] is not None and r[0] != 10] + [(20 + i, prose(i, 50), "en", "s", 1) for i in range(60)]
    got = {r.doc_id: r for r in E.fingerprints(clashing(documents(spark, rows)), bucket_rows=7).collect()}
    text = {r[0]: r[1] or "" for r in rows}
    order = sorted(text, reverse=True)
    prints = {}
    for i, d in enumerate(order):
        x, y = text[d], text[order[(i + 1) % len(order)]]
        k = len(x) // 3
        ed = x[: len(x) - k] + y[:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(ed.encode()).hexdigest())
        (o, s) = walk_slowly(ed)
        assert r.edited_fingerprint == E.text_of(np.array([o]), np.array([s], np.uint8))[0]
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        prints.setdefault(x, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values()) and len(got) == len(rows)


def test_awkward_rows_and_near(spark):
    df = documents(spark)
    got = E.fingerprints(df, bucket_rows=2).collect()
    assert len(got) == df.count()
    assert E.fingerprints(df.limit(0)).count() == 0 and E.fingerprints(df.where("doc_id = 1")).first().near_next == 1.0
    base = prose(5, 400, 9000)
    rows = [(k, base[:k] + "Q" + base[k:], "en", "s", 1) for k in range(10, 2000, 100)] + [(5000 + k, prose(900 + k, 300, 9000), "en", "s", 1) for k in range(30)]
    near = {r.doc_id: r.near_id for r in E.near(E.fingerprints(documents(spark, rows))).collect()}
    assert all(v == 10 for k, v in near.items() if k < 5000) and sum(k < 5000 for k in near) >= 19 and not any(k >= 5000 for k in near)


def pairs_with_likeness(texts, threshold):
    octave, symbols = E.walk(texts)
    n = len(texts)
    i, j = np.triu_indices(n, 1)
    like = E.likeness(octave[i], symbols[i], octave[j], symbols[j])
    return [(int(a), int(b)) for a, b in zip(i[like >= threshold], j[like >= threshold])], E.text_of(octave, symbols)


def test_recall_against_all_pairs(spark):
    """At least nine of ten pairs whose likeness is 0.8 or more are in one group: at borders of octaves, short texts, and in between."""
    rng = random.Random(4)

    def edit(t, edits):
        x = list(t)
        for _ in range(edits):
            i = rng.randrange(len(x))
            x[i : i + 1] = rng.choice([["q"], [x[i], "q"], []])
        return "".join(x)

    for name, sizes in {"border": [511, 512, 513, 1024, 1025, 2047], "short": list(range(12, 100, 3)), "any": list(range(120, 4000, 171))}.items():
        texts = []
        for k in range(220):
            t = prose(9000 + k, 900, 5000)[: rng.choice(sizes)]
            texts += [t, edit(t, rng.choice([1, 1, 1, 2, 3]))] + ([t[:-1], t + "x"] if k % 3 == 0 else [])
        texts = list(dict.fromkeys(texts))
        pairs, prints = pairs_with_likeness(texts, 0.8)
        df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fingerprint string")
        got = {r.doc_id: r.near_id for r in E.near(df).collect()}
        found = sum(got.get(a, a) == got.get(b, b) for a, b in pairs)
        assert len(pairs) > 100 and found >= 0.9 * len(pairs), (name, found, len(pairs))
        parent = list(range(len(texts)))
        for a, b in pairs:  # and no group but by such pairs
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        for d, rep in got.items():
            while parent[d] != d:
                d = parent[d]
            while parent[rep] != rep:
                rep = parent[rep]
            assert d == rep


def test_large_bands_still_find_their_pairs(spark):
    """Texts that begin alike share many bands; those that are like each other must still meet."""
    head = prose(77, 30, 500)
    rng = random.Random(8)
    texts = []
    for k in range(150):
        t = head + prose(4000 + k, 40, 5000)
        i = rng.randrange(len(head), len(t))
        texts += [t, t[:i] + "Q" + t[i + 1 :]]
    pairs, prints = pairs_with_likeness(texts, 0.8)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    u = {tuple(sorted((r.u, r.v))) for r in E.links(df, few=4).collect()}
    assert u <= set(pairs)
    got = {r.doc_id: r.near_id for r in E.near(df).collect()}
    assert sum(got.get(a, a) == got.get(b, b) for a, b in pairs) >= 0.9 * len(pairs) > 90


def test_no_pair_of_a_key_is_lost(spark, monkeypatch):
    """Whatever a key's size: the links join all that is joined by pairs that share a key and are like each other."""
    monkeypatch.setattr(E, "BLOCK", 16, raising=False)
    monkeypatch.setattr(E, "TILE", 5, raising=False)
    rng = random.Random(12)
    texts = []
    head = prose(55, 120, 500)
    for k in range(90):  # all begin alike, so that keys and pairs of keys are large, and pairs differ in much of the rest
        t = (head + prose(7000 + k, 60, 5000))[: rng.choice([700, 720, 740])]
        i = rng.randrange(len(head) + 20, len(t) - 20)
        texts += [t, t[:i] + "Q" * 30 + t[i + 1 :]]
    texts += [prose(6000 + k, 4, 30) for k in range(60)]
    pairs, prints = pairs_with_likeness(texts, 0.8)
    row, *_, key = E.band_keys(*E.read(prints))
    keys = [set(key[row == i].tolist()) for i in range(len(prints))]
    wanted = [(a, b) for a, b in pairs if keys[a] & keys[b]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    got = {tuple(sorted((r.u, r.v))) for r in E.links(df, few=2).collect()}

    def groups(links):
        parent = list(range(len(texts)))

        def top(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for a, b in links:
            parent[max(top(a), top(b))] = min(top(a), top(b))
        return [top(a) for a in range(len(texts))]

    assert got <= set(pairs) and groups(got) == groups(wanted) and len(wanted) > 80


def test_rows_without_ids_are_dealt_to_buckets(spark):
    rows = [(None, prose(k, 20), "en", "s", 1) for k in range(40)] + [(k, prose(100 + k, 20), "en", "s", 1) for k in range(20)]
    df = documents(spark, rows)
    whole, parts = (sorted((r.edited_sha256, r.near_next) for r in E.fingerprints(df, bucket_rows=n).collect()) for n in (1000, 5))
    assert whole == parts and len(whole) == 60
