"""Toxicity, language model, page extraction: exact parts against direct computation, models on held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkstream.llm import html_crf, lm_scoring, media, toxicity
from inkstream.llm.shared import text_column

from .helpers import awkward, clashing, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- toxicity ----


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    bad = ["zorkish", "zorkful", "grumbat", "grumbit"]
    docs, labels = [], []
    for i in range(n):
        w = prose(seed * 10_000 + i, rng.randint(20, 200), 900).split(" ")
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = labelled()
    df, lab = documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    detector = toxicity.fit(df, lab)
    got = {r.row.doc_id: r.score for r in toxicity.scored(df, detector).collect()}
    held = [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.93 and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.reject(clashing(df), lab)
    assert kept.columns == clashing(df).columns and 300 <= kept.count() <= 340


def test_scores_do_not_depend_on_held_out_labels_or_columns(spark):
    docs, labels = labelled(200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a = toxicity.fit(documents(spark, docs), spark.createDataFrame(labels, schema))
    b = toxicity.fit(documents(spark, [(i, t, "xx", "other", 0) for i, t, *_ in docs]), spark.createDataFrame(flipped, schema))
    buf, off = text_column(pa.array([d[1] for d in docs]))
    assert np.array_equal(a.score(buf, off), b.score(buf, off))


def test_shared_backoff_is_a_distribution():
    rng = np.random.default_rng(1)
    words = sorted({bytes(rng.integers(97, 103, rng.integers(1, 8)).astype(np.uint8)) for _ in range(300)})
    buf, off = text_column(pa.array(words, pa.binary()))
    key, _ = toxicity._keys(buf, off[:-1], off[1:])
    types = np.unique(key)
    p = toxicity._shared(types)
    assert ((p > 0) & (p <= 1)).all()
    lower = types & toxicity.U((1 << 48) - 1)
    ctx, at = np.unique(lower >> toxicity.U(8), return_inverse=True)
    _, first = np.unique(lower, return_index=True)
    assert (np.bincount(at[first], weights=p[first]) <= 1 + 1e-9).all()


def test_llr_equals_direct_probabilities():
    words, ct, co = [b"ab", b"abc", b"xyz"], np.array([2.0, 0, 3]), np.array([1.0, 4, 0])
    buf, off = text_column(pa.array(words, pa.binary()))
    m = toxicity.train(buf, off[:-1], off[1:], ct, co)
    grams = {}
    for w, t, o in zip(words, ct, co):
        x = b"\0" * 6 + w + b" "
        for i in range(6, len(x)):
            g = grams.setdefault(x[i - 6 : i + 1], [0, 0])
            g[0] += t
            g[1] += o
    shared = dict(zip(m.gram.tolist(), toxicity._shared(m.gram)))

    def prob(g, k):
        same = [v[k] for h, v in grams.items() if h[:6] == g[:6]]
        total, kinds = sum(same), sum(v > 0 for v in same)
        low = shared[int.from_bytes(g, "big")]
        return low if not total else max(grams[g][k] - 0.75, 0) / total + 0.75 * kinds / total * low

    for w in words:
        x = b"\0" * 6 + w + b" "
        want = sum(math.log(prob(x[i - 6 : i + 1], 0) / prob(x[i - 6 : i + 1], 1)) for i in range(6, len(x)))
        b, o = text_column(pa.array([w], pa.binary()))
        assert abs(toxicity.word_llr(m, b, o[:-1], o[1:])[0] - want) < 1e-4


def slow_measures(model, text):
    """The differences said word by word."""
    found = [(m.start(), m[0]) for m in re.finditer(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").translate({i: i + 32 for i in range(65, 91)}))]
    if not found:
        return [0.0] * toxicity.MEASURES

    def llr(word):
        b, o = text_column(pa.array([word.encode()], pa.binary()))
        return float(toxicity.word_llr(model, b, o[:-1], o[1:])[0])

    words = [w for _, w in found]
    x, size = [llr(w) for w in words], [len(w.encode()) + 1 for w in words]
    kinds = {w: v for w, v in zip(words, x)}
    best = sorted(kinds.values(), reverse=True)
    k = toxicity.WINDOW
    spans = [x[i : i + k] for i in range(max(1, len(x) - k + 1))]
    return [
        sum(x) / len(x), sum(x) / sum(size), sum(best) / math.sqrt(len(best)), max(sum(s) / len(s) for s in spans), sum(v for v in best if v > 3) / math.sqrt(len(x)),
        max(best[0], 0), sum(max(v, 0) for v in best[:3]) / 3, max(v / math.sqrt(n) for v, n in zip(x, size)),
    ]


def test_scores_equal_a_slow_computation(spark, sf):
    """The registered query's score is the logistic function of the differences of the whole text."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    d = toxicity.fit(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r for r in toxicity.op5(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows[::9]:
        z = sum(w * (m - a) / b for w, m, a, b in zip(d.weights, slow_measures(d.model, r.text), d.mean, d.scale)) + d.weights[-1]
        want = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert abs(got[r.doc_id].score - want) < 1e-5 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_awkward_rows(spark):
    df = clashing(documents(spark))
    schema = "doc_id long, quality int, toxic int"
    few = spark.createDataFrame([(1, 1, 1), (2, None, 0), (3, 0, None), (None, 1, 1), (1, 1, 0), (9, 1, 0), (9, 1, 0)], schema)
    for lab in (few, few.limit(0), few.where("toxic = 0")):
        rows = toxicity.scored(df, toxicity.fit(df, lab)).collect()
        assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.reject(df.limit(0), few).count() == 0


# ---- language model ----


def tokens_of(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)})) + [None]


@pytest.mark.parametrize("hot", [0, 20, 200_000])
def test_base_scores_are_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    monkeypatch.setattr(lm_scoring, "MOST_PASSES", 1)
    rows = awkward() + [(100 + i, prose(i, 60, 50), "en", "s", 1) for i in range(60)]
    got = lm_scoring.scores(clashing(documents(spark, rows))).collect()
    held = lambda i: zlib.crc32((b"" if i is None else str(i).encode())) % 5 == 1
    count = Counter(w for i, t, *_ in rows if not held(i) for w in tokens_of(t))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t, *_ in rows:
        w = tokens_of(t)
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[i, held(i), len(w), sum(count[x] > 0 for x in w), n, f"{base:.8g}"] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.8g}") for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_scores_mix_all_known_words_alike(spark, monkeypatch):
    fit, kept, found = lm_scoring.train, [], []
    monkeypatch.setattr(lm_scoring, "train", lambda *a: kept[0] if kept else kept.append(fit(*a, passes=1)) or kept[0])
    rows = awkward() + [(100 + i, prose(i, 60, 50), "en", "s", 1) for i in range(60)]
    docs = documents(spark, rows)
    for hot in (200_000, 20, 0):
        monkeypatch.setattr(lm_scoring, "HOT", hot)
        got = lm_scoring.scores(docs).select("doc_id", "n_tokens", "score").collect()
        found.append(sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in got))
    for other in found[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in found[0]]
        assert np.allclose([x[2] for x in other], [x[2] for x in found[0]], rtol=1e-9)


def test_lm_of_an_empty_table(spark):
    assert lm_scoring.scores(documents(spark).limit(0)).count() == 0


def beside(ids):
    """Neighbours of ids, counted one by one."""
    n = np.bincount(ids, minlength=lm_scoring.VOCAB).astype(float)
    row = {int(i): k for k, i in enumerate(lm_scoring._top(n))}
    out = np.zeros((lm_scoring.SINGLE, 2 * lm_scoring.BESIDE))
    for a, b in zip(ids[:-1].tolist(), ids[1:].tolist()):
        a, b = row.get(a, 10**6), row.get(b, 10**6)
        if b < lm_scoring.SINGLE and a < lm_scoring.BESIDE:
            out[b, a] += 1
        if a < lm_scoring.SINGLE and b < lm_scoring.BESIDE:
            out[a, b + lm_scoring.BESIDE] += 1
    return n, out


def model(seed=3, docs=150, passes=6):
    texts = [prose(seed * 1000 + i, 80, 60) for i in range(docs)]
    buf, off = text_column(pa.array(texts))
    _, _, _, ids, sizes, parts, last = lm_scoring._sequence(buf, off)
    m = lm_scoring.untrained(*beside(ids))
    windows, _ = lm_scoring._drawn(ids, sizes, np.arange(len(sizes), dtype=np.uint64), np.ones(len(sizes), bool), lm_scoring.Draw(1.0, 1, 1))
    m.flat = lm_scoring.descend(m, windows, passes, (0, 1), 1)
    return m, ids, sizes


def test_each_id_is_scored_once_and_causally():
    m, ids, sizes = model()
    one = lm_scoring.id_log_probabilities(m, ids, sizes)
    assert len(one) == len(ids) and np.isfinite(one).all()
    k = int(sizes[0])
    alone = lm_scoring.id_log_probabilities(m, ids[:k], sizes[:1])
    assert np.allclose(alone, one[:k], atol=1e-4)  # other documents don't matter
    changed = ids[:k].copy()
    changed[40:] = lm_scoring.END_ID
    assert np.allclose(lm_scoring.id_log_probabilities(m, changed, sizes[:1])[:40], alone[:40], atol=1e-4)  # nor do later ids


def test_next_id_probabilities_sum_to_one():
    m, ids, sizes = model(docs=40)
    prefix = ids[:9]
    total = 0.0
    for lo in range(0, lm_scoring.VOCAB, 5000):
        nxt = np.arange(lo, min(lo + 5000, lm_scoring.VOCAB))
        seq = np.concatenate([np.append(prefix, i) for i in nxt])
        p = lm_scoring.id_log_probabilities(m, seq, np.full(len(nxt), len(prefix) + 1))
        total += np.exp(p[len(prefix) :: len(prefix) + 1]).sum()
    assert abs(total - 1) < 1e-3


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m, *_ = model(docs=20, passes=1)
    flat = m.flat.astype(np.float64)
    p, g = lm_scoring.views(flat), lm_scoring.views(np.zeros_like(flat))
    both = rng.integers(0, 50, (3, 32))
    both[0, :5] = lm_scoring.PAD
    cluster, member, live = rng.integers(0, 4, (3, 16)), rng.integers(0, 9, (3, 16)), rng.random((3, 16)) < 0.8
    p["w2"][:4, -1, :9] = 0.0
    spare = lm_scoring.views(np.zeros_like(flat))
    lm_scoring._steps(p, both, cluster, member, live, g)
    for name in p:
        values = p[name].reshape(-1)
        for at in np.argsort(-np.abs(g[name]).reshape(-1))[:3].tolist():
            keep, e = values[at], 1e-5
            values[at] = keep + e
            up = lm_scoring._steps(p, both, cluster, member, live, spare)
            values[at] = keep - e
            down = lm_scoring._steps(p, both, cluster, member, live, spare)
            values[at] = keep
            assert abs((up - down) / (2 * e) - g[name].reshape(-1)[at]) < 2e-3 * max(1, abs(g[name].reshape(-1)[at])), name


def test_steps_take_all_clusters_at_once(monkeypatch):
    """Two softmaxes a batch, whatever the number of clusters; loss and gradients are those of one row after the other."""
    k = lm_scoring
    m, ids, sizes = model(docs=40, passes=1)
    windows, _ = k._drawn(ids, sizes, np.arange(len(sizes), dtype=np.uint64), np.ones(len(sizes), bool), k.Draw(1.0, 1, 1))
    both, target = m.context[windows[:6, :-1]], windows[:6, 17:]
    live = target != k.PAD_ID
    known = np.where(live, target, 0)
    cluster, member = m.cluster[known], m.member[known]
    p, g = k.views(m.flat.astype(np.float64)), k.views(np.zeros(k.PARAMETERS))
    calls, softmax, share = [], k._softmax, k._Tables.log_share
    monkeypatch.setattr(k, "_softmax", lambda *a: calls.append(1) or softmax(*a))
    loss = k._steps(p, both, cluster, member, live, g)
    assert len(np.unique(cluster[live])) > 2 and len(calls) == 2
    x, want1, want2, n, want = k._inputs(p, both)[0], np.zeros_like(p["w1"]), np.zeros_like(p["w2"]), live.sum(), 0.0
    for i, j in np.argwhere(live):
        c, at = int(cluster[i, j]), int(member[i, j])
        for w, place, out in ((p["w1"], c, want1), (p["w2"][c], at, want2[c])):
            share_of = np.exp(x[i, j] @ w)
            share_of /= share_of.sum()
            want -= np.log(share_of[place]) / n
            share_of[place] -= 1
            out += np.outer(x[i, j], share_of) / n
    assert abs(loss - want) < 1e-6 and np.allclose(g["w1"], want1, atol=1e-7) and np.allclose(g["w2"], want2, atol=1e-7)
    monkeypatch.setattr(k._Tables, "log_share", lambda *a: calls.append(1) or share(*a))
    k.id_log_probabilities(m, ids[: int(sizes[0])], sizes[:1])
    assert len(calls) == 4


@pytest.mark.parametrize("values", [[], [7], [5, 3, 5, 2**64 - 1, 0, 3], [9, 8, 9, 8, 2**63 + 1, 2**63], list(range(40)) * 3, [i << 40 for i in range(40)] * 3])
def test_distinct_hashes(values):
    """Also where hashes differ in their lowest bits alone."""
    h = np.array(values, np.uint64)
    for got, want in zip(lm_scoring._distinct(h), np.unique(h, return_index=True, return_inverse=True)):
        assert np.array_equal(got, want)


def test_scores_equal_a_slow_attention():
    """Each id's probability by loops over keys, members and clusters."""
    m, ids, sizes = model(docs=30)
    p, k = m.p, lm_scoring
    seq = ids[: int(sizes[0])].tolist()
    got = k.id_log_probabilities(m, ids[: int(sizes[0])], sizes[:1])
    given = [k.START_ID] + seq[:-1]
    for i, target in enumerate(seq):
        block = i // 16 * 16
        own = m.context[given[i]]
        q, e = p["qe"][own][: k.KEY], p["qe"][own][k.KEY :]
        weights, values = [], []
        for j in range(max(0, block - 16), i + 1):
            kv = p["kv"][m.context[given[j]]]
            weights.append(math.exp(min(30.0, float(q @ kv[: k.KEY]) + float(p["r"][i - j]))))
            values.append(kv[k.KEY :])
        a = sum(w * v for w, v in zip(weights, values)) / sum(weights)
        x = np.concatenate((a, e, a[: k.CROSS] * e[: k.CROSS], [1]))
        c, n = int(m.cluster[target]), int(m.member[target])
        one, two = x @ p["w1"], x @ p["w2"][c]
        want = one[c] - math.log(sum(math.exp(t) for t in one)) + two[n] - math.log(sum(math.exp(t) for t in two)) + m.inside[target]
        assert abs(got[i] - want) < 1e-3


def test_windows_cover_every_place_once():
    texts = [prose(i, 5 + 7 * i, 60) for i in range(30)]
    buf, off = text_column(pa.array(texts))
    _, _, _, ids, sizes, _, _ = lm_scoring._sequence(buf, off)
    every = lm_scoring.Draw(1.0, 3, 4)
    w, where = lm_scoring._drawn(ids, sizes, np.arange(30, dtype=np.uint64), np.ones(30, bool), every)
    target = w[:, 17:]
    assert Counter(target[target != lm_scoring.PAD_ID].tolist()) == Counter(ids.tolist()) and set(where.tolist()) == set(range(12))
    seq, n = ids[: int(sizes[0])].tolist(), int(sizes[0])
    flat = [lm_scoring.PAD_ID] * 16 + [lm_scoring.START_ID] + seq
    assert w[0].tolist() == (flat[:33] + [lm_scoring.PAD_ID] * 33)[:33] and n > 5
    part, _ = lm_scoring._drawn(ids, sizes, np.arange(30, dtype=np.uint64), np.arange(30) % 2 == 0, lm_scoring.Draw(0.25, 1, 1))
    assert 0.1 * len(w) / 2 < len(part) < 0.5 * len(w) / 2


def test_training_over_shards(spark):
    """Neighbours are counted, and parameters averaged, over all windows, wherever they are."""
    texts = [prose(500 + i, 80, 60) for i in range(200)]
    buf, off = text_column(pa.array(texts))
    _, _, _, ids, sizes, _, _ = lm_scoring._sequence(buf, off)
    draw = lm_scoring.Draw(1.0, 3, lm_scoring.ROUNDS)
    w, where = lm_scoring._drawn(ids, sizes, np.arange(200, dtype=np.uint64), np.ones(200, bool), draw)
    df = spark.createDataFrame([(int(k), int((where == k).sum()), w[where == k].tobytes()) for k in np.unique(where)], "key long, n long, data binary").repartition(5)
    n = np.bincount(ids, minlength=lm_scoring.VOCAB).astype(float)
    got = lm_scoring.neighbours(df, n)
    row = {int(i): k for k, i in enumerate(lm_scoring._top(n))}
    want = np.zeros_like(got)
    for a in w[:, 16:].tolist():
        for x, y in zip(a, a[1:]):
            x, y = row.get(x, 10**6), row.get(y, 10**6)
            if y < lm_scoring.SINGLE and x < lm_scoring.BESIDE:
                want[y, x] += 1
            if x < lm_scoring.SINGLE and y < lm_scoring.BESIDE:
                want[x, y + lm_scoring.BESIDE] += 1
    assert np.array_equal(got, want)
    m = lm_scoring.train(df, n, draw, passes=4)
    start = lm_scoring.untrained(n, got)
    assert lm_scoring.id_log_probabilities(m, ids, sizes).mean() > lm_scoring.id_log_probabilities(start, ids, sizes).mean() + 0.1


def test_training_is_alike_at_all_sizes(spark, monkeypatch):
    """All windows, in as many rounds and in batches as large, whether they fill a part of a shard or many."""
    k = lm_scoring
    docs = documents(spark, [(i, prose(i, 90, 900), "en", "s", 1) for i in range(60)]).selectExpr("text", "xxhash64(text) AS text_hash", "doc_id % 9 = 0 AS tuned").cache()
    rows = [r for r in docs.collect() if not r.tuned]
    off = np.cumsum([0] + [len(r.text) for r in rows])
    _, _, _, _, sizes, _, _ = k._sequence(np.frombuffer("".join(r.text for r in rows).encode(), np.uint8), off)
    every = int((-(-sizes // k.BLOCK)).sum())
    for shard in (1 << 18, every // 4, 7):
        monkeypatch.setattr(k, "SHARD", shard)
        draw = k.plan(docs)
        found = k.gathered(docs, draw).where("kind = 2").groupBy().agg({"n": "sum", "key": "max"}).first()
        assert (draw.rounds, found["sum(n)"]) == (k.ROUNDS, every) and (draw.shards > 1) == (shard < every)
    steps = []
    monkeypatch.setattr(k, "_steps", lambda p, both, *rest: steps.append(len(both)))
    m = k.untrained(*beside(np.zeros(5, np.int64)))
    for n in (300, 3000, 30000):
        k.descend(m, np.zeros((n, 33), np.uint16), 1, (0, 1), 1)
        assert steps[0] == k.BATCH and len(steps) == -(-n // k.BATCH)
        steps.clear()


def test_scores_beat_the_base_on_held_out_documents(spark, sf):
    """The smallest table has too few texts to learn from; the next one is enough."""
    found = lm_scoring.op7(spark, sf.replace("sf0.001", "sf0.01")).groupBy("held_out").agg({"score": "sum", "base_score": "sum"}).collect()
    held = next(r for r in found if r.held_out)
    assert held["sum(score)"] > held["sum(base_score)"]


def test_model_beats_the_ids_shares():
    m, ids, sizes = model()
    n = np.bincount(ids, minlength=lm_scoring.VOCAB) + 1.0
    assert lm_scoring.id_log_probabilities(m, ids, sizes).mean() > np.log(n / n.sum())[ids].mean() + 0.1


# ---- pages ----


def test_held_out_layouts():
    field = html_crf.trained()
    blocks = right = 0
    for page, states in html_crf.labelled_pages(120, seed=77):
        got = field.decode(html_crf.blocks(page))
        assert len(got) == len(states)
        blocks += len(states)
        right += sum(a == b for a, b in zip(got, states))
    assert right / blocks > 0.98


def test_viterbi_equals_exhaustive_search():
    field = html_crf.trained()
    rng = random.Random(1)
    for page, _ in html_crf.labelled_pages(15, seed=8):
        b = html_crf.blocks(page)[: rng.randint(1, 9)]
        s = field.scores(b)

        def total(y):
            return field.first[y[0]] + sum(s[i][k] for i, k in enumerate(y)) + sum(field.moves[i, j] for i, j in zip(y, y[1:]))

        best = max(([(k >> i) & 1 for i in range(len(b))] for k in range(1 << len(b))), key=total)
        assert abs(total(field.decode(b)) - total(best)) < 1e-9


def test_pages_of_the_table(spark, sf):
    """In these pages the article element is the truth."""
    got = {r.page_id: r for r in html_crf.op8(spark, sf).collect()}
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article[^>]*>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|h2|ul|ol|li|div|blockquote)[^>]*>", body)]
        want = "\n\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


@pytest.mark.parametrize("start", ["<body><p>", "<p>", "<body>", "", "<noscript><link href=x></noscript><p>"])
def test_head_without_an_end_tag(start):
    page = f"<html><head><meta charset=x><title>A title</title><style>p {{}}</style>{start}Some text<p>More"
    for html in (page, page.replace("</style>", "</style></head>")):
        assert [b[1] for b in html_crf.blocks(html)] == ["Some text", "More"]
        assert [x["text"] for x in media.parse(html)] == ["Some text", "More"]
    assert [b[1] for b in html_crf.blocks("<head><template><p>no</template><title>no</title></head><p>yes")] == ["yes"]
    assert [x["text"] for x in media.parse("<head><template><p>no</template><title>no</title></head><p>yes")] == ["yes"]


TWO = "<p>The quick brown fox jumps over the lazy dog, and then it rests for a while.</p><p>Another paragraph of plain text that has some words in it.</p>"
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>'


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><body>{TWO}", f"<html><body>{TWO}</body></html>", TWO, f"<body><section>{TWO}</section>", f'<body><div id="x12">{TWO}</div>', f'<div class="wrapper">{TWO}</div>',
        f"<body>{MENU}{TWO}<footer><p>&copy; 2024 Example Corp.</p></footer>", f'<div class="page"><div class="row"><div class="col">{TWO}</div></div></div>', f"<body>{MENU}<div>{TWO}</div>",
        f'<body><div class="container">{MENU}<div class="zz-9">{TWO}</div><div class="footer"><div>Some company name</div></div></div>', f'<main><div class="q">{TWO}</div></main>',
        f'<body>{TWO}<div class="comments"><h3>Comments</h3><div class="comment"><p>I like the story about the fox very much, thank you for it.</p></div></div>',
        f'<div class="advert">Buy our new shoes today.</div><div class="unheard-of">{TWO}</div><aside><p>Other stories that you may like to read today.</p></aside>',
    ],
)
def test_ordinary_layouts_give_their_text(page):
    want = "The quick brown fox jumps over the lazy dog, and then it rests for a while.\n\nAnother paragraph of plain text that has some words in it."
    assert html_crf.main_text(page, html_crf.trained()) == want


def test_formulas_and_fallbacks_are_text():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given as a number here.</p><p>See <object>the drawing of a cat</object> and <svg><title>no</title><text>its label</text></svg> in it.</p></article>"
    assert html_crf.main_text(page, html_crf.trained()) == "Let x=2 be given as a number here.\n\nSee the drawing of a cat and its label in it."


def test_inline_ends_leave_blocks_open():
    got = [(b[0].inner, b[1]) for b in html_crf.blocks("<div class=comment><b><p>one</b> two<p>three</div><article><p>four")]
    assert got == [(("div", "p"), "one two"), (("div", "p"), "three"), (("article", "p"), "four")]


def test_path_features_are_those_of_all_open_elements():
    found = html_crf.blocks("<body class=a><div class='b a' id=c><ul><li>x<li><p>y</ul></div>z")
    assert [sorted(html_crf.path_features(n)) for n, *_ in found] == [
        sorted(["c:a", "c:b", "c:c", "t:div", "t:ul", "t:li", "in:li", "in2:ul>li"]),
        sorted(["c:a", "c:b", "c:c", "t:div", "t:ul", "t:li", "t:p", "in:p", "in2:li>p"]),
        sorted(["c:a", "in:body", "in2:body"]),
    ]
    field = html_crf.trained()
    page = html_crf.blocks(html_crf.labelled_pages(3, seed=9)[2][0])
    for (node, text, linked), got in zip(page, field.scores(page)):
        want = field._sum([*html_crf.path_features(node), *html_crf.text_features(text, linked)])
        assert abs(want[0] - got[0]) < 1e-9 and abs(want[1] - got[1]) < 1e-9


def test_deep_pages_take_linear_time():
    import time

    took = []
    for k in (10_000, 40_000):
        began = time.process_time()
        assert len(html_crf.blocks("<body>" + "<div class=x>some text </b></li>" * k)) == k
        html_crf.trained().scores(html_crf.blocks("<div>a" * k))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_page_awkward_rows(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<article><h1>T &amp; U</h1><p>One  two&nbsp;three is a sentence.<p>And another one, with words.</article><script>x</script>"), (2, "v", "<div><p>" * 500 + "x"), (3, "w", "<<<&&& <p <b>>"), (4, "z", "plain " * 30_000)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = html_crf.extract(df).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id == 1] == ["", ""]
    assert [r.text for r in got if r.page_id is None] == ["T & U\n\nOne two three is a sentence.\n\nAnd another one, with words."]
    assert html_crf.extract(df.limit(0)).count() == 0
