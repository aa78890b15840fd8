"""Packing, tokens and media against direct computation."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkstream.llm import media, packing, tokens
from inkstream.llm.shared import text_column

from .helpers import awkward, clashing, documents, prose


def reference():
    import public_tokenizers

    hf = pytest.importorskip("tokenizers")

    t = hf.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_tokens_equal_the_reference_tokenizer():
    rng = random.Random(2)
    alphabet = ["a", "B", "the", " ", "  ", "\n", "\t", ".", ",", "'s", "é", "漢", "🙂", " ", " ", "12", "-", "\r\n", "!?", "“", "\x1c", " ", "x.y", "don't"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)] + [r[1] or "" for r in awkward()]
    buf, off = text_column(pa.array(texts))
    got = []
    for lo, hi, ids, n in tokens.Encoder().rows(buf, off):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if hi > lo else []
    ref = reference()
    assert got == [ref.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_places_everything_once():
    rng = random.Random(3)
    for _ in range(40):
        h = Counter(rng.randint(1, 2048) if rng.random() < 0.7 else rng.randint(1, 60) for _ in range(rng.randint(1, 3000)))
        used = {}
        for length, lo, hi, seq, at in packing.plan(h):
            for k in range(hi - lo):
                used.setdefault(seq + k, []).append((at, length))
            h[length] -= hi - lo
        assert not any(h.values())
        for v in used.values():
            v.sort()
            assert [a for a, _ in v] == list(np.cumsum([0] + [n for _, n in v])[:-1]) and sum(n for _, n in v) <= 2048


def test_pack_documents(spark):
    rows = awkward()
    df = clashing(documents(spark, rows))
    got = packing.pack_documents(df).collect()
    ref, want = reference(), Counter()
    for r in rows:
        ids = ref.encode(r[1] or "", add_special_tokens=False).ids + [0]
        n = -(-len(ids) // 2048)
        cuts = [0] + [len(ids) - (n - 1) * 2048 + 2048 * k for k in range(n)]
        for k in range(n):
            want[r[0], k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(np.array(ids[cuts[k] : cuts[k + 1]], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert [a for a, _ in v] == list(np.cumsum([0] + [n for _, n in v])[:-1]) and sum(n for _, n in v) <= 2048
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_hot_length_gets_every_slot_once(spark):
    parts = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "if(id % 3 = 0, 700L, 5L + id % 40) AS length", "id AS ids_crc32")
    got = packing.pack(parts, bucket_rows=50).collect()
    assert len(got) == 5000 and len({(r.sequence_id, r.offset) for r in got}) == 5000


def pattern_bound(lengths, window=2048):
    """Sequences that no packing can do without: by total length, and by pieces of which no two, or no three, fit together."""
    total = -(-sum(lengths) // window)
    return max(total, sum(2 * n > window for n in lengths), -(-sum(3 * n > window for n in lengths) // 2))


@pytest.mark.parametrize("low,high,most", [(1, 2048, 1.01), (1, 300, 1.001), (400, 900, 1.08), (600, 1100, 1.12), (683, 1024, 1.001), (1025, 2048, 1.0)])
def test_sequences_come_near_the_least_number(low, high, most):
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(20_000)]
    used = max(first + hi - lo for _, lo, hi, first, _ in packing.plan(Counter(lengths)))
    assert used <= most * pattern_bound(lengths)


def test_png_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 575, 576, 577, 5000):
        p = media.pad(bytes(rng.randrange(128) for _ in range(n)))
        image = media.png(p)
        assert len(p) % 576 == 0 and len(p) > 0 and media.samples(image) == p
        with pytest.raises(ValueError):
            media.samples(image[:60] + bytes([image[60] ^ 1]) + image[61:])


def test_interleaving_keeps_positions_and_captions(spark):
    page = "<h1>T</h1><p>one <b>two</b></p><figure><img src='sha256:ab' alt='x'><figcaption>cap &amp; tion</figcaption></figure><p>three<img src='u' alt='alt'>four"
    items = media.parse(page)
    assert [(i["position"], i["kind"], i["text"], i["caption"]) for i in items] == [(0, "text", "T", None), (1, "text", "one two", None), (2, "media", None, "cap & tion"), (3, "text", "three", None), (4, "media", None, "alt"), (5, "text", "four", None)]
    assert items[2]["digest"] == "ab" and media.parse(None) == media.parse("") == []
    df = spark.createDataFrame([(1, page), (2, None), (None, "<p>x")], "page_id long, html string")
    assert {r.page_id: len(r["items"]) for r in media.interleave(df).collect()} == {1: 6, 2: 0, None: 1}


def test_media_of_documents(spark):
    df = clashing(documents(spark))
    got = media.resolve(media.interleave(media.figures(df), "doc_id"), "doc_id", media.store(df)).collect()
    want = Counter((r[0], len((r[1] or "").encode()), hashlib.sha256(media.pad((r[1] or "").encode())).hexdigest(), zlib.crc32(media.pad((r[1] or "").encode())[-32:])) for r in awkward())
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert media.resolve(media.interleave(media.figures(df.limit(0)), "doc_id"), "doc_id", media.store(df.limit(0))).count() == 0
    lost = media.resolve(media.interleave(media.figures(df), "doc_id"), "doc_id", media.store(df.limit(0)))
    assert lost.where("feature IS NULL").count() == df.count()


def test_stored_form_and_feature_equal_a_direct_computation(spark):
    """The stored bytes are a PNG whose samples, decoded by the format's rules, are the payload; the feature is the mean of 16 spans."""
    df = documents(spark)
    stored = {r.digest: bytes(r.media) for r in media.store(df).collect()}
    rows = {r.doc_id: r for r in media.resolve(media.interleave(media.figures(df), "doc_id"), "doc_id", media.store(df)).collect()}
    for doc_id, text, *_ in awkward():
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        image = stored[hashlib.sha256(payload).hexdigest()]
        assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10]) and image[12:16] == b"IHDR"
        wide, high, depth, colour, *_ = int.from_bytes(image[16:20]), int.from_bytes(image[20:24]), image[24], image[25]
        assert (wide, high, depth, colour) == (576, len(payload) // 576, 8, 0)
        size = int.from_bytes(image[33:37])
        lines = zlib.decompress(image[41 : 41 + size])
        assert b"".join(lines[k * 577 + 1 : (k + 1) * 577] for k in range(high)) == payload and set(lines[::577]) == {0}
        r = rows[doc_id]
        if doc_id is not None:
            assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
            cut = [len(payload) * k // 16 for k in range(17)]
            assert r.feature == bytes(sum(payload[a:b]) // (b - a) for a, b in zip(cut, cut[1:])).hex()


def test_sequences_of_documents_position_by_position(spark):
    rows = [(1, "first line\nsecond  & <line>\n\nthird", "en", "s", 1), (2, None, "en", "s", 1), (3, "only", "en", "s", 1), (4, "a\n\tb", "en", "s", 1)]
    got = {r.doc_id: [tuple(i) for i in r["items"]] for r in media.interleave(media.figures(documents(spark, rows)), "doc_id").collect()}
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        middle = (len(lines) + 1) // 2
        digest = hashlib.sha256(media.pad((text or "").encode())).hexdigest()
        want = [("text", " ".join(x.split()), None, None) for x in lines[:middle] if x.strip()] + [("media", None, digest, f"document {doc_id}")]
        want += [("text", " ".join(x.split()), None, None) for x in lines[middle:] if x.strip()]
        assert got[doc_id] == [(k, *x) for k, x in enumerate(want)]
    outlined = {r.doc_id: r for r in media.resolve(media.outlined(media.interleave(media.figures(documents(spark, rows)), "doc_id"), "doc_id"), "doc_id", media.store(documents(spark, rows)), keep=True).collect()}
    for doc_id, items in got.items():
        assert [(i.position, i.kind, i.n_chars) for i in outlined[doc_id]["items"]] == [(p, k, None if t is None else len(t)) for p, k, t, *_ in items]
        assert items[outlined[doc_id].position][1] == "media" and outlined[doc_id].feature is not None


def test_words_encoded_together_have_the_ids_of_each_alone():
    rng = random.Random(6)
    odd = ["it's", "don't", "'s", "--", "a,b", "x.", "été", "漢字", "\U0001f642", "12a3", " z", "q r", "_", "Å"]
    for kinds in (odd[:9], odd, ["".join(rng.choice("abc'.,1é") for _ in range(rng.randint(1, 9))) for _ in range(300)]):
        words = [" " + rng.choice(kinds) for _ in range(3000)]
        data = [w.encode() for w in words]
        size = np.array([len(x) for x in data])
        end = np.cumsum(size)
        enc = tokens.Encoder()
        ids, n = enc._encode(np.frombuffer(b"".join(data), np.uint8), end - size, end)
        want = [enc.bpe.encode_ordinary(w) for w in words]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
