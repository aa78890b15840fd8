"""Media columns: interleaved sequences of text and media references.

``interleave`` parses HTML into an ordered array of structs: text blocks, and
media references with their position, digest and caption (a figure's
figcaption, else the alt text). ``store`` keeps payloads losslessly as 8-bit
greyscale PNG images in a table of the shared folder, keyed by the payload's
SHA-256. ``resolve`` joins references to what is read back from the stored
bytes. Payloads never move in a shuffle: their features are computed where they
are stored, and only rows of a digest and its features are joined.

Defined results: null or empty HTML gives an empty sequence; a null text is the
empty payload; equal payloads share one digest, however often they are stored;
a reference whose digest isn't stored keeps null features; rows with null or
repeated ids stay rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as _html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import pieces, released, staged, text_column

WIDTH, _PIECE, _SEEN = 576, 1 << 20, 100_000
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
MAGIC = b"\x89PNG\r\n\x1a\n"
_BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "article", "section", "figure", "br", "ul", "ol", "table", "tr", "blockquote", "pre"}


#: Elements that can stand in a head and have content.
_IN_HEAD = {"noscript", "script", "style", "template", "title"}


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.head = False  # open until its end tag, or until what can't stand in it
        self.inside: str | None = None  # the element that is open in the head
        self.figure: list[int] = []  # for each open figure, where its items begin
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.head and self.inside in (None, "noscript"):
            if tag in _IN_HEAD:
                self.inside = tag
            elif tag not in ("base", "head", "link", "meta"):
                self.head, self.inside = False, None
        if tag == "head":
            self.head = True
        elif tag in ("script", "style"):
            self.skip += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("img", "video", "audio"):
            self.flush()
            src = a.get("src") or ""
            digest = src[7:] if src.startswith("sha256:") else hashlib.sha256(src.encode()).hexdigest()
            self.items.append({"position": len(self.items), "kind": "media", "text": None, "digest": digest, "caption": a.get("alt")})
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure.append(len(self.items))

    def handle_endtag(self, tag):
        if tag == "head":
            self.head, self.inside = False, None
        elif tag == self.inside:
            self.inside = None
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.items[self.figure[-1] if self.figure else len(self.items) :]:
                if item["kind"] == "media":
                    item["caption"] = words
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure" and self.figure:
                self.figure.pop()

    def handle_data(self, data):
        if self.head and self.inside is None and data.strip():
            self.head = False
        if self.caption is not None:
            self.caption.append(data)
        elif not self.skip and not self.head:
            self.text.append(data)


def parse(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.items


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, items): the page's sequence of text and media structs."""
    kind = pages.schema[key].dataType.simpleString()
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def run(batches):
        for b in batches:
            _, off = text_column(b.column(1))
            for lo, hi in pieces(off, _PIECE):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([parse(x) for x in part.column(1).to_pylist()], pa.list_(item))], names=[key, "items"])

    return pages.select(key, F.col(html).cast("string")).mapInArrow(released(run), f"`{key}` {kind}, items array<{ITEM}>")


def png(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG of rows of 576 samples."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of such a PNG; a damaged one raises ValueError."""
    if image[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that isn't written here")
    return rows[:, 1:].tobytes()


def pad(text: bytes) -> bytes:
    """UTF-8 never holds byte 255, so the padding can be told from the text."""
    return text + b"\xff" * (-len(text) % WIDTH or (0 if text else WIDTH))


def profile(payload: bytes) -> str:
    """Mean sample of each of 16 equal spans, as hex."""
    x = np.frombuffer(payload, np.uint8)
    edges = np.linspace(0, len(x), 17).astype(np.int64)
    sums = np.add.reduceat(x.astype(np.int64), edges[:-1])
    return (sums // np.diff(edges)).astype(np.uint8).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """(digest, media) of each text's payload, written to the shared folder and read back."""

    def run(batches):
        seen: set[bytes] = set()  # of this task's last rows; copies farther away are joined later
        for b in batches:
            buf, off = text_column(b.column(0))
            data, digests, media, size = buf.tobytes(), [], [], 0
            for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
                payload = pad(data[s:e])
                d = hashlib.sha256(payload)
                if d.digest() in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(d.digest())
                digests.append(d.hexdigest())
                media.append(png(payload))
                size += len(media[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(media, pa.binary())], names=["digest", "media"])
                    digests, media, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    return staged(docs.select(F.col("text").cast("string")).mapInArrow(released(run), "digest string, media binary"), "media")


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(stored: DataFrame) -> DataFrame:
    """One row for each digest, computed from the stored bytes."""

    def run(batches):
        for b in batches:
            rows = []
            for digest, image in zip(b.column(0).to_pylist(), b.column(1)):
                image = image.as_py()
                p = samples(image)
                rows.append((digest, len(p.rstrip(b"\xff")), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), profile(p)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return stored.mapInArrow(released(run), FEATURES).dropDuplicates(["digest"])


def resolve(sequences: DataFrame, key: str, stored: DataFrame, keep: bool = False) -> DataFrame:
    """(key, position, caption, digest and its features) of each media reference; with ``keep`` also the ``items`` of its sequence."""
    kept = ["items"] if keep else []
    refs = sequences.select(key, *kept, F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item"))
    refs = refs.select(key, *kept, F.col("item.position").alias("position"), F.col("item.caption").alias("caption"), F.col("item.digest").alias("digest"))
    # the features are staged so that both sides are plain shuffles and a digest with very many references can be split
    return refs.join(staged(features(stored), "media-features"), "digest", "left")


def figures(docs: DataFrame) -> DataFrame:
    """(doc_id, html): each document as a page of its lines, and after the first half of these a figure that refers to its payload's digest."""

    def run(batches):
        for b in batches:
            buf, off = text_column(b.column(1))
            for lo, hi in pieces(off, _PIECE):
                pages = []
                for i, s, e in zip(b.column(0).slice(lo, hi - lo).to_pylist(), off[lo:hi].tolist(), off[lo + 1 : hi + 1].tolist()):
                    text = buf[s:e].tobytes()
                    lines = [f"<p>{_html.escape(x, quote=False)}</p>" for x in text.decode().split("\n")]
                    lines.insert((len(lines) + 1) // 2, f'<figure><img src="sha256:{hashlib.sha256(pad(text)).hexdigest()}"><figcaption>document {i}</figcaption></figure>')
                    pages.append("".join(lines))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(pages, pa.string())], names=["doc_id", "html"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, html string")


def outlined(sequences: DataFrame, key: str) -> DataFrame:
    """The sequences with the number of characters of each text in place of the text: what a shuffle has to carry."""
    return sequences.select(key, F.transform("items", lambda x: F.struct(
        x["position"].alias("position"), x["kind"].alias("kind"), F.length(x["text"]).alias("n_chars"), x["digest"].alias("digest"), x["caption"].alias("caption")
    )).alias("items"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = resolve(outlined(interleave(figures(docs), "doc_id"), "doc_id"), "doc_id", store(docs), keep=True)
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption",
        F.transform("items", lambda x: F.struct(x["position"].alias("position"), x["kind"].alias("kind"), x["n_chars"].alias("n_chars"))).alias("sequence"),
    )
