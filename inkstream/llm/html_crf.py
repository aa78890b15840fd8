"""Main-text extraction by a linear-chain conditional random field over a page's leaf blocks.

A page is parsed into leaf blocks: the text between two boundaries of block
elements, with the tags, classes and ids of its ancestors. Scripts, styles,
comments of the markup and the head are no blocks. Each block has features of
its ancestors (tags, and the words of their classes and ids), and of its text
(length, share of linked text, punctuation, tell-tale words). The field has two
states, text and not, with weights for features and for transitions; it is
trained here, by stochastic gradients of the log-likelihood with
forward-backward, on labelled pages, and decoded by Viterbi.

The labelled pages are made by ``labelled_pages``: random words set in many page
layouts whose parts are known (articles with and without elements of their own,
menus, headers, footers, sidebars, notices, adverts, forms, reader comments). Their
number is fixed; no row of the input is needed for training.

White space in a block becomes one space (a ``br`` is white space), blocks are
joined by two newlines, character references are decoded; nothing is cut off.

Defined results: null or empty html gives an empty text; a page without text
blocks too; markup that is broken or not closed is read as far as it goes; null
and repeated ids and urls stay as they are; an empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import released

# fixed values: elements that begin a new block, that have no end tag, and whose content isn't text
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe audio video".split())
CLOSES = {  # what an opening tag closes, if that is open and nothing of the second set is between
    "p": ({"p"}, {"button", "td", "th", "li", "div", "article", "section"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = BLOCKS - {"button", "label", "option", "select", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "p", "legend", "summary", "textarea", "dd", "dt"}
TELLING = frozenset("cookie cookies subscribe newsletter copyright advertisement sponsored reply comment comments login share menu search rights reserved privacy terms accept related".split())
_WORD = re.compile(r"[a-z]+")
PAGES = 600


#: Elements that can stand in a head; any other start tag closes a head whose end tag is left out, and so does text.
IN_HEAD = {"base", "head", "link", "meta", "noscript", "script", "style", "template", "title"}


class _Node:
    """An open element: its parent, the features that it adds to those of its ancestors, and its innermost block elements."""

    __slots__ = ("parent", "tag", "features", "fresh", "inner")

    def __init__(self, parent, tag, features, fresh):
        self.parent, self.tag, self.features, self.fresh = parent, tag, features, fresh
        above = parent.inner if parent else ()
        self.inner = (*above[-1:], tag) if tag in BLOCKS else above


@lru_cache(20_000)
def _element_features(tag: str, named: str) -> tuple[str, ...]:
    """Features of one element: its tag, and the words of its classes, id and role. Inline elements count too."""
    own = [] if tag in ("html", "body", "b", "i", "em", "strong", "span", "a") else [f"t:{tag}"]
    return tuple(dict.fromkeys(own + [f"c:{w}" for w in _WORD.findall(named.lower())]))


class _Blocks(HTMLParser):
    """Leaf blocks, with the node of the element that they stand in. Each tag costs what it is long, however deep it stands."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[_Node] = []
        self.blocks: list[tuple[_Node | None, str, float]] = []
        self.text: list[str] = []
        self.linked = self.links = self.silent = 0
        self.open: Counter[str] = Counter()  # tags on the path
        self.seen: Counter[str] = Counter()  # features on the path

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.path[-1] if self.path else None, text, min(1.0, self.linked / len(text))))
            self.text, self.linked = [], 0

    def _push(self, tag: str, named: str = "") -> None:
        features = _element_features(tag, named)
        self.path.append(_Node(self.path[-1] if self.path else None, tag, features, tuple(f for f in features if not self.seen[f])))
        self.open[tag] += 1
        self.seen.update(features)

    def _leave(self, node: _Node) -> None:
        self.open[node.tag] -= 1
        for f in node.features:
            self.seen[f] -= 1
        if node.tag in SILENT:
            self.silent -= 1
        elif node.tag == "a":
            self.links -= 1

    def _drop(self, i: int) -> None:
        for node in self.path[i:]:
            self._leave(node)
        del self.path[i:]

    def _close_head(self) -> None:
        for i in (-1, -2):
            if len(self.path) >= -i and self.path[i].tag == "head":
                self._drop(len(self.path) + i)
                return
            if self.path and self.path[-1].tag != "noscript":
                return

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._close_head()
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag in ("br", "wbr"):
                self.text.append(" ")
            return
        if tag in SILENT:
            self.silent += 1
            self._push(tag)
            return
        if tag in BLOCKS:
            self.flush()
            shut, stop = CLOSES.get(tag, (None, None))
            if tag in _ENDS_P:
                shut, stop = {"p"}, {"button", "td", "th", "li", "div", "article", "section"}
            if shut and any(self.open[t] for t in shut):
                for i in range(len(self.path) - 1, -1, -1):
                    if self.path[i].tag in shut:
                        self._drop(i)
                        break
                    if self.path[i].tag in stop:
                        break
        if tag == "a":
            self.links += 1
        self._push(tag, " ".join(v for k, v in attrs if v and k in ("class", "id", "role")) if attrs else "")

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        if not self.open[tag]:
            return
        crossed = False
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i].tag == tag:
                if crossed and tag not in BLOCKS and tag not in SILENT:  # an inline element's end leaves the blocks within it open
                    self._leave(self.path[i])
                    del self.path[i]
                else:
                    self._drop(i)
                return
            crossed = crossed or self.path[i].tag in BLOCKS

    def handle_data(self, data):
        if self.silent and self.path[-1].tag == "head" and data.strip():
            self._close_head()
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def handle_startendtag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._close_head()
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCKS:
            self.flush()


def blocks(html: str | None) -> list[tuple[_Node | None, str, float]]:
    """(element that it stands in, text, share of linked text) of each leaf block, in page order."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.blocks


def inner_features(node: _Node | None) -> tuple[str, str]:
    inner = node.inner if node else ()
    return f"in:{inner[-1] if inner else '-'}", f"in2:{'>'.join(inner)}"


def path_features(node: _Node | None) -> list[str]:
    """Features of a block's ancestors, each once."""
    out = list(inner_features(node))
    while node:
        out += node.fresh
        node = node.parent
    return out


def text_features(text: str, linked: float) -> list[str]:
    """Features of a block's text. Few values each, so that their sums can be kept."""
    n = len(text)
    words = text.count(" ") + 1
    out = [f"n:{min(n, 2000).bit_length()}", f"w:{min(words, 300).bit_length()}", f"l:{int(linked * 4)}", f"end:{text[-1] in '.!?…'}", f"dot:{min(text.count('. '), 3)}"]
    if "©" in text:
        out.append("copyright")
    if words <= 12:
        out += [f"k:{w}" for w in set(_WORD.findall(text.lower())) & TELLING]
    return out


@dataclass
class Field:
    weights: dict[str, np.ndarray]  # feature -> weight of each state
    moves: np.ndarray  # from, to
    first: np.ndarray

    def _sum(self, names) -> tuple[float, float]:
        a = b = 0.0
        for x in names:
            w = self.weights.get(x)
            if w is not None:
                a, b = a + w[0], b + w[1]
        return a, b

    def scores(self, page) -> list[tuple[float, float]]:
        """Each block's score of both states. Sums of ancestors' weights are kept, so that each element is added once."""
        out, sums = [], {None: (0.0, 0.0)}
        for node, text, linked in page:
            up, at = [], node
            while at not in sums:
                up.append(at)
                at = at.parent
            a, b = sums[at]
            for at in reversed(up):
                x, y = self._sum(at.fresh)
                a, b = a + x, b + y
                sums[at] = (a, b)
            x, y = self._sum((*inner_features(node), *text_features(text, linked)))
            out.append((a + x, b + y))
        return out

    def decode(self, page) -> list[int]:
        """The likeliest states, by Viterbi."""
        s = self.scores(page)
        if not s:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = s[0][0] + float(self.first[0]), s[0][1] + float(self.first[1])
        back = []
        for x, y in s[1:]:
            from_a, from_b = a + m00 >= b + m10, a + m01 >= b + m11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = x + (a + m00 if from_a else b + m10), y + (a + m01 if from_b else b + m11)
        states = [0 if a >= b else 1]
        for step in reversed(back):
            states.append(step[states[-1]])
        return states[::-1]


def train(pages: list[tuple[list, list[int]]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Field:
    """Maximum likelihood by Adagrad; ``pages`` are (blocks, states)."""
    index: dict[str, int] = {}
    data = []
    for page, states in pages:
        rows = [[index.setdefault(x, len(index)) for x in path_features(p) + text_features(t, k)] for p, t, k in page]
        if rows:
            data.append((np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array(states)))
    w, gw = np.zeros((len(index), 2)), np.full((len(index), 2), 1e-6)
    m, gm, f, gf = np.zeros((2, 2)), np.full((2, 2), 1e-6), np.zeros(2), np.full(2, 1e-6)
    order = list(range(len(data)))
    rng = random.Random(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        for d in order:
            feats, row, y = data[d]
            n = len(y)
            s = np.stack([np.bincount(row, weights=w[feats, k], minlength=n) for k in (0, 1)], 1)
            alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
            alpha[0] = s[0] + f
            for i in range(1, n):
                alpha[i] = s[i] + np.logaddexp(alpha[i - 1, 0] + m[0], alpha[i - 1, 1] + m[1])
            for i in range(n - 2, -1, -1):
                nxt = s[i + 1] + beta[i + 1]
                beta[i] = np.logaddexp(m[:, 0] + nxt[0], m[:, 1] + nxt[1])
            z = np.logaddexp(*alpha[-1])
            p = np.exp(alpha + beta - z)
            d_state = -p
            d_state[np.arange(n), y] += 1
            g = d_state[row]
            step = np.zeros_like(w[feats])
            np.add.at(gw, feats, g**2)
            step = rate * g / np.sqrt(gw[feats]) - decay * w[feats]
            np.add.at(w, feats, step)
            df = d_state[0]
            gf += df**2
            f += rate * df / np.sqrt(gf)
            if n > 1:
                pair = np.exp(alpha[:-1, :, None] + m[None] + (s[1:] + beta[1:])[:, None, :] - z)
                dm = -pair.sum(0)
                np.add.at(dm, (y[:-1], y[1:]), 1)
                gm += dm**2
                m += rate * dm / np.sqrt(gm)
    return Field({x: w[i] for x, i in index.items()}, m, f)


#: Class names that tell nothing about what an element holds.
NEUTRAL = "wrapper container inner outer page site row col grid box block section-1 layout wrap body-wrap view panel region x12 el-3 css-1q2w3e js-root".split()


def labelled_pages(n: int = PAGES, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages in random layouts, and for each of their blocks whether it is main text.

    The article stands in an element that is named for it, in one that isn't (a section, a
    div without a name or with one that tells nothing), or straight in the body; parts and
    the whole page may be wrapped in elements that tell nothing."""
    rng = random.Random(seed)
    syllables = "tion ing er the an re on at en nd st es ou la de le que eau der sch ung lich los as mente ción ado".split()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def line(lo, hi, stop=False):
        words = [word() for _ in range(rng.randint(lo, hi))]
        for i in range(len(words)):
            if rng.random() < 0.08:
                words[i] += rng.choice([",", ".", ".", ";"])
        return " ".join(words).capitalize() + (rng.choice([".", ".", ".", "!", "?", ""]) if stop else "")

    def tag(name, names=(), always=False):
        if names and (always or rng.random() < 0.9):
            return f'<{name} {rng.choice(["class", "class", "id"])}="{rng.choice(names)}">'
        return f"<{name}>"

    def neutral():
        return tag(rng.choice(["div", "div", "div", "section"]), NEUTRAL + [word()])

    out = []
    for _ in range(n):
        html, states = [], []

        def put(text, main):
            html.append(text)
            states.append(int(main))

        @contextmanager
        def within(opening):
            """What is put meanwhile stands in this element; none if it is empty."""
            html.append(opening)
            yield
            html.append(f"</{_WORD.match(opening, 1)[0]}>" if opening else "")

        def element(name, text, main):
            put(f"<{name}>{text}</{name}>", main)

        def menu():
            with within(rng.choice(["<nav>", tag("div", ["menu", "navbar", "nav main-nav", "navigation", "breadcrumbs"], True), '<div role="navigation">'])), within(rng.choice(["<ul>", "<ul>", "<ol>", ""])):
                for _ in range(rng.randint(2, 8)):
                    element(rng.choice(["li", "li", "li", "div"]), f'<a href="/{word()}">{line(1, 3)}</a>' if rng.random() < 0.9 else line(1, 3), False)

        def header():
            with within(rng.choice(["<header>", tag("div", ["header", "site-header", "masthead", "banner", "topbar"], True)])):
                element(rng.choice(["h1", "div", "p"]), line(1, 5), False)
                if rng.random() < 0.5:
                    element("p", line(3, 10, True), False)

        def footer():
            with within(rng.choice(["<footer>", tag("div", ["footer", "site-footer", "bottom", "colophon"], True)])):
                for _ in range(rng.randint(1, 3)):
                    element(rng.choice(["p", "div", "div"]), f"{rng.choice(['&copy; ', '', '&copy; 2024 '])}{line(2, 14, rng.random() < 0.5)}", False)
                if rng.random() < 0.5:
                    put(f"&copy; {word()}.example.com &middot; {line(4, 12, True)}", False)

        def side():
            with within(rng.choice(["<aside>", tag("div", ["sidebar", "side", "widget", "related", "related-posts", "rail", "recommended"], True)])):
                if rng.random() < 0.7:
                    element("h3", line(1, 3), False)
                for _ in range(rng.randint(1, 4)):
                    if rng.random() < 0.5:
                        element("p", line(4, 40, True), False)
                    else:
                        element("div", f'<a href="#">{line(2, 7)}</a>', False)

        def advert():
            with within(tag("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot banner-ad"], True)):
                put(rng.choice([line(2, 25, True), f"<p>{line(5, 30, True)}</p>", f'<a href="#">{line(2, 8)}</a>']), False)

        def notice():
            with within(tag("div", ["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "newsletter", "popup modal"], True)):
                element("p", f"{rng.choice(['We use cookies. ', '', 'Subscribe to our newsletter. '])}{line(4, 30, True)}", False)
                if rng.random() < 0.6:
                    element("button", rng.choice(["Accept", "OK", line(1, 2)]), False)

        def form():
            with within(tag("form", ["search", "login", "subscribe", "signup", "contact"])):
                for _ in range(rng.randint(1, 3)):
                    put(f"<label>{line(1, 4)}</label><input>", False)
                element("button", line(1, 2), False)
                if rng.random() < 0.3:
                    element("p", line(5, 20, True), False)

        def comments():
            with within(tag(rng.choice(["section", "div", "ul"]), ["comments", "discussion", "responses", "comment-list", "comment-thread", "reader-comments", "replies", "disqus"], True)):
                if rng.random() < 0.7:
                    element(rng.choice(["h2", "h3", "h4"]), rng.choice(["Comments", line(1, 3)]), False)
                for _ in range(rng.randint(1, 5)):
                    with within(tag(rng.choice(["div", "li", "article"]), ["comment", "comment-body", "reply", "response"])):
                        if rng.random() < 0.6:
                            element(rng.choice(["div", "p", "h4"]), line(1, 3), False)
                        for _ in range(rng.randint(1, 2)):
                            element("p", line(4, 70, True), False)

        def body():
            if rng.random() < 0.75:
                element("h1", line(2, 12, rng.random() < 0.5), True)
            if rng.random() < 0.05:
                put(line(1, 60, rng.random() < 0.7), True)
                return
            for _ in range(rng.randint(1, 9)):
                r = rng.random()
                if r < 0.62:
                    element("p", line(1, 90, True), True)
                elif r < 0.72:
                    put(f"<p><b>{line(3, 80, True)}<br>", True)
                elif r < 0.78:
                    element("h2", line(1, 6), True)
                elif r < 0.83:
                    element("p", f'{line(3, 30)} <a href="#">{line(1, 4)}</a> {line(3, 30, True)}', True)
                elif r < 0.88:
                    with within("<ul>"):
                        for _ in range(rng.randint(1, 4)):
                            element("li", line(2, 20, True), True)
                elif r < 0.91:
                    with within("<blockquote>"):
                        element("p", line(4, 40, True), True)
                elif r < 0.93:
                    element("pre", line(3, 20), True)
                elif r < 0.95:
                    with within("<table>"), within("<tr>"):
                        for _ in range(3):
                            element("td", line(1, 3), True)
                elif r < 0.965:
                    element(rng.choice(["div", "section"]), line(5, 60, True), True)
                elif r < 0.985:
                    advert()
                else:
                    form()

        def article():
            kind = rng.random()
            if kind < 0.35:
                opening = tag("article", ["post", "entry", "story"]) if rng.random() < 0.5 else "<article>"
            elif kind < 0.45:
                opening = rng.choice(["<main>", '<div role="main">'])
            elif kind < 0.65:
                opening = tag("div", ["content", "main-content", "article", "article-body", "post", "entry-content", "story-body", "text"], True)
            elif kind < 0.85:
                opening = neutral()
            else:
                opening = ""
            with within(opening), within(neutral() if rng.random() < 0.2 else ""):
                body()

        before = [f for f, p in ((notice, 0.3), (header, 0.5), (menu, 0.75), (advert, 0.5), (form, 0.2), (side, 0.25)) if rng.random() < p]
        after = [f for f, p in ((comments, 0.4), (side, 0.4), (advert, 0.2), (form, 0.2), (notice, 0.15), (menu, 0.1), (footer, 0.75)) if rng.random() < p]
        if rng.random() < 0.2:  # nothing before the article, or after it, or neither
            before, after = rng.choice([([], after), (before, []), ([], []), ([], [])])
        html.append(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{line(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script>{rng.choice(["</head>", "</head>", ""])}<body>')
        with within(neutral() if rng.random() < 0.3 else ""), within(neutral() if rng.random() < 0.2 else ""):
            for f in (*before, article, *after):
                with within(neutral() if rng.random() < 0.15 else ""):
                    f()
        html.append("</body></html>")
        out.append(("".join(html), states))
    return out


_TRAINED: dict[tuple[int, int], Field] = {}


def trained(n: int = PAGES, seed: int = 5) -> Field:
    """The field for the labelled pages; trained once in a process."""
    if (n, seed) not in _TRAINED:
        data = [(blocks(h), s) for h, s in labelled_pages(n, seed)]
        _TRAINED[n, seed] = train([(b, s) for b, s in data if len(b) == len(s)])
    return _TRAINED[n, seed]


def main_text(html: str | None, field: Field) -> str:
    page = blocks(html)
    return "\n\n".join(text for (_, text, _), s in zip(page, field.decode(page)) if s)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    sent = pages.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(h.as_py(), sent.value) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(released(run), "page_id long, url string, text string, n_chars long")


def op8(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: In the driver's pages the main text is what stands in the article element, of headings and paragraphs.
ORACLE = r"""
WITH parts AS (SELECT page_id, url, regexp_extract_all(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1), '<(?:p|h1)>(?:[^<]|</?b>|<br>)*') AS found FROM pages),
plain AS (
  SELECT page_id, url, list_transform(found, lambda x: replace(replace(trim(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '&quot;', '"'), '&amp;', '&')) AS blocks
  FROM parts)
SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text, length(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)))::BIGINT AS n_chars FROM plain
"""
