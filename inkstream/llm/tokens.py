"""Byte-level BPE of many rows at once.

A pre-token never spans the place before a space that is followed by something
other than white space, nor that between an ASCII letter and a comma or full
stop, so a row may be cut there and its parts encoded alone.
Each distinct part is encoded once and kept; rows then are gathered from the
parts' ids. Rows with white space outside ASCII, where that cut could differ,
are encoded whole. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64

import numpy as np

from .shared import pieces
from .textscan import _SPACE, hash_ranges

KEPT = 1_000_000  # distinct parts kept in a worker; beyond it the store starts anew
_BATCH = 1 << 20
_JOINED = 1024  # ranges that are encoded together


def load(path: str | None = None):
    """The encoder of the public 50k byte-level vocabulary (its rank file gives the same ids as its JSON file)."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_LEAD = np.zeros(256, bool)
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _odd_space(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold white space outside 0x20 and 0x09-0x0D."""
    at = np.flatnonzero(_LEAD[buf])
    end = len(buf) - 1
    a, b, c = buf[at], buf[np.minimum(at + 1, end)], buf[np.minimum(at + 2, end)]
    hit = a < 0x20
    hit |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    hit |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    hit |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) & (c >= 0x80) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    hit |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.unique(np.searchsorted(offsets, at[hit], "right") - 1)


class Encoder:
    def __init__(self, path: str | None = None):
        self.bpe = load(path)
        self.spaced = None  # ids that begin with a space
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, buf, start, end, hashes, first) -> None:
        if len(self.known) + len(first) > KEPT:
            self._clear()
        flat, sizes = self._encode(buf, start[first], end[first])
        at = len(self.pool) + np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        fresh = hashes[first]  # ascending, as all distinct hashes are
        place = np.searchsorted(self.known, fresh)
        self.at = np.insert(self.at, place, at)
        self.size = np.insert(self.size, place, sizes)
        self.known = np.insert(self.known, place, fresh)
        self.pool = np.concatenate((self.pool, flat))

    def _encode(self, buf, start, end) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each range, end to end, and how many each has. Ranges that are a space and a word without white
        space are encoded together: their ids are those of each alone, and an id that begins with a space begins a range."""
        data = buf.tobytes()
        spans = list(zip(start.tolist(), end.tolist()))
        if self.spaced is None:
            self.spaced = np.zeros(self.bpe.n_vocab, bool)
            self.spaced[[i for token, i in self.bpe._mergeable_ranks.items() if token[:1] == b" "]] = True
        flat, sizes = [], []
        for lo in range(0, len(spans), _JOINED):
            part = spans[lo : lo + _JOINED]
            joined = b"".join([data[s:e] for s, e in part])
            ids = size = None
            if joined.count(b" ") == len(part) and all(data[s] == 0x20 and e - s > 1 for s, e in part):
                x = np.frombuffer(joined, np.uint8)
                odd = _SPACE.copy()
                odd[0x20] = False
                if not odd[x].any() and not len(_odd_space(x, np.array([0, len(x)]))):
                    ids = np.array(self.bpe.encode_ordinary(joined.decode("utf-8", "replace")), np.uint32)
                    at = np.flatnonzero(self.spaced[ids])
                    size = np.diff(np.append(at, len(ids))) if len(at) == len(part) else None
            if size is None:
                each = [self.bpe.encode_ordinary(data[s:e].decode("utf-8", "replace")) for s, e in part]
                size = np.fromiter(map(len, each), np.int64, len(each))
                ids = np.fromiter((i for x in each for i in x), np.uint32, int(size.sum()))
            flat.append(ids)
            sizes.append(size)
        return (np.concatenate(flat), np.concatenate(sizes).astype(np.int64)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def parts(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each byte range (disjoint, ascending)."""
        h = hash_ranges(buf, start, end)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = at >= len(self.known)
        new[~new] = self.known[at[~new]] != distinct[~new]
        if new.any():
            cleared = len(self.known) + int(new.sum()) > KEPT
            self._learn(buf, start, end, h, first if cleared else first[new])
            at = np.searchsorted(self.known, distinct)
        return self.at[at][back], self.size[at][back]

    def rows(self, buf: np.ndarray, offsets: np.ndarray):
        """Yields (lo, hi, ids, counts): the ids of rows lo to hi, end to end, and how many each has."""
        for lo, hi in pieces(offsets, _BATCH):
            o = offsets[lo : hi + 1] - offsets[lo]
            b = buf[offsets[lo] : offsets[hi]]
            if not len(b):
                yield lo, hi, np.zeros(0, np.uint32), np.zeros(hi - lo, np.int64)
                continue
            cut = b == 0x20
            cut[:-1] &= ~_SPACE[b[1:]]
            cut[-1] = False
            stop = (b == 0x2C) | (b == 0x2E)
            cut[1:] |= stop[1:] & _LETTER[b[:-1]]
            row_end = o[1:][o[1:] > o[:-1]] - 1
            cut[row_end[b[row_end] == 0x20]] = False  # a space that ends its row isn't cut off
            cut[o[:-1][o[:-1] < len(b)]] = True
            whole = _odd_space(b, o)
            for r in whole.tolist():
                cut[o[r] + 1 : o[r + 1]] = False
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(b))
            at, size = self.parts(b, start, end)
            shift = np.concatenate(([0], np.cumsum(size)[:-1]))
            ids = self.pool[np.repeat(at - shift, size) + np.arange(int(size.sum()))]
            row = np.searchsorted(o, start, "right") - 1
            yield lo, hi, ids, np.bincount(row, weights=size, minlength=hi - lo).astype(np.int64)


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder; its store lasts as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
