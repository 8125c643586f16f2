"""Rolling hashes over bytes or words, and winnowed anchors that own every window of a text once.

A window is `width` consecutive symbols of one text. Among its grams (`gram` symbols) the one with
the smallest hash, the leftmost of equals, is its anchor. Equal windows have equal anchors at equal
offsets, so to compare the windows of a corpus it is enough to compare those with equal anchors.
Consecutive windows with one anchor form its context; equal contexts hold equal windows.
All arithmetic is modulo 2**64 on randomised symbols; keys that must not collide join two such hashes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Symbols worked on at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 18
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Poly:
    """Hash of any range of a sequence from prefix sums of symbol * base**index."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.pw, self.ipw = np.ones(1, U), np.ones(1, U)

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols) + 1
        while len(self.pw) < n:
            m = len(self.pw)
            self.pw = np.concatenate([self.pw, self.pw * U(pow(self.base, m, 1 << 64))])
            self.ipw = np.concatenate([self.ipw, self.ipw * U(pow(self.inverse, m, 1 << 64))])
        out = np.zeros(n, U)
        np.cumsum(symbols * self.pw[: n - 1], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.ipw[start])

    def grams(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hash of each `width` consecutive symbols."""
        n = len(sums) - width
        return mix((sums[width:] - sums[:-width]) * self.ipw[:n]) if n > 0 else np.zeros(0, U)


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_bytes, _grams, _context = Poly(0x5851F42D4C957F2D), Poly(0xA0761D6478BD642F), Poly(0xE7037ED1A0B428DB)


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, hash) of every word of the texts (runs outside `blank`), and the number of words before each text."""
    out_s, out_e, out_h = [], [], []
    base, end = int(offsets[0]), int(offsets[-1])
    edge = np.zeros(end - base + 1, bool)
    edge[offsets - base] = True
    at = base
    while at < end:
        to = min(end, at + PIECE)
        while to < end and not edge[to - base] and not blank[data[to]]:  # never through a word
            nxt = np.flatnonzero(blank[data[to : min(to + PIECE, end)]] | edge[to - base : min(to + PIECE, end) - base])
            to = to + int(nxt[0]) if len(nxt) else min(end, to + PIECE)
        part = data[at:to]
        ink = ~blank[part]
        cut = edge[at - base : to - base]
        before = np.empty(len(part), bool)
        before[0], before[1:] = False, ink[:-1]
        s = np.flatnonzero(ink & (~before | cut))
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = True, ~ink[1:] | cut[1:]
        e = np.flatnonzero(ink & after) + 1
        sums = _bytes.sums(BYTE_SYMBOLS[part])
        out_h.append(_bytes.ranges(sums, s, e))
        out_s.append(s + at)
        out_e.append(e + at)
        at = to
    s, e, h = (np.concatenate(x) if x else np.zeros(0, np.int64 if k < 2 else U) for k, x in enumerate((out_s, out_e, out_h)))
    return s, e, h, np.searchsorted(s, offsets)


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    n, size = len(x) - w + 1, 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x[:n] if size == w else np.minimum(x[:n], x[w - size : w - size + n])


def anchors(symbols: np.ndarray, bounds: np.ndarray, width: int, gram: int):
    """Anchors of all windows of the texts symbols[bounds[k]:bounds[k+1]].

    Yields arrays (text, first window, further windows, gram hash, context hash); positions count from the text's start.
    """
    lengths = np.diff(bounds)
    todo = np.flatnonzero(lengths >= width)
    pieces, size = [], 0
    for k in todo:
        at, end = int(bounds[k]), int(bounds[k + 1])
        while end - at >= width:
            n = min(PIECE, end - at)
            pieces.append((k, at, n))
            size += n
            if size >= PIECE:
                yield _anchors(symbols, bounds, pieces, width, gram)
                pieces, size = [], 0
            at += n - width + 1
    if pieces:
        yield _anchors(symbols, bounds, pieces, width, gram)


def _anchors(symbols, bounds, pieces, width, gram):
    text = np.array([p[0] for p in pieces])
    at = np.array([p[1] for p in pieces])
    n = np.array([p[2] for p in pieces])
    if len(pieces) > 1 and np.all(at[1:] == at[:-1] + n[:-1]) or len(pieces) == 1:
        joined = symbols[at[0] : at[-1] + n[-1]]
    else:
        joined = np.concatenate([symbols[a : a + m] for a, m in zip(at, n, strict=True)])
    ends = np.cumsum(n)
    starts = ends - n
    hashes = _grams.grams(_grams.sums(joined), gram)
    key = (hashes & ~U((1 << 20) - 1)) | np.arange(len(hashes), dtype=U)
    best = (_slide_min(key, width - gram + 1) & U((1 << 20) - 1)).astype(np.int64)
    owned = np.ones(len(best), bool)
    for e in ends[:-1]:
        owned[max(0, e - width + 1) : e] = False
    first = owned.copy()
    first[1:] &= ~owned[:-1] | (best[1:] != best[:-1])
    last = owned.copy()
    last[:-1] &= ~owned[1:] | (best[1:] != best[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    piece = np.searchsorted(ends, lo, side="right")
    sums = _context.sums(joined)
    context = _context.ranges(sums, lo, hi + width) + (hi - lo).astype(U)
    origin = at[piece] - bounds[text[piece]] - starts[piece]
    return text[piece], lo + origin, hi - lo, hashes[best[lo]], context


def window_hashes(symbols: np.ndarray, start: int, count: int, width: int) -> np.ndarray:
    """Hashes of `count` consecutive windows from `start` on."""
    part = symbols[start : start + count + width - 1]
    return _context.grams(_context.sums(part), width)
