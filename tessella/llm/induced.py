"""Suffix sorting of a shard by induction: bucket queues on disk carry suffixes and common-prefix values.

A shard is a list of texts; every text ends in a separator that equals no other. The order of the suffixes at local
minima is found first: an induction sorts the pieces between minima, their names form a string of a third of the length,
and doubling orders its suffixes as deep as `width` needs. A second induction then carries the order, and the length of the
prefix that a suffix shares with the one before it (up to `width`), to all other suffixes: first the falling ones in ascending
order, then the rising ones in descending order. A queue for each first byte holds what is still to come; queues beyond
`memory` wait in a temporary file, which goes with the sort.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .seqhash import BYTE_SYMBOLS, Poly

_pieces = Poly(0x9E6C63D0676A9A99)
#: Suffixes worked on at once, so that temporary arrays stay small beside the shard.
BLOCK = 1 << 16


class Queues:
    """A queue of (suffixes, common prefixes) for each first byte; the largest ones are kept on disk."""

    def __init__(self, memory: int, kind: type):
        self.memory, self.kind, self.held, self.file = memory, kind, 0, None
        self.blocks: list[list] = [[] for _ in range(256)]

    def put(self, byte: int, at: np.ndarray, common: np.ndarray) -> None:
        self.held += at.nbytes + common.nbytes
        if self.held > self.memory:
            self.spill()
        self.blocks[byte].append((at, common))

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for byte in range(256):
            for k, block in enumerate(self.blocks[byte]):
                if isinstance(block[0], np.ndarray):
                    place = self.file.tell()
                    self.file.write(block[0].tobytes() + block[1].tobytes())
                    self.blocks[byte][k] = (place, len(block[0]))
        self.held = 0

    def take(self, byte: int):
        blocks, self.blocks[byte] = self.blocks[byte], []
        for at, common in blocks:
            if not isinstance(at, np.ndarray):
                self.file.seek(at)
                n = common
                size = np.dtype(self.kind).itemsize
                raw = self.file.read((size + 1) * n)
                at, common = np.frombuffer(raw, self.kind, n), np.frombuffer(raw, np.uint8, n, size * n)
            else:
                self.held -= at.nbytes + common.nbytes
            yield at, common

    def close(self) -> None:
        if self.file:
            self.file.close()


class _Lowest:
    """Least common-prefix value over ranges of one block."""

    def __init__(self, common: np.ndarray):
        self.levels = [common]
        while 2 << (len(self.levels) - 1) <= len(common):
            h = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-h], self.levels[-1][h:]))

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least value over [lo, hi), which holds one at least."""
        size = hi - lo
        level = np.frexp(size.astype(float))[1] - 1
        out = np.empty(len(lo), np.uint8)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.levels[k][lo[m]], self.levels[k][hi[m] - (1 << k)])
        return out


class Shard:
    def __init__(self, texts: list[bytes], width: int, memory: int = 16 << 20):
        self.width, self.memory = width, memory
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        # UTF-8 holds no byte over 0xF4, so one more still fits; 0 is the separator
        n = len(sizes) + int(sizes.sum())
        self.padded = np.zeros(n + 8, np.uint8)
        self.t = self.padded[:n]
        np.add(np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8), np.uint8(1), out=self.t)
        self.kind = kind = np.int32 if n < 1 << 31 else np.int64  # of places
        places = np.arange(n, dtype=kind)
        self.rest = np.minimum(np.repeat(self.ends.astype(kind), sizes + 1) - places, width).astype(np.uint8)  # up to the separator
        step = np.diff(self.t.astype(np.int16))
        # equal neighbours have the type of the next change
        turn = np.append(np.where(step != 0, places[:-1], kind(n - 1)), kind(n - 1))
        self.rising = np.append(step > 0, True)[np.minimum.accumulate(turn[::-1])[::-1]]
        self.minimum = self.rising.copy()
        self.minimum[0] = False
        self.minimum[1:] &= ~self.rising[:-1]

    def shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes p and q, up to width; separators are all different."""
        out = np.zeros(len(p), np.uint8)
        for k in range(0, len(p), BLOCK):
            out[k : k + BLOCK] = self._shared(p[k : k + BLOCK], q[k : k + BLOCK])
        return out

    def _shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        live = np.arange(len(p))
        word = np.lib.stride_tricks.as_strided(self.padded, (len(self.t), 8), (1, 1))
        for done in range(0, self.width, 8):
            a, b = p[live] + done, q[live] + done
            ok = np.maximum(a, b) < len(self.t)
            live, a, b = live[ok], a[ok], b[ok]
            x = word[a].view(np.uint64)[:, 0] ^ word[b].view(np.uint64)[:, 0]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            out[live] += same
            live = live[same == 8]
            if not len(live):
                break
        return np.minimum(np.minimum(out, self.width), np.minimum(self.rest[p], self.rest[q])).astype(np.uint8)

    def induce(self, minima: np.ndarray, common: np.ndarray | None):
        """From the minima in order (with what each shares with the one before), all suffixes but separators: yields
        (suffixes in ascending order, common prefixes) bucket by bucket from the highest first byte down."""
        carry = common is not None
        if not carry:
            common = np.zeros(len(minima), np.uint8)
        first = self.t[minima]
        bound = np.searchsorted(first, np.arange(257))
        falling, rising, kept = (Queues(self.memory, self.kind) for _ in range(3))
        low = np.full(256, self.width, np.uint8)
        try:
            for byte in range(256):
                last = None
                low[:] = 0 if byte else low
                todo = list(falling.take(byte))
                while todo:
                    for at, c in todo:
                        last = at[-1:]
                        kept.put(byte, at, c)
                        self._push(falling, at, c, low, False, carry)
                    todo = list(falling.take(byte))
                lo, hi = bound[byte], bound[byte + 1]
                if hi > lo:
                    c = common[lo:hi].copy()
                    c[0] = self.shared(last, minima[lo : lo + 1])[0] if carry and last is not None else 0
                    self._push(falling, minima[lo:hi], c, low, False, carry)
            low[:] = 0
            for byte in range(255, 0, -1):
                low[:] = 0
                down: list[tuple] = []
                todo = list(rising.take(byte))
                while todo:
                    for at, c in todo:
                        down.append((at, c))
                        self._push(rising, at, c, low, True, carry)
                    todo = list(rising.take(byte))
                up = list(kept.take(byte))
                edge = np.uint8(0)
                if up:
                    at, c = np.concatenate([x[0] for x in up]), np.concatenate([x[1] for x in up])
                    if down and carry:
                        edge = self.shared(down[-1][0][-1:], at[-1:])[0]
                    # descending: each now shares with the one above it what that one shared with it
                    self._push(rising, at[::-1], np.append(edge, c[1:][::-1]), low, True, carry)
                else:
                    at, c = np.zeros(0, self.kind), np.zeros(0, np.uint8)
                if down:
                    s, d = np.concatenate([x[0] for x in down])[::-1], np.concatenate([x[1] for x in down])
                    at, c = np.concatenate([at, s]), np.concatenate([c, [edge] if len(at) else [0], d[1:][::-1]]).astype(np.uint8)
                if len(at):
                    yield at, c
        finally:
            for q in (falling, rising, kept):
                q.close()

    def _push(self, queues: Queues, at: np.ndarray, common: np.ndarray, low: np.ndarray, rising: bool, carry: bool) -> None:
        """Queues the suffixes one byte longer than those of a block, and keeps in `low` what has been shared since each byte's last one."""
        for k in range(0, len(at), BLOCK):
            self._push_block(queues, at[k : k + BLOCK], common[k : k + BLOCK], low, rising, carry)

    def _push_block(self, queues: Queues, at: np.ndarray, common: np.ndarray, low: np.ndarray, rising: bool, carry: bool) -> None:
        before = np.maximum(at - 1, 0)
        use = np.flatnonzero((self.rising[before] == rising) & (at > 0))
        byte = self.t[before[use]]
        if rising:
            use, byte = use[byte > 0], byte[byte > 0]
        order = np.argsort(byte, kind="stable")
        use, byte = use[order], byte[order]
        cut = np.flatnonzero(np.append(True, np.diff(byte) != 0)) if len(byte) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(byte)) if len(byte) else cut
        if carry:
            lowest = _Lowest(common)
            c = np.zeros(len(use), np.uint8)
            if len(use):
                lo = np.empty(len(use), np.int64)
                lo[1:] = use[:-1] + 1
                lo[cut] = 0
                c = lowest.over(lo, use + 1)
                c[cut] = np.minimum(c[cut], low[byte[cut]])
                c = np.minimum(c + 1, self.width).astype(np.uint8)
            np.minimum(low, common.min(), out=low)
            if len(use):
                tail = use[ends - 1] + 1
                inside = tail < len(common)
                left = np.full(len(cut), self.width, np.uint8)
                if inside.any():
                    left[inside] = lowest.over(tail[inside], np.full(int(inside.sum()), len(common)))
                low[byte[cut]] = left
        else:
            c = np.zeros(len(use), np.uint8)
        for a, b in zip(cut, ends, strict=True):
            queues.put(int(byte[a]), before[use[a:b]], c[a:b])

    def minima(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes at local minima in order, and what each shares with the one before it."""
        places = np.flatnonzero(self.minimum).astype(self.kind)
        bare = places[np.argsort(self.t[places], kind="stable")]
        parts = [at[self.minimum[at]] for at, _ in self.induce(bare, None)][::-1]
        order = np.searchsorted(places, np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        end = np.append(places[1:], self.kind(len(self.t) - 1)) + 1
        code = np.zeros(len(places), np.uint64)
        for k in range(0, len(places), BLOCK):
            lo, hi = places[k : k + BLOCK], end[k : k + BLOCK]
            sums = _pieces.sums(BYTE_SYMBOLS[self.t[lo[0] : hi[-1]]])
            code[k : k + BLOCK] = _pieces.ranges(sums, lo - lo[0], hi - lo[0])
        size = end - places
        new = np.ones(len(order), bool)
        new[1:] = (code[order[1:]] != code[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
        rank = np.zeros(len(places), np.int64)
        rank[np.searchsorted(places, self.ends[self.minimum[self.ends]])] = np.flatnonzero(self.minimum[self.ends])
        rank[order] = np.cumsum(new) - 1 + len(self.ends)
        del code, size, end, order, new, parts, bare
        step = 1
        while step <= self.width:
            ahead = np.zeros(len(rank), np.int64)
            ahead[:-step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + ahead
            values, rank = np.unique(key, return_inverse=True)
            if len(values) == len(rank):
                break
            step *= 2
        out = places[np.argsort(rank, kind="stable")]
        common = np.zeros(len(out), np.uint8)
        common[1:] = self.shared(out[:-1], out[1:])
        return out, common

    def classes(self):
        """Yields (suffixes, class starts): suffixes whose first `width` bytes are equal stand together; single ones are left out."""
        for at, common in self.induce(*self.minima()):
            long = common >= self.width
            with_next = np.append(long[1:], False)
            many = long | with_next
            if many.any():
                yield at[many], np.flatnonzero(~long[many])


def repeats(texts: list[bytes], rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of each window of `width` bytes that also starts at an earlier place; rank gives the texts' order."""
    shard = Shard(texts, width)
    out_t, out_o = [], []
    for at, starts in shard.classes():
        text = np.searchsorted(shard.ends, at)
        offset = at - shard.starts[text]
        place = rank[text] << 32 | offset
        n = np.diff(np.append(starts, len(at)))
        late = place > np.repeat(np.minimum.reduceat(place, starts), n)
        out_t.append(text[late].astype(shard.kind))
        out_o.append(offset[late].astype(shard.kind))
    if not out_t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_t), np.concatenate(out_o)
