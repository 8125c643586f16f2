"""Token ids of whole texts by a tokenizer file, each distinct piece of text encoded once.

The file's byte-level pre-tokenizer never joins what stands before white space with what follows it, as a token is white
space, or one space at most and then no white space; nor a letter with a mark or digit after it. So a text may be cut before
white space that follows a character that is none, between a letter and an ASCII character that is none, and between such a
cut's line break or tab and an ASCII letter; the ids of the pieces, one after another, are those of the text. Pieces of up to 16 bytes are kept in a table of fixed size and
compared as a whole, so a clash of slots costs time and no result.
"""

from __future__ import annotations

import itertools
import json
import re
from pathlib import Path

import numpy as np

from .seqhash import mix

U = np.uint64
SLOTS = 1 << 21
SHORT = 16
#: Ids that the table holds before it is emptied.
POOL = 1 << 23
#: Longer pieces kept by their bytes, and how many bytes such a piece may have.
KEPT, KEPT_BYTES = 1 << 16, 64

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Last bytes of characters that are no white space, whatever stands before them; and of those that may be.
SOLID = np.zeros(256, bool)
SOLID[33:127] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: Second bytes of the letters from U+00C0 to U+00FF; their first byte is C3.
ACCENT = np.zeros(256, bool)
ACCENT[0x80:0xC0] = True
ACCENT[[0x97, 0xB7]] = False
#: Pieces that are one word, and so one token of the pre-tokenizer.
WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
#: ASCII characters that are no letters.
OTHER = ~LETTER
OTHER[128:] = False
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], U)
#: The characters that stand for bytes in a byte-level vocabulary: a byte's own where it can be printed, else the next from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once in a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuttable(path: str) -> bool:
    """Whether the file's texts may be cut before white space: byte-level BPE with the usual pattern and nothing around it."""
    f = json.loads(Path(path).read_text())
    pre = f.get("pre_tokenizer") or {}
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = not any(f.get(k) for k in ("normalizer", "truncation", "padding")) and not f["model"].get("dropout")
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in f.get("added_tokens") or [])
    return bool(usual and plain and added)


def cuts(data: np.ndarray, offsets: np.ndarray, added: tuple[bytes, ...] = ()) -> np.ndarray:
    """Starts of the pieces of the texts in `data`; no piece starts inside one of the strings `added`, which are tokens as a whole."""
    start = np.zeros(len(data) + 1, bool)
    letter = LETTER[data]
    start[1:-1] = letter[:-1] & OTHER[data[1:]]
    accent = np.flatnonzero(ACCENT[data[1:]] & (data[:-1] == 0xC3)) + 2
    accent = accent[accent < len(data)]
    start[accent[OTHER[data[accent]]]] = True
    at = np.flatnonzero(BLANK[data])
    at = at[at > 0]
    before = data[at - 1]
    ok = SOLID[before]
    wide = np.flatnonzero(before >= 128)
    if len(wide):  # a character of several bytes; those that may be white space start with C2, E1, E2 or E3
        p = at[wide]
        two, three = data[np.maximum(p - 2, 0)], data[np.maximum(p - 3, 0)]
        ok[wide] = (two != 0xC2) & ~((three >= 0xE1) & (three <= 0xE3))
    start[at[ok]] = True
    breaks = at[ok & (data[at] != 32) & (at + 1 < len(data))]
    start[breaks[letter[breaks + 1]] + 1] = True
    raw = data.tobytes() if added else b""
    for token in added:
        k = raw.find(token)
        while k >= 0:
            start[k + 1 : k + len(token)] = False
            k = raw.find(token, k + 1)
    start[offsets[:-1]] = True
    start[-1] = False
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut, self.merge = cuttable(path), self.tokenizer.model.tokenize
        self.added = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.table = np.zeros((SLOTS, 3), U)  # the piece in two words; its bytes, ids and where these are: 8, 8 and 48 bits
        self.pool, self.filled = np.zeros(POOL, self.kind), 0
        self.long: dict[bytes, np.ndarray] = {}

    def _of(self, piece: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids, self.kind)

    def _of_long(self, piece: bytes) -> np.ndarray:
        ids = self.long.get(piece)
        if ids is None:
            ids = self._of(piece)
            if len(piece) <= KEPT_BYTES:
                if len(self.long) >= KEPT:
                    self.long.clear()
                self.long[piece] = ids
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts data[offsets[k]:offsets[k + 1]], one after another, and the bounds of each text among them."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        start = cuts(data, offsets, self.added) if self.cut else offsets[:-1][np.diff(offsets) > 0]
        length = np.diff(np.append(start, len(data)))
        short = length <= SHORT
        if short.all():
            first, count = self._short(data, start, length)
        else:
            first, count = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
            first[short], count[short] = self._short(data, start[short], length[short])
            view = memoryview(data)
            long = [self._of_long(bytes(view[s : s + n])) for s, n in zip(start[~short].tolist(), length[~short].tolist(), strict=True)]
            count[~short] = [len(x) for x in long]
            first[~short] = self._lend(np.concatenate(long)) + np.cumsum(count[~short]) - count[~short]
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.append(0, ends)[np.searchsorted(start, offsets)]

    def _lend(self, ids: np.ndarray) -> int:
        """Puts ids behind the pool's own until the next call, and says where."""
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.append(self.pool[: self.filled], np.zeros(len(ids) + POOL, self.kind))
        self.pool[self.filled : self.filled + len(ids)] = ids
        return self.filled

    def _short(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of pieces of up to SHORT bytes stand, and how many they are."""
        if self.filled + SHORT * len(start) > len(self.pool):
            self.table[:], self.filled = 0, 0
            if SHORT * len(start) > len(self.pool):
                self.pool = np.zeros(SHORT * len(start), self.kind)
        padded = np.append(data, np.zeros(SHORT, np.uint8))
        words = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
        size = length.astype(U)
        lo = words[start].view(U)[:, 0] & MASKS[np.minimum(length, 8)]
        hi = words[np.minimum(start + 8, len(data))].view(U)[:, 0] & MASKS[np.maximum(length - 8, 0)]
        slot = (mix(lo ^ mix(hi + size)) >> U(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        out = np.empty(len(start), U)
        todo = np.arange(len(start))
        while len(todo):
            row = self.table[slot[todo]]
            hit = (row[:, 0] == lo[todo]) & (row[:, 1] == hi[todo]) & ((row[:, 2] & U(255)) == size[todo])
            out[todo[hit]] = row[hit, 2]
            todo = todo[~hit]
            if len(todo):  # each slot gets one of the pieces that miss it
                self._learn(data, todo[np.unique(slot[todo], return_index=True)[1]], start, size, lo, hi, slot)
        return (out >> U(16)).astype(np.int64), (out >> U(8) & U(255)).astype(np.int64)

    def _learn(self, data, new, start, size, lo, hi, slot) -> None:
        pieces = [data[p : p + n].tobytes() for p, n in zip(start[new].tolist(), size[new].tolist(), strict=True)]
        found: list = [[t.id for t in self.merge(p.decode("latin-1").translate(BYTES))] if WORD(p) else None for p in pieces]
        rest = [k for k, ids in enumerate(found) if ids is None]
        if rest:
            more = self.tokenizer.encode([pieces[k].decode() for k in rest], is_pretokenized=True, add_special_tokens=False)
            ends = np.cumsum(np.bincount(np.array(more.word_ids, np.int64), minlength=len(rest))).tolist()
            ids = more.ids
            for k, a, b in zip(rest, [0, *ends], ends, strict=False):
                found[k] = ids[a:b]
        count = np.array([len(ids) for ids in found], U)
        flat = np.fromiter(itertools.chain.from_iterable(found), self.kind, int(count.sum()))
        at = U(self.filled) + np.cumsum(count) - count
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        self.table[slot[new]] = np.stack([lo[new], hi[new], size[new] | count << U(8) | at << U(16)], axis=1)
