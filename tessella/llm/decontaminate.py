"""Operator 7, benchmark decontamination: greedy string tiling of documents against benchmark items."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seqhash
from .common import batch_of, buffers, documents, slices, stage, table

TILED = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tokens", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64())])
#: Token separators: white space and ASCII punctuation; letters are compared in lower case (A-Z).
BLANK = seqhash.SPACES.copy()
BLANK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rolling = seqhash.Poly(0xC2B2AE3D27D4EB4F)


def grams_of(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hash of the n tokens from each token on (those that leave their text have none: 0), and the texts' bounds."""
    _, _, tokens, bounds = seqhash.words(LOWER[data], offsets, BLANK)
    out = np.zeros(len(tokens), np.uint64)
    found = _rolling.grams(_rolling.sums(tokens), n)
    out[: len(found)] = found
    for b in bounds[1:]:
        out[max(0, b - n + 1) : b] = 0
    return out, bounds


class Seeds:
    """The n-token grams of some texts with the gram before and after each, by which shared runs start and end."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, none: int):
        """none: stands for the gram before a text's first one and after its last, and equals no gram."""
        self.at = np.flatnonzero(hashes)
        self.hash = hashes[self.at]
        padded = np.concatenate([np.zeros(1, np.uint64), hashes, np.zeros(1, np.uint64)])
        first = np.zeros(len(hashes) + 1, bool)
        first[bounds] = True
        before, after = padded[self.at], padded[self.at + 2]
        self.before = np.where(first[self.at] | (before == 0), np.uint64(none), before)
        self.after = np.where(after == 0, np.uint64(none), after)  # a text of n tokens or more ends in places without a gram
        self.after[np.isin(self.at + 1, bounds)] = none


class Items:
    """A bounded block of benchmark items, indexed by the hash of each `seed` tokens."""

    def __init__(self, ids: list[int], texts: list[str], seed: int):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        hashes, bounds = grams_of(np.frombuffer(b"".join(raw), np.uint8), offsets, seed)
        self.ids, self.seed, self.sizes = ids, seed, np.diff(bounds)
        found = Seeds(hashes, bounds, 1)
        self.item = np.searchsorted(bounds, found.at, side="right") - 1
        self.at = found.at - bounds[self.item]
        self.edges = [self._sorted(found.hash, x) for x in (found.before, found.after)]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(found.hash >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _sorted(hashes, other):
        """Order by (hash, neighbour), the hashes in that order, and where each (hash, neighbour) stands by a hash of both."""
        order = np.lexsort((other, hashes))
        h, o = hashes[order], other[order]
        cut = np.flatnonzero(np.append(True, (np.diff(h) != 0) | (np.diff(o) != 0))) if len(h) else np.zeros(0, np.int64)
        both = _both(h[cut], o[cut])
        by = np.argsort(both)
        return order, h, both[by], cut[by], np.append(cut[1:], len(h))[by]

    def edge(self, side: int, hashes: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the texts' grams, gram of the items) of equal grams whose neighbours on that side differ.

        Those with the same neighbour lie inside a longer run, so runs of repeated tokens are not paired place by place.
        """
        order, h, both, start, end = self.edges[side]
        lo, hi = np.searchsorted(h, hashes), np.searchsorted(h, hashes, side="right")
        key = _both(hashes, other)
        k = np.minimum(np.searchsorted(both, key), max(0, len(both) - 1))
        same = both[k] == key if len(both) else np.zeros(len(key), bool)
        a, b = (np.where(same, start[k], hi), np.where(same, end[k], hi)) if len(both) else (hi, hi)
        low, high = np.concatenate([lo, b]), np.concatenate([a, hi])  # before and after those with the same neighbour
        row = np.tile(np.arange(len(hashes)), 2)
        n = np.maximum(0, high - low)
        place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(row, n), order[place]

    def runs(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, start in the text, start in the item, length) of all maximal runs of `seed` shared tokens or more, by text and item."""
        maybe = self.bits[(hashes >> np.uint64(42)).astype(np.int64)] & (hashes != 0)
        found = Seeds(hashes, bounds, 2)
        use = maybe[found.at]
        at = found.at[use]
        text = np.searchsorted(bounds, at, side="right") - 1
        ends = []
        for side, other in ((0, found.before), (1, found.after)):
            row, k = self.edge(side, found.hash[use], other[use])
            t, item, x, y = text[row], self.item[k], at[row] - bounds[text[row]], self.at[k]
            order = np.lexsort((x, x - y, item, t))
            ends.append((t[order], item[order], x[order], y[order]))
        (t, item, x, y), (_, _, last, _) = ends  # on each diagonal starts and ends alternate
        return t, item, x, y, last - x + self.seed


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return seqhash.mix(a ^ seqhash.mix(b + np.uint64(0x9E3779B97F4A7C15)))


def tile(at_text: np.ndarray, at_item: np.ndarray, length: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in text, start in item, length), the longest match first, none overlapping another on either side.

    Given are the maximal matches; of equally long ones the first in the text, then in the item, is taken. What a tile leaves
    free of another match is a match again if it is long enough.
    """
    heap = [(-n, a, b) for n, a, b in zip(length.tolist(), at_text.tolist(), at_item.tolist(), strict=True)]
    heapq.heapify(heap)
    origin = int(at_text.min()) if len(at_text) else 0
    in_text = np.zeros(int((at_text + length).max()) - origin if len(at_text) else 0, bool)
    in_item = np.zeros(int((at_item + length).max()) if len(at_text) else 0, bool)
    tiles, left = [], len(in_item)
    while heap and left >= seed:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = in_text[a - origin : a - origin + n] | in_item[b : b + n]
        if not taken.any():
            in_text[a - origin : a - origin + n] = in_item[b : b + n] = True
            tiles.append((a, b, n))
            left -= n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # what is left of it, in runs
            if e - s >= seed:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return tiles


def _blocks(benchmark: DataFrame, seed: int, limit: int):
    """(block, number of blocks): the benchmark in blocks of about `limit` characters, each small enough to send to every task."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // limit) if total else 0
    for b in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        found = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield Items([x[0] for x in found], [x[1] for x in found], seed), n


def _tilings(data, offsets, items: Items, threshold: float):
    """(text, item, covered, tiles) for each text and item whose tiles cover `threshold` of the item's tokens."""
    hashes, bounds = grams_of(data, offsets, items.seed)
    text, item, x, y, length = items.runs(hashes, bounds)
    if not len(text):
        return
    cut = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(item) != 0)))
    enough = np.add.reduceat(length, cut) >= threshold * items.sizes[item[cut]]  # no tiling covers more than all matches
    for s, e in zip(cut[enough], np.append(cut[1:], len(text))[enough], strict=True):
        tiles = tile(x[s:e], y[s:e], length[s:e], items.seed)
        covered = sum(t[2] for t in tiles)
        if covered >= threshold * items.sizes[item[s]]:
            yield int(text[s]), int(item[s]), covered, len(tiles)


SCHEMA = "doc_id long, item_id long, n_tokens long, covered long, coverage double, n_tiles long"


def _contaminated(docs: DataFrame, items, threshold: float) -> DataFrame:
    """TILED rows for one broadcast block of items."""

    def rows(batches):
        known = items.value
        for batch in batches:
            ids = batch.column("doc_id")
            offsets, data = buffers(batch.column("text"))
            for i, j in slices(offsets):
                found = list(_tilings(data, offsets[i : j + 1], known, threshold))
                if found:
                    t, k, c, n = (np.array(v) for v in zip(*found, strict=True))
                    size = known.sizes[k]
                    yield batch_of(TILED, ids.take(pa.array(i + t)), pa.array([known.ids[x] for x in k], pa.int64()), size, c, c / size, n)

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.8, limit: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, n_tokens, covered, coverage, n_tiles) of documents whose tiles cover `threshold` of an item's tokens.

    Tokens are runs outside white space and ASCII punctuation, in lower case. Tiles are `seed` tokens or more, in any order;
    of equally long matches the first in the document, then in the item, is taken. Items of fewer tokens than a seed are
    never covered; null texts are empty; null ids are like any other; repeated rows give repeated results, repeated items one.
    The benchmark is sent to the tasks in blocks of at most about `limit` characters; of several blocks each reads all
    documents and writes what it finds before the next one is made, so the driver holds one at a time.
    """
    spark, out = docs.sparkSession, None
    for items, n in _blocks(benchmark, seed, limit):
        part = _contaminated(docs, spark.sparkContext.broadcast(items), threshold)
        if n > 1:
            part = stage(part, "tiled")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.8, limit: int = 8_000_000) -> DataFrame:
    """The rows of `docs` that cover no benchmark item, all columns, as `contaminated` finds them; no shuffle.

    Blocks of the benchmark follow each other as filters, each with its own broadcast.
    """
    for items, _ in _blocks(benchmark, seed, limit):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def rows(batches, sent=sent):
            for batch in batches:
                offsets, data = buffers(batch.column("text"))
                keep = np.ones(batch.num_rows, bool)
                for i, j in slices(offsets):
                    keep[[i + t for t, *_ in _tilings(data, offsets[i : j + 1], sent.value, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
