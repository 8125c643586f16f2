"""Repeated windows of a corpus, found by winnowed anchors, contexts and extension.

Rows carry `at` = first window << 24 | check of the text (16 bits) << 8 | further windows. The check tells
texts apart that share a doc_id by mistake. No step needs more of a key than its distinct contexts in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seqhash
from .common import batch_of, buffers, longs, slices, stage

ANCHORS = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])
FOUND = pa.schema([("a", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("same", pa.bool_()), ("wide", pa.bool_())])
CHECK = "crc32(cast(coalesce(text, '') as binary)) & 65535 as check"


def symbols_of(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts and the bounds of each text among them."""
    if unit == "word":
        _, _, h, bounds = seqhash.words(data, offsets)
        return h, bounds
    return seqhash.BYTE_SYMBOLS[data[offsets[0] : offsets[-1]]], offsets - offsets[0]


def checks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    view = memoryview(data)
    return np.array([zlib.crc32(view[a:b]) & 0xFFFF for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)


#: Marks rows that their own task has settled already; such rows have a random `a`, so that they are dealt evenly.
SETTLED = -(1 << 63)
#: Anchors that a task sorts at once before it sends them.
COMBINE = 1 << 17
#: Distinct contexts of one anchor that a task holds; beyond that the anchor is wide and its windows are compared apart.
FEW = 1 << 14


def anchor_rows(docs: DataFrame, unit: str, width: int, gram: int, within: bool) -> DataFrame:
    """(a, c, doc_id, at) for every anchor of every text; null ids take no part.

    Of equal contexts in one task's rows only the first is sent under its key, the rest are known to be later ones.
    """

    def rows(batches):
        held, size = np.empty((4, COMBINE), np.int64), 0  # one block, so that small arrays do not pin freed memory
        for batch in batches:
            ids = longs(batch.column("doc_id"))
            offsets, data = buffers(batch.column("text"))
            for i, j in slices(offsets):
                part = offsets[i : j + 1]
                check = checks(data, part)
                symbols, bounds = symbols_of(data, part, unit)
                for text, first, more, a, c in seqhash.anchors(symbols, bounds, width, gram):
                    if size and size + len(a) > held.shape[1]:
                        yield combined(held[:, :size])
                        size = 0
                    if len(a) > held.shape[1]:
                        held = np.empty((4, len(a)), np.int64)
                    held[:, size : size + len(a)] = a.view(np.int64), c.view(np.int64), ids[i:j][text], first << 24 | check[text] << 8 | more
                    size += len(a)
        if size:
            yield combined(held[:, :size])

    def combined(parts):
        a, c, d, at = parts
        order = np.lexsort((at, d, c, a))
        a, c, d, at = a[order], c[order], d[order], at[order]
        later = _later(a, c, d, at, within)[0]
        a = np.where(later, seqhash.mix((d << 20 ^ at).view(np.uint64)).view(np.int64), a)
        return batch_of(ANCHORS, a, np.where(later, 0, c), d, np.where(later, at | SETTLED, at))

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(rows, "a long, c long, doc_id long, at long")


def _later(a, c, d, at, within):
    """Which sorted rows come after the first of equal (a, c), and where a new a and a new (a, c) start."""
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_c = new_a.copy()
    new_c[1:] |= c[1:] != c[:-1]
    first = np.maximum.accumulate(np.where(new_c, np.arange(len(a)), 0))
    later = d > d[first]
    if within:
        later |= (d == d[first]) & (at >> 24 > at[first] >> 24)
    return later, new_a, new_c


def compare(rows: DataFrame, within: bool, few: int = FEW) -> DataFrame:
    """Of rows with equal (a, c), those after the first are `same`; the first stays if `a` has another context too.

    within: whether a later row of the same text counts as after the first. Rows of an open `a` that are not settled
    are held, one for each distinct context; beyond `few` of them all rows of the `a` that are not `same` leave at once as `wide`.
    """

    def found(batches):
        held, sent = [np.zeros(0, np.int64)] * 4, False
        for batch in batches:
            columns = [longs(batch.column(k)) for k in ANCHORS.names]
            done = columns[3] < 0
            if done.any():
                n = int(done.sum())
                yield batch_of(FOUND, columns[0][done], columns[2][done], columns[3][done] & ~SETTLED, np.ones(n, bool), np.zeros(n, bool))
                columns = [x[~done] for x in columns]
            if len(columns[0]):
                out, held, sent = settle([np.concatenate([h, x]) for h, x in zip(held, columns, strict=True)], sent, True)
                yield out
        if len(held[0]):
            yield settle(held, sent, False)[0]

    def settle(columns, sent, open_end):
        """sent: the first row left before as `wide` and is only held to be compared with."""
        a, c, d, at = columns
        same, new_a, new_c = _later(a, c, d, at, within)
        group = np.cumsum(new_a) - 1
        several = (np.bincount(group, new_c) > 1)[group]
        tail = group == group[-1]
        keep = ~same & tail & open_end
        over = bool(open_end) and (int(keep.sum()) > few or sent and group[-1] == 0)
        wide = ((group == 0) & sent | tail & over) & ~same
        out = same | wide | several & ~(tail & open_end)
        if sent:
            out[0] = False
        if over:
            keep[:] = False
            keep[np.flatnonzero(new_c)[-1]] = True
        return batch_of(FOUND, a[out], d[out], at[out], same[out], wide[out]), [x[keep] for x in columns], over

    ordered = rows.repartition("a").sortWithinPartitions("a", "c", "doc_id", "at")
    return ordered.mapInArrow(found, "a long, doc_id long, at long, same boolean, wide boolean")


def by_text(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each text with what was found in it; as large as the text at most."""
    key = F.shiftright("at", 8).bitwiseAND(F.lit(0xFFFF)).alias("check")
    return rows.groupBy("doc_id", key).agg(*(F.collect_list(c).alias(f"{c}_list") for c in columns))


def extend(docs: DataFrame, kept: DataFrame, unit: str, width: int) -> DataFrame:
    """(a, c, doc_id, at) for each window of the contexts in `kept`: the anchor extended both ways to each window around it.

    Eight bits of the window's hash `c` are added to `a`, so that the windows of a common anchor are spread over many tasks.
    """

    def windows(batches):
        for batch in batches:
            ids = longs(batch.column("doc_id"))
            offsets, data = buffers(batch.column("text"))
            a_list, at_list = batch.column("a_list"), batch.column("at_list")
            bounds_a = a_list.offsets.to_numpy() - a_list.offsets[0].as_py()
            a_all, at_all = longs(a_list.flatten()), longs(at_list.flatten())
            for i, j in slices(offsets):
                symbols, bounds = symbols_of(data, offsets[i : j + 1], unit)
                out, size = [], 0
                for k in range(i, j):
                    own = slice(bounds_a[k], bounds_a[k + 1])
                    a, at = a_all[own], at_all[own]
                    order = np.argsort(at)
                    a, at = a[order], at[order]
                    first, more, origin = at >> 24, at & 0xFF, int(bounds[k - i])
                    cut = np.flatnonzero(np.append(True, first[1:] > first[:-1] + more[:-1] + 1))
                    for lo, hi in zip(cut, np.append(cut[1:], len(a)), strict=True):  # contexts that follow each other
                        n = more[lo:hi] + 1
                        base = int(first[lo])
                        hashes = seqhash.window_hashes(symbols, origin + base, int(first[hi - 1] + n[-1] - base), width).view(np.int64)
                        starts = np.repeat(first[lo:hi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        c = hashes[starts - base]
                        out.append((np.repeat(a[lo:hi], n) + (c & 0xFF), c, np.full(len(starts), ids[k]), starts << 24 | at[lo] & 0xFFFF00))
                        size += len(starts)
                        if size > 1 << 17:
                            yield batch_of(ANCHORS, *map(np.concatenate, zip(*out, strict=True)))
                            out, size = [], 0
                if out:
                    yield batch_of(ANCHORS, *map(np.concatenate, zip(*out, strict=True)))

    texts = docs.filter("doc_id is not null").selectExpr("doc_id", "coalesce(text, '') as text", CHECK)
    joined = texts.join(by_text(kept, "a", "at"), ["doc_id", "check"])
    return joined.select("doc_id", "text", "a_list", "at_list").mapInArrow(windows, "a long, c long, doc_id long, at long")


def contexts(docs: DataFrame, kept: DataFrame, width: int) -> DataFrame:
    """(a, doc_id, at, bytes): the bytes of each context in `kept`, from its first window to the end of its last."""
    schema = pa.schema([("a", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])

    def rows(batches):
        for batch in batches:
            ids = longs(batch.column("doc_id"))
            offsets, data = buffers(batch.column("text"))
            a_list, at_list = batch.column("a_list"), batch.column("at_list")
            bounds = a_list.offsets.to_numpy() - a_list.offsets[0].as_py()
            a, at = longs(a_list.flatten()), longs(at_list.flatten())
            view = memoryview(data)
            for i, j in slices(offsets, 1 << 20):
                own = slice(bounds[i], bounds[j])
                n = np.diff(bounds[i : j + 1])
                start = np.repeat(offsets[i:j], n) + (at[own] >> 24)
                end = start + (at[own] & 0xFF) + width
                yield batch_of(schema, a[own], np.repeat(ids[i:j], n), at[own], [bytes(view[s:e]) for s, e in zip(start, end, strict=True)])

    texts = docs.filter("doc_id is not null").selectExpr("doc_id", "coalesce(text, '') as text", CHECK)
    joined = texts.join(by_text(kept, "a", "at"), ["doc_id", "check"])
    return joined.select("doc_id", "text", "a_list", "at_list").mapInArrow(rows, "a long, doc_id long, at long, bytes binary")


def anchored(docs: DataFrame, unit: str, width: int, gram: int, within: bool, few: int = FEW) -> DataFrame:
    """Anchors of the corpus after `compare`, written: whole contexts that repeat, and those that must be extended."""
    return stage(compare(anchor_rows(docs, unit, width, gram, within), within, few), f"anchors-{unit}")


def repeated(docs: DataFrame, unit: str, width: int, gram: int, within: bool, few: int = FEW) -> DataFrame:
    """(doc_id, at) of runs of windows that repeat an earlier one, by seed and extend."""
    found = anchored(docs, unit, width, gram, within, few)
    more = compare(extend(docs, found.filter("not same"), unit, width), within)
    return found.filter("same").select("doc_id", "at").unionByName(more.filter("same").select("doc_id", "at"))


def with_repeats(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, text, at_list) for every row of `docs`."""
    texts = docs.selectExpr("doc_id", "coalesce(text, '') as text", CHECK)
    return texts.join(by_text(runs, "at"), ["doc_id", "check"], "left").select("doc_id", "text", "at_list")


def cover(at: np.ndarray, length: int, width: int) -> np.ndarray:
    """Which of `length` symbols the windows of the runs `at` cover."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, at >> 24, 1)
    np.add.at(edge, (at >> 24) + (at & 0xFF) + width, -1)
    return np.cumsum(edge[:-1]) > 0
