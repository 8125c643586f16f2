"""Operator 8, lexical retrieval packing: a sharded BM25 inverted index fills each window with a seed's unused neighbours."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, buffers, crc32_ids, documents, slices, stage
from .encoding import default_tokenizer, encoder
from .seqhash import mix

TOKENS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
COUNTS = pa.schema([("term", pa.int64()), ("df", pa.int64())])
PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
RESTS = pa.schema([*((c, pa.int64()) for c in ("r0", "r1", "r2", "turn", "doc_id", "start", "total")), ("ids", pa.binary())])
LONGS = ", ".join(f"{c} long" for c in PIECES.names)
END = 1
#: Orders of all terms whose first one in a document places it.
ORDERS = 3
#: Sequences of the map side are numbered from here on, so that they meet none of the packers'.
WHOLE = 1 << 62


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """Rows of kind 0, a document with its ids (and the end id); and of kind 1, one for each task, with the number of its
    documents that hold each id. Ids are written in the narrowest type that holds the vocabulary."""

    def rows(batches):
        of = encoder(path)
        df, n_docs, total = np.zeros(max(of.tokenizer.get_vocab_size(), END + 1), np.int64), 0, 0
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            for i, j in slices(offsets):
                ids, bounds = of.encode(data, offsets[i : j + 1])
                n = np.diff(bounds)
                text = np.repeat(np.arange(j - i), n)
                df += np.bincount(np.unique(text << 32 | ids) & 0xFFFFFFFF, minlength=len(df))
                df[END] += j - i - len(np.unique(text[ids == END]))  # held by all, through the end
                n_docs, total = n_docs + j - i, total + len(ids) + j - i
                end = np.array([END], of.kind).tobytes()
                yield batch_of(TOKENS, np.zeros(j - i, np.int32), batch.column("doc_id")[i:j], n + 1, [ids[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        held = np.flatnonzero(df)
        if n_docs:
            yield batch_of(TOKENS, [1], [n_docs], [total], [np.stack([held, df[held]]).astype(np.int64).tobytes()])

    return docs.select("doc_id", "text").mapInArrow(rows, "kind int, doc_id long, n long, ids binary")


def document_counts(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Documents that hold each id (as long as the vocabulary), documents, and their mean length, over all documents."""
    counts = tokens.filter("kind = 1")

    def rows(batches):
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                term, df = np.frombuffer(raw, np.int64).reshape(2, -1)
                yield batch_of(COUNTS, term, df)

    totals = counts.agg(F.sum("doc_id"), F.sum("n")).first()
    found = counts.select("ids").mapInArrow(rows, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(max((r.term for r in found), default=0) + 1, np.int64)
    for r in found:
        df[r.term] = r.df
    return df, totals[0] or 0, (totals[1] or 0) / max(1, totals[0] or 0)


def orders(idf: np.ndarray) -> np.ndarray:
    """For each of ORDERS independent orders the place of each term, rare terms likely first.

    Two documents have the same first term in one of them with the chance of their Jaccard similarity, terms weighed by idf squared.
    """
    n = len(idf)
    out = np.empty((ORDERS, n), np.int64)
    for k in range(ORDERS):
        u = (mix(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)) >> np.uint64(11)).astype(float) / 2.0**53
        late = -np.log1p(-u) / np.maximum(idf, 1e-9) ** 2
        out[k, np.argsort(late, kind="stable")] = np.arange(n)
    return out


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a binary column, one after another, and their bounds."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data.view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def whole_windows(tokens: DataFrame, window: int, kind: type) -> DataFrame:
    """Pieces of a whole window each, from the start of every document that is long enough; they need no neighbour."""

    def rows(batches):
        number = WHOLE | TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                ids = np.frombuffer(raw, kind)
                start = np.arange(0, n // window * window, window)
                crc = [crc32_ids(ids[s : s + window]) for s in start]
                m = len(start)
                yield batch_of(PIECES, pa.array([doc_id] * m, pa.int64()), start, np.full(m, window), crc, np.full(m, n), number + np.arange(m), np.zeros(m, np.int64))
                number += m

    return tokens.filter((F.col("kind") == 0) & (F.col("n") >= window)).select("doc_id", "n", "ids").mapInArrow(rows, LONGS)


def rests(tokens: DataFrame, window: int, kind: type, idf: np.ndarray) -> DataFrame:
    """What whole windows leave of each document (less than a window), with its places in the orders of terms."""

    def rows(batches):
        place = orders(idf)
        turn = 0
        for batch in batches:
            ids, bounds = _flat(batch.column("ids"), kind)
            total = np.diff(bounds)
            start = total // window * window
            use = np.flatnonzero(start < total)
            if not len(use):
                continue
            first = np.repeat(bounds[:-1][use] + start[use], 2)
            first[1::2] = bounds[1:][use]
            first = first if first[-1] < len(ids) else first[:-1]
            r = [np.minimum.reduceat(p[ids], first)[::2] for p in place]
            raw = [ids[a:b].tobytes() for a, b in zip(bounds[:-1][use] + start[use], bounds[1:][use], strict=True)]
            turns = mix(np.arange(turn, turn + len(use), dtype=np.uint64) + np.uint64(1)).view(np.int64)
            turn += len(use)
            yield batch_of(RESTS, *r, turns, batch.column("doc_id").take(pa.array(use)), start[use], total[use], raw)

    return tokens.filter("kind = 0").select("doc_id", "ids").mapInArrow(rows, "r0 long, r1 long, r2 long, turn long, doc_id long, start long, total long, ids binary")


class Index:
    """Inverted index of a shard: for each id its postings, documents and their BM25 weights; of ids that stand in one document
    of eight or more, a row of weights over all documents instead, which takes no more room and is added at once."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, idf: np.ndarray, mean: float, k1: float, b: float):
        n = np.diff(bounds)
        self.docs = len(n)
        owner = np.repeat(np.arange(self.docs), n)
        pair = np.sort(ids.astype(np.int64) << 24 | owner)
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        tf = np.diff(np.append(first, len(pair)))
        term, owner = pair[first] >> 24, pair[first] & 0xFFFFFF
        weight = idf[np.minimum(term, len(idf) - 1)] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[owner] / max(1.0, mean)))
        df = np.bincount(term)
        common = np.flatnonzero(df * 8 >= self.docs)
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.docs))
        often = self.row[term] >= 0
        self.dense[self.row[term[often]], owner[often]] = weight[often]
        self.owner, self.weight = owner[~often].astype(np.int32), weight[~often]
        self.start = np.searchsorted(term[~often], np.arange(len(df) + 1))

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every document of the shard that `keep` has not dropped, for the distinct `terms`."""
        terms = terms[terms < len(self.row)]
        row = self.row[terms]
        terms, row = terms[row < 0], row[row >= 0]
        lo, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out = np.bincount(self.owner[place], self.weight[place], self.docs).astype(float)  # integers if none
        for k in range(0, len(row), 16):
            out += self.dense[row[k : k + 16]].sum(axis=0)
        return out

    def keep(self, alive: np.ndarray) -> None:
        """Drops the postings of documents that are used up."""
        of = alive[self.owner]
        self.start = np.append(0, np.cumsum(of))[self.start]
        self.owner, self.weight = self.owner[of], self.weight[of]


class Packer:
    """Fills windows from shards of documents' rests, one shard after another; what a shard leaves open, the next one fills."""

    def __init__(self, idf: np.ndarray, mean: float, window: int, partition: int, k1: float = 1.2, b: float = 0.75):
        self.idf, self.mean, self.window, self.k1, self.b = idf, mean, window, k1, b
        self.next = partition << 40
        self.open: list[tuple] = []  # pieces of the open window: doc_id, its ids, start, ids before them, all ids
        self.room, self.seed = window, np.zeros(0, np.int64)
        self.out: list[tuple] = []

    def _close(self, pieces):
        offset = 0
        for doc_id, ids, start, total in pieces:
            self.out.append((doc_id, start, len(ids), crc32_ids(ids), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def shard(self, doc_id: list, ids: np.ndarray, bounds: np.ndarray, start: np.ndarray, total: np.ndarray) -> None:
        """Packs the rests ids[bounds[k]:bounds[k + 1]], none of them as long as a window."""
        index = Index(ids, bounds, self.idf, self.mean, self.k1, self.b)
        at, left = bounds[:-1].copy(), np.diff(bounds)
        begin = start - at  # ids of the document before ids[0]
        used, held = 0, np.zeros(int(ids.max()) + 1, bool)

        def put(k, n):
            a = int(at[k])
            self.open.append((doc_id[k], ids[a : a + n], int(begin[k]) + a, int(total[k])))
            at[k] += n
            left[k] -= n
            self.room -= n
            if not self.room:
                self._close(self.open)
                self.open, self.room = [], self.window

        while True:
            if not self.open:
                k = int(left.argmax())
                if not left[k]:
                    return
                held[:] = False
                held[ids[at[k] : at[k] + left[k]]] = True
                self.seed = np.flatnonzero(held)
                put(k, int(left[k]))
                used += 1
            alive = np.flatnonzero(left)
            if not len(alive):
                return
            if used > len(alive):
                index.keep(left > 0)
                used = 0
            near = alive[np.argsort(-index.scores(self.seed)[alive], kind="stable")]
            size, k = left[near], 0
            while self.open:
                fits = size[k:] <= self.room
                hop = int(fits.argmax())
                if not fits[hop]:
                    break
                k += hop
                put(near[k], int(size[k]))
                used += 1
                k += 1
                if k == len(near):
                    break
            if self.open:  # the best one left is cut
                near = near[left[near] > 0]
                if not len(near):
                    return
                put(near[0], self.room)

    def finish(self):
        """The last open window, cut into sequences whose lengths are powers of two, so that none needs padding."""
        pieces, self.open, self.room = self.open, [], self.window
        total = sum(len(p[1]) for p in pieces)
        while total:
            want, group = 1 << (total.bit_length() - 1), []
            total -= want
            while want:
                doc_id, ids, start, size = pieces.pop(0)
                take = min(len(ids), want)
                group.append((doc_id, ids[:take], start, size))
                want -= take
                if take < len(ids):
                    pieces.insert(0, (doc_id, ids[take:], start + take, size))
            self._close(group)


def pack(docs: DataFrame, path: str | None = None, window: int = 2048, shard: int = 2048) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): pieces that hold each id of each row once.

    A row's ids are those of its text (null: empty) and the end id. Whole windows of a document stand alone; its rest, which
    is shorter than a window, is packed with others. Rests are sorted by their first term in three orders of all terms, in
    which rare ones come early, so that lexical neighbours meet, and cut into shards of `shard`, each with its BM25 index;
    document counts come from the whole corpus. A window's seed is the longest unused rest; unused ones join it in
    the order of their BM25 score for the whole seed (ties: in shard order) while they fit, then the best one left is cut. Only a
    partition's last window stays open; it is cut at powers of two. Repeated rows are packed each, null ids too.
    """
    path = path or default_tokenizer()
    kind = encoder(path).kind
    tokens = stage(tokenized(docs, path), "tokens")
    df, n, mean = document_counts(tokens)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float64)

    def rows(batches):
        packer, held, count = Packer(idf, mean, window, TaskContext.get().partitionId()), [], 0

        def fill():
            t = pa.Table.from_batches(held).combine_chunks()
            ids, bounds = _flat(t.column("ids").combine_chunks() if t.num_rows else t.column("ids").chunk(0), kind)
            packer.shard(t.column("doc_id").to_pylist(), ids, bounds, *(t.column(c).to_numpy() for c in ("start", "total")))

        def made():
            out, packer.out = packer.out, []
            return batch_of(PIECES, *zip(*out, strict=True))

        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, shard - count))
                count += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if count == shard:
                    fill()
                    held, count = [], 0
                    if packer.out:
                        yield made()
        if held:
            fill()
        packer.finish()
        if packer.out:
            yield made()

    keys = ["r0", "r1", "r2", "turn"]
    ordered = rests(tokens, window, kind, idf).repartitionByRange(*keys).sortWithinPartitions(*keys)
    packed = ordered.select("doc_id", "start", "total", "ids").mapInArrow(rows, LONGS)
    return whole_windows(tokens, window, kind).unionByName(packed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
