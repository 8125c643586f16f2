"""Operator 4, SimHash near-duplicates: fingerprints, deletion-variant index and components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, buffers, documents, groups, longs, slices, stage, unstage
from .components import components
from .seqhash import Poly, mix
from .seqhash import words as words_of

EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
#: Runs of the index beyond this are dealt out again.
LARGE = 2048


def shingle_hashes(w: list[bytes], words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, of the whole sequence if it is shorter; none of no words."""
    h = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([h(b" ".join(w), 42)] if w else [], np.uint64)
    return np.array([h(b" ".join(s), 42) for s in zip(*(w[k:] for k in range(words)), strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes; unsigned, zero of none."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of the text's word shingles in lower case (A-Z); zero for a blank text."""
    return majority(shingle_hashes((text or "").encode().lower().split(), words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long. A null or blank text has 0."""

    def rows(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield batch_of(PRINTS, batch.column("doc_id"), prints.view(np.int64))

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, fp long")


def _search(prints: np.ndarray, bits: int, at: np.ndarray) -> list[tuple[int, int]]:
    out, rest = [], at
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(prints[rest] ^ prints[x]) <= bits
            if near.any():
                hits = rest[near]
                out += [(int(x), int(y)) for y in hits]
                todo += list(hits)
                rest = rest[~near]
    return out


def _small_runs(fp: np.ndarray, starts: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within runs of one small size that differ by `bits` or fewer bits."""
    x, y = np.triu_indices(size, 1)
    a, b = (starts[:, None] + x).ravel(), (starts[:, None] + y).ravel()
    near = np.bitwise_count(fp[a] ^ fp[b]) <= bits
    return a[near], b[near]


def _pairs_of_runs(fp: np.ndarray, rep: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of pairs that connect whatever pairs at `bits` differing bits or fewer connect in each run."""
    sizes = np.diff(np.append(starts, len(fp)))
    u, v = [], []
    for m in range(2, 9):
        x, y = _small_runs(fp, starts[sizes == m], m, bits)
        u.append(rep[x])
        v.append(rep[y])
    for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
        if pairs := _search(fp, bits, np.arange(s, s + n)):
            x, y = np.array(pairs).T
            u.append(rep[x])
            v.append(rep[y])
    return np.concatenate(u), np.concatenate(v)


FOUND = pa.schema([("wide", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])


def _runs(batches, large: int):
    """From batches sorted by key: (key, fp, rep, starts) of whole runs of up to `large` entries, and, with starts None, the
    entries of longer runs as they come, so that none is held."""
    held, wide = [np.zeros(0, np.int64)] * 3, None
    for batch in batches:
        columns = [longs(batch.column(c)) for c in ("key", "fp", "rep")]
        if wide is not None:
            n = int(np.searchsorted(columns[0], wide, side="right"))
            if n:
                yield *(c[:n] for c in columns), None
            columns = [c[n:] for c in columns]
        if not len(columns[0]):
            continue
        wide = None
        columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        starts = np.flatnonzero(np.append(True, np.diff(columns[0]) != 0))
        last = starts[-1]
        sizes = np.diff(np.append(starts, len(columns[0])))
        long = np.repeat(sizes > large, sizes)
        if long.any():
            yield *(c[long] for c in columns), None
        if sizes[-1] > large:
            wide, last = columns[0][-1], len(columns[0])
        done = ~long
        done[last:] = False
        if done.any():
            own = columns[0][done]
            yield *(c[done] for c in columns), np.flatnonzero(np.append(True, np.diff(own) != 0))
        held = [c[last:] for c in columns]
    if len(held[0]):
        yield *held, np.zeros(1, np.int64)


def links(prints: DataFrame, bits: int = 3, columns: tuple[str, ...] = ("fp",), large: int = LARGE) -> DataFrame:
    """(u, v) of documents whose fingerprints connect: every two fingerprints at `bits` bits or fewer are in one component.

    prints: rep (a document) and one fingerprint or more, one row for each combination; any of them may link. A fingerprint is
    cut into (bits + 1) / 2 segments, rounded up, so that one of them differs by one bit at most. It is indexed by each segment
    whole and with each of its bits left out. Entries that are equal are verified, and of each run of equal entries only what
    connects it is returned, so that the rows stay below the entries. A run of over `large` entries is dealt out again by the
    bits + 1 parts of the whole fingerprint, of which any linked pair has one in common, so that no task gets all of it.
    """
    parts = bits // 2 + 1
    bounds = [64 * k // parts for k in range(parts + 1)]
    entries = []
    for n, column in enumerate(columns):
        for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            full = (1 << (hi - lo)) - 1
            value = F.shiftrightunsigned(column, lo).bitwiseAND(F.lit(full))
            for free in range(-1, hi - lo):
                kind = (n * parts + k) * 65 + free + 1
                key = value.bitwiseAND(F.lit(full & ~(1 << free) if free >= 0 else full)).bitwiseOR(F.lit(kind << 32))
                entries.append(F.struct(key.alias("key"), F.col(column).alias("fp")))

    def verify(batches):
        for key, fp, rep, starts in _runs(batches, large):
            if starts is None:
                yield batch_of(FOUND, np.ones(len(key), bool), key, fp, rep)
                continue
            u, v = _pairs_of_runs(fp.view(np.uint64), rep, starts, bits)
            yield batch_of(FOUND, np.zeros(len(u), bool), np.maximum(u, v), np.minimum(u, v), np.zeros(len(u), np.int64))

    def verify_parts(batches):
        for batch, starts in groups(batches, ["key", "part", "value"]):
            u, v = _pairs_of_runs(longs(batch.column("fp")).view(np.uint64), longs(batch.column("rep")), starts, bits)
            yield batch_of(EDGES, np.maximum(u, v), np.minimum(u, v))

    index = prints.select("rep", F.explode(F.array(*entries)).alias("e")).select("e.key", "e.fp", "rep")
    found = stage(index.repartition("key").sortWithinPartitions("key", "fp", "rep").mapInArrow(verify, "wide boolean, a long, b long, c long"), "links")
    cuts = [64 * k // (bits + 1) for k in range(bits + 2)]
    part = [F.struct(F.lit(k).cast("long").alias("part"), F.shiftrightunsigned("b", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value")) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    again = found.filter("wide").select(F.col("a").alias("key"), F.explode(F.array(*part)).alias("p"), F.col("b").alias("fp"), F.col("c").alias("rep")).select("key", "p.part", "p.value", "fp", "rep")
    more = again.repartition("key", "part", "value").sortWithinPartitions("key", "part", "value", "fp").mapInArrow(verify_parts, "u long, v long")
    return found.filter("not wide").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(more).filter("u <> v").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Fingerprints at `bits` differing bits or fewer are linked, equal ones too; component_id is the smallest doc_id reachable.
    Blank texts have fingerprint zero and link like any other. A row with a null doc_id gets the component of its
    fingerprint, null if no other document has it.
    """
    prints = stage(fingerprints(docs, words), "prints")
    one = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "reps")
    roots = components(links(one, bits))
    of = one.join(roots, one["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(of, "fp", "left").select("doc_id", digits.alias("fingerprint"), "component_id")


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rolling, _whole = Poly(0xC2B2AE3D27D4EB4F), (Poly(0x9FB21C651E98DF25), Poly(0xD6E8FEB86659FD93))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each run of `words` words (A-Z in lower case) of the texts, of the whole sequence where it is shorter; their
    bounds; and two hashes of each text's whole sequence. Hashes are of 64 bits, all of a slice of texts at once."""
    _, _, tokens, at = words_of(LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0])
    sums = _rolling.sums(tokens)
    n = np.diff(at)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    bounds = np.append(0, np.cumsum(count))
    start = np.repeat(at[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    end = np.minimum(start + words, np.repeat(at[1:], count))
    whole = np.stack([p.ranges(p.sums(tokens), at[:-1], at[1:]) + n.astype(np.uint64) for p in _whole], axis=1)
    return _rolling.ranges(sums, start, end), bounds, whole


def _majorities(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """`majority` of each text's hashes."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    use = np.flatnonzero(np.diff(bounds))
    for k in range(0, len(use), 256):
        own = use[k : k + 256]
        lo, hi = bounds[own[0]], bounds[own[-1] + 1]
        if hi - lo > 1 << 18:  # a long text alone, in blocks
            out[own] = [majority(hashes[bounds[t] : bounds[t + 1]]) for t in own]
            continue
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, bounds[own] - lo, axis=0, dtype=np.int32)
        out[own] = np.packbits(counts * 2 > np.diff(bounds)[own][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _multiprints(docs: DataFrame, words: int, count: int) -> DataFrame:
    """(doc_id, t1, t2, f0, ...) with a 128-bit key of the text's words and `count` independent fingerprints."""
    schema = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), *((f"f{k}", pa.int64()) for k in range(count))])

    def rows(batches):
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            for i, j in slices(offsets):
                hashes, bounds, whole = shingles(data, offsets[i : j + 1], words)
                prints = [_majorities(mix(hashes * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)), bounds) for k in range(count)]
                yield batch_of(schema, batch.column("doc_id")[i:j], *whole.view(np.int64).T, *(p.view(np.int64) for p in prints))

    return docs.select("doc_id", "text").mapInArrow(rows, ", ".join(f"{c} long" for c in schema.names))


def _each(batches, words: int):
    """(record batch, row, its distinct shingle hashes in order) of every text."""
    for batch in batches:
        offsets, data = buffers(batch.column("text"))
        for i, j in slices(offsets):
            hashes, bounds, _ = shingles(data, offsets[i : j + 1], words)
            for k in range(i, j):
                yield batch, k, np.unique(hashes[bounds[k - i] : bounds[k - i + 1]])


SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("value", pa.binary())])
#: Rows of one Arrow batch that this module makes of sets, bitmaps and prefixes at most.
HELD = 1 << 18


def _of_sets(docs: DataFrame, words: int, made) -> DataFrame:
    """(doc_id, n, value): `made` of each text's n distinct shingle hashes."""

    def rows(batches):
        out, held = [], 0
        for batch, k, own in _each(batches, words):
            out.append((batch.column("doc_id")[k].as_py(), len(own), made(own)))
            held += len(out[-1][2])
            if held > HELD << 3:
                yield batch_of(SETS, *zip(*out, strict=True))
                out, held = [], 0
        if out:
            yield batch_of(SETS, *zip(*out, strict=True))

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n long, value binary")


#: Bits of the least and of the largest bitmap.
LEAST_BITS, MOST_BITS = 512, 1 << 14


def bitmap(own: np.ndarray, most: int = MOST_BITS) -> bytes:
    """Parities of a set's hashes in about 4 bits for each. Two bitmaps differ in no more bits than the sets have different hashes."""
    size = min(most, max(LEAST_BITS, 1 << (4 * len(own)).bit_length()))
    return np.packbits(np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def difference(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps, the larger one folded to the size of the smaller."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def resemblance(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of shingle hashes; 1 of two empty ones."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / (len(x) + len(y) - shared) if len(x) + len(y) else 1.0


def _kept(pairs: DataFrame, docs: DataFrame, words: int, made, near) -> DataFrame:
    """The pairs (u, v) for which near(n, value, m, value) holds of what `made` makes of their texts' sets."""
    asked = pairs.select("u").union(pairs.select("v")).distinct().toDF("doc_id")
    of = stage(_of_sets(docs.select("doc_id", "text").join(asked, "doc_id", "left_semi"), words, made).dropDuplicates(["doc_id"]), "sets")
    both = pairs.join(of.toDF("u", "n", "a"), "u").join(of.toDF("v", "m", "b"), "v").select("u", "v", "n", "a", "m", "b")

    def rows(batches):
        for batch in batches:
            keep = [near(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("n", "a", "m", "b")), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    out = stage(both.mapInArrow(rows, "u long, v long"), "kept")
    unstage(of)
    return out


def verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of documents whose shingles have a Jaccard similarity of `similarity` or more, from all shingles of both.

    Bitmaps, a small part of the sets in size, first clear pairs that differ in too many bits to be that similar.
    """
    most = (1 - similarity) / (1 + similarity)
    maybe = _kept(pairs, docs, words, bitmap, lambda n, a, m, b: difference(a, b) <= most * (n + m) + 1e-6)
    out = _kept(maybe, docs, words, np.ndarray.tobytes, lambda n, a, m, b: resemblance(a, b) >= similarity)
    unstage(maybe)
    return out


PREFIXES = pa.schema([(c, pa.int64()) for c in ("token", "doc_id", "size", "at")])


def common_shingles(docs: DataFrame, words: int, sample: int = 20_000, least: int = 4, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingle hashes, in order, and their counts in about `sample` documents. What is missed costs time, no result."""
    part = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // sample))) == 0)

    def rows(batches):
        for _, _, own in _each(batches, words):
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["token"])

    counts = part.mapInArrow(rows, "token long").groupBy("token").count().filter(F.col("count") >= least)
    found = counts.orderBy(F.desc("count"), "token").limit(most).collect()
    tokens = np.array([r["token"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["count"] for r in found], np.int64)[order]


def _prefixes(docs: DataFrame, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """PREFIXES rows of docs (doc_id, text): the first shingles of each text in one order of all shingles, rare ones first.

    Two texts of that similarity share a shingle among them, as they share `similarity` times the shingles of either.
    """
    known, counts = common

    def rows(batches):
        out, held = [], 0
        for batch, k, own in _each(batches, words):
            n = len(own)
            if not n:
                continue
            rank = np.zeros(n, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                rank = np.where(known[at] == own, counts[at], 0)
            first = own[np.lexsort((own, rank))[: n - math.ceil(similarity * n - 1e-6) + 1]].view(np.int64)
            m = len(first)
            out.append((first, np.full(m, batch.column("doc_id")[k].as_py()), np.full(m, n), np.arange(m)))
            held += m
            if held > HELD:
                yield batch_of(PREFIXES, *(np.concatenate(c) for c in zip(*out, strict=True)))
                out, held = [], 0
        if out:
            yield batch_of(PREFIXES, *(np.concatenate(c) for c in zip(*out, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(rows, ", ".join(f"{c} long" for c in PREFIXES.names))


def shared_prefixes(prefixes: DataFrame) -> DataFrame:
    """The rows of `prefixes` whose shingle stands in another document's prefix too."""

    def rows(batches):
        for batch, starts in groups(batches, ["token"]):
            many = np.diff(np.append(starts, batch.num_rows)) > 1
            if many.any():
                yield batch.filter(pa.array(np.repeat(many, np.diff(np.append(starts, batch.num_rows)))))

    return prefixes.repartition("token").sortWithinPartitions("token").mapInArrow(rows, ", ".join(f"{c} long" for c in PREFIXES.names))


def _fit(size, at, root, bits, x, y, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x, y) of rows with unequal roots that may be similar by their sizes, the shingle's places in them and their bitmaps.

    The first shingle that two similar texts share leaves enough after it in both; so each such pair fits at one of its shingles.
    """
    both, after = size[x] + size[y], np.minimum(size[x] - at[x], size[y] - at[y])
    near = np.flatnonzero((root[x] != root[y]) & (after >= similarity / (1 + similarity) * both - 1e-6))
    x, y = x[near], y[near]
    apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
    near = apart <= (1 - similarity) / (1 + similarity) * both[near] + 1e-6
    return x[near], y[near]


def sketches(docs: DataFrame, shared: DataFrame, words: int) -> DataFrame:
    """(doc_id, sketch): the least bitmap of each document in `shared`."""
    some = docs.select("doc_id", "text").join(shared.select("doc_id").distinct(), "doc_id", "left_semi")
    return _of_sets(some, words, lambda own: bitmap(own, LEAST_BITS)).select("doc_id", F.col("value").alias("sketch")).dropDuplicates(["doc_id"])


def candidates(shared: DataFrame, roots: DataFrame, sketched: DataFrame, similarity: float, few: bool) -> DataFrame:
    """(u, v) of documents of unequal roots that share a prefix shingle and may be that similar; each pair once.

    few: of each shingle's documents (by size) only neighbours and the first with each, and of these one pair for any two roots,
    which is linear in the rows and connects most of a crowd of copies. Else every pair.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "u", "v")])

    def pairs(batches):
        for batch, starts in groups(batches, ["token"]):
            doc, root, size, at = (longs(batch.column(c)) for c in ("doc_id", "root", "size", "at"))
            bits = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, LEAST_BITS // 64)
            ends = np.append(starts[1:], len(doc))

            def rows(x, y):
                x, y = _fit(size, at, root, bits, x, y, similarity)  # noqa: B023
                swap = doc[x] < doc[y]  # noqa: B023
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                return batch_of(schema, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]), doc[x], doc[y])  # noqa: B023

            if few:
                own = np.repeat(starts, ends - starts)
                next_ = np.flatnonzero(own[1:] == own[:-1])
                other = np.flatnonzero(np.arange(len(doc)) - own > 1)
                yield rows(np.concatenate([next_, own[other]]), np.concatenate([next_ + 1, other]))
                continue
            # sorted by size: a partner is at most size / similarity
            run = np.repeat(np.arange(len(starts)), ends - starts)
            last = np.searchsorted(run * float(1 << 40) + size, run * float(1 << 40) + size / similarity + 1e-6, side="right")
            count = np.maximum(0, last - np.arange(len(doc)) - 1)
            for lo, hi in _portions(count, HELD >> 2):
                n = count[lo:hi]
                x = np.repeat(np.arange(lo, hi), n)
                yield rows(x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n))

    of = sketched.join(roots.toDF("doc_id", "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    rooted = shared.join(of, "doc_id")
    found = rooted.repartition("token").sortWithinPartitions("token", "size", "doc_id").mapInArrow(pairs, "a long, b long, u long, v long")
    if few:
        return found.groupBy("a", "b").agg(F.min(F.struct("u", "v")).alias("p")).select("p.*")
    return found.select("u", "v").distinct()


def _portions(count: np.ndarray, limit: int):
    """Ranges of rows whose counts sum to about `limit`, or one row."""
    total = np.append(0, np.cumsum(count))
    i = 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, narrow: int = 2, prints: int = 2, bits: int = 5) -> DataFrame:
    """(doc_id, component_id): the components of all pairs at a Jaccard similarity of `similarity` or more of their `words`-word shingles.

    Candidates are first texts at `bits` or fewer differing bits in any of `prints` SimHash fingerprints over `narrow`-word
    shingles, which change less than longer ones. What these leave in unequal components is joined by the shingles of a prefix
    that similar texts must share: neighbours in each shingle's list first, so that crowds of copies grow together at a
    linear cost, then every pair that is left between unequal components, so that no link is missed. Each candidate is
    verified by all its shingles. Texts of equal words are linked as such. Blank texts are equal; null ids take no part;
    repeated rows are one document.
    """
    names = tuple(f"f{k}" for k in range(prints))
    made = stage(_multiprints(docs.filter("doc_id is not null"), narrow, prints), "prints")
    texts = stage(made.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in names)), "texts")
    # one fingerprint at a time, so that one index is on disk at a time
    found = [stage(links(texts, bits, (c,)), "candidates") for c in names]
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    near = verified(edges.distinct(), docs, words, similarity)
    roots = components(near)
    single = docs.select("doc_id", "text").join(texts.select("rep").distinct().toDF("doc_id"), "doc_id", "left_semi")
    shared = stage(shared_prefixes(_prefixes(single, words, similarity, common_shingles(docs, words))), "shared")
    sketched = stage(sketches(single, shared, words), "sketches")
    for few in (True, False):
        more = verified(candidates(shared, roots, sketched, similarity, few), docs, words, similarity)
        grown = components(more.unionByName(roots.toDF("u", "v")))
        unstage(roots, more)
        roots = grown
    unstage(shared, sketched, near, *found)
    of = texts.join(roots, texts["rep"] == roots["node"], "left").select("t1", "t2", F.coalesce("root", "rep").alias("component_id"))
    return made.select("doc_id", "t1", "t2").join(of, ["t1", "t2"]).select("doc_id", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
