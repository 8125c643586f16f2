"""Operator 2, approximate nearest neighbours: cross-polytope hashing of fast Hadamard pseudo-rotations, multiprobe, exact reranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, groups, longs, stage, table
from .seqhash import mix

ENTRY = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("vec", pa.binary())])
FOUND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
#: Rows and queries of one bucket that meet in one task; more are cut into chunks that all meet.
CHUNK = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class CrossPolytope:
    """Tables of hashes. A hash is the nearest signed axis after three sign flips and Hadamard transforms, and, for a finer
    table, the nearest of 2 * fine signed axes among the first coordinates of another such rotation."""

    def __init__(self, dim: int, tables: int, fine: int, seed: int = 42):
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.fine = fine
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, 3, self.size))

    def _axes(self, x: np.ndarray, t: int, part: int, n: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for s in self.signs[t, part]:
            y = hadamard(y * s)
        y = y[:, :n]
        return np.concatenate([y, -y], axis=1)

    def ranked(self, x: np.ndarray, t: int, probes: int) -> np.ndarray:
        """The `probes` buckets of table t that fit each unit vector best, best first."""
        a = self._axes(x, t, 0, self.size)
        if not self.fine:
            if probes == 1:
                return a.argmax(axis=1)[:, None]
            return np.argsort(-a, axis=1, kind="stable")[:, :probes]
        b = self._axes(x, t, 1, self.fine) * math.sqrt(self.size / self.fine) * 0.5
        if probes == 1:
            return (a.argmax(axis=1) * 2 * self.fine + b.argmax(axis=1))[:, None]
        both = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
        return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.transform(column, lambda v: v.cast("double")).alias("e")).filter(
        F.col("e").isNotNull() & F.col("id").isNotNull() & F.forall("e", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(math.inf)), F.lit(False))) & F.exists("e", lambda v: v != 0)
    )


def nearest(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", every: int = 100, k: int = 10, tables: int = 8, recall: float = 0.97, fitted: int = 100, bucket_rows: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose id is divisible by `every`.

    Nearness is the Euclidean distance of the original vectors in double precision; ties go to the smaller id; the query's own
    row is no candidate. Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
    length is not the most common one. Of equal vectors one is hashed, and the k + 1 smallest ids stand for them all, which
    loses nothing. Of an id with several vectors the one with the smallest hash counts; other columns are ignored.

    The axes of a second rotation refine the tables so that a bucket has about `bucket_rows` vectors. How many buckets of a table
    are probed is fitted: the true neighbours of at most `fitted` queries (by hash of the id) are found among all rows, and the
    fewest probes are taken that reach `recall` of them. Queries whose buckets hold too few vectors meet all rows.
    """
    kind = np.float32 if dict(vectors.dtypes)[column] == "array<float>" else np.float64  # what the vectors are sent as, without loss
    usable = _usable(vectors, id_column, column)
    sizes = usable.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    dim = sizes["d"]
    keyed = usable.filter(F.size("e") == dim).withColumn("h1", F.xxhash64("e")).withColumn("h2", F.hash("e", F.lit(7)).cast("long") * 4294967296 + F.xxhash64(F.lit(1), "e") % 4294967296)
    first = F.row_number().over(Window.partitionBy("id").orderBy("h1", "h2"))
    keyed = stage(keyed.withColumn("first", first).filter("first = 1").drop("first"), "vectors")
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    members = stage(keyed.select("id", "h1", "h2", "e").withColumn("place", place).filter(F.col("place") <= k + 1), "members")
    distinct = members.filter("place = 1").select("id", "h1", "h2", "e")
    asked = keyed.filter(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), "h1", "h2")
    queried = asked.select("h1", "h2").distinct().withColumn("is_query", F.lit(1))
    rows = stage(distinct.join(queried, ["h1", "h2"], "left").select("id", "e", F.coalesce("is_query", F.lit(0)).alias("is_query")), "rows")
    n = rows.count()
    fine = 0
    model = CrossPolytope(dim, tables, fine)
    while n / (2 * model.size * max(1, 2 * fine)) > bucket_rows and fine < model.size:
        fine = max(2, 2 * fine)
    model = CrossPolytope(dim, tables, fine)
    probes = _probes(rows, model, dim, k, recall, fitted)
    width = 2 * model.size * max(1, 2 * fine)

    def entries(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("e"), dim)
            ids, query = longs(batch.column("id")), longs(batch.column("is_query")) > 0
            payload = _payload(x, kind)
            unit = _unit(x)
            for t in range(tables):
                own = model.ranked(unit, t, 1)[:, 0] + t * width
                yield batch_of(ENTRY, own, np.zeros(len(ids), np.int32), ids, payload)
                if query.any():
                    p = model.ranked(unit[query], t, probes) + t * width
                    m = p.shape[1]
                    yield batch_of(ENTRY, p.ravel(), np.ones(p.size, np.int32), np.repeat(ids[query], m), np.repeat(payload[query], m))

    top = stage(_met(rows.mapInArrow(entries, "bucket long, kind int, id long, vec binary"), dim, k + 1, kind), "nearest")
    full = top.groupBy("query").count().filter(F.col("count") >= min(k + 1, n)).select(F.col("query").alias("id"))
    short = rows.filter("is_query = 1").join(full, "id", "left_anti").select("id", "e")
    if not short.isEmpty():
        exact = _met(_all_rows(rows.select("id", "e"), short, -(-n // CHUNK), kind), dim, k + 1, kind)
        top = top.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(exact)

    ids = members.select(F.col("id").alias("vec_id"), "h1", "h2")
    rep = distinct.select(F.col("id").alias("rep"), "h1", "h2")
    of = ids.join(rep, ["h1", "h2"])
    answers = top.join(of.select(F.col("rep").alias("id"), "vec_id"), "id").select(F.col("query").alias("rep"), "vec_id", "score")
    ranked = Window.partitionBy("rep").orderBy("score", "vec_id")
    answers = answers.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k + 1)
    mine = asked.join(rep, ["h1", "h2"]).join(answers, "rep").filter("query_id <> vec_id")
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return mine.withColumn("rank", final).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _payload(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([v.tobytes() for v in x.astype(kind)], dtype=object)


def _unit(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _probes(rows: DataFrame, model: CrossPolytope, dim: int, k: int, recall: float, fitted: int) -> int:
    """The fewest buckets of each table that hold `recall` of the true neighbours of at most `fitted` queries."""
    chosen = rows.filter("is_query = 1").orderBy(F.xxhash64("id"), "id").limit(fitted).select("id", "e").collect()
    if not chosen:
        return 1
    qid, q = np.array([r.id for r in chosen], np.int64), np.array([r.e for r in chosen], float).reshape(-1, dim)

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch_of(FOUND, *_best(qid, q, longs(batch.column("id")), _matrix(batch.column("e"), dim), k + 1))

    found = rows.mapInArrow(near, "query long, id long, score double").filter("query <> id")
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    true = found.withColumn("place", place).filter(F.col("place") <= k).select("query", "id").join(rows.select("id", "e"), "id").collect()  # fitted * k at most
    if not true:
        return 1
    of, unit, neighbour = np.searchsorted(np.sort(qid), [r.query for r in true]), _unit(q[np.argsort(qid)]), _unit(np.array([r.e for r in true], float))
    width = 2 * model.size * max(1, 2 * model.fine)
    best = np.full(len(true), width)
    for t in range(len(model.signs)):
        order = model.ranked(unit, t, width)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(width)[None], axis=1)
        best = np.minimum(best, rank[of, model.ranked(neighbour, t, 1)[:, 0]])
    return int(np.sort(best)[max(0, math.ceil(recall * len(best)) - 1)]) + 1


def _met(index: DataFrame, dim: int, k: int, kind: type) -> DataFrame:
    """(query, id, score): the k nearest of the rows (kind 0) that each query (kind 1) shares a bucket with.

    The rows and the queries of a bucket are cut into chunks, all of which meet, each pair of chunks in some task.
    """
    index = stage(index, "index")
    cut = index.groupBy("bucket").agg(F.ceil(F.sum(1 - F.col("kind")) / CHUNK).cast("int").alias("nr"), F.ceil(F.sum("kind") / CHUNK).cast("int").alias("nq")).filter("nr > 0 and nq > 0")
    own = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    all_ = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    dealt = index.join(cut, "bucket")
    met = dealt.filter("kind = 0").withColumn("r", own("nr")).withColumn("q", all_("nq")).unionByName(dealt.filter("kind = 1").withColumn("q", own("nq")).withColumn("r", all_("nr")))

    def meet(batches):
        for batch, starts in groups(batches, ["bucket", "r", "q"]):
            ids, of = longs(batch.column("id")), longs(batch.column("kind"))
            vec = np.frombuffer(b"".join(batch.column("vec").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
            out = []
            for s, e in zip(starts, np.append(starts[1:], len(ids)), strict=True):
                q, c = np.flatnonzero(of[s:e] == 1) + s, np.flatnonzero(of[s:e] == 0) + s
                if len(q) and len(c):
                    out.append(_best(ids[q], vec[q], ids[c], vec[c], k))
            if out:
                yield batch_of(FOUND, *map(np.concatenate, zip(*out, strict=True)))

    shape = met.select("bucket", "r", "q", "kind", "id", "vec").repartition("bucket", "r", "q").sortWithinPartitions("bucket", "r", "q")
    found = shape.mapInArrow(meet, "query long, id long, score double").distinct()
    best = Window.partitionBy("query").orderBy("score", "id")
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("query", "id", "score")


def _all_rows(rows: DataFrame, short: DataFrame, chunks: int, kind: type) -> DataFrame:
    """Index entries by which each query in `short` meets every row: a bucket for each chunk of rows."""

    def entries(which, deal):
        def made(batches):
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    yield batch_of(ENTRY, *deal(longs(batch.column("id")), _payload(x, kind), which))

        return made

    own = lambda ids, vec, of: (mix(ids.view(np.uint64)) % np.uint64(chunks), np.full(len(ids), of, np.int32), ids, vec)
    all_ = lambda ids, vec, of: (np.tile(np.arange(chunks), len(ids)), np.full(len(ids) * chunks, of, np.int32), np.repeat(ids, chunks), np.repeat(vec, chunks))
    columns = "bucket long, kind int, id long, vec binary"
    return rows.mapInArrow(entries(0, own), columns).unionByName(short.mapInArrow(entries(1, all_), columns))


def _best(qid, q, cid, c, k):
    """For each query its k nearest rows: ids, ids, distances; blocks bound the memory."""
    out = []
    step = max(1, (1 << 21) // (len(c) * c.shape[1]))
    order = np.argsort(cid)
    cid, c = cid[order], c[order]
    for i in range(0, len(q), step):
        d = np.sqrt(((q[i : i + step, None, :] - c[None]) ** 2).sum(axis=2))
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        out.append((np.repeat(qid[i : i + step], near.shape[1]), cid[near].ravel(), np.take_along_axis(d, near, axis=1).ravel()))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
