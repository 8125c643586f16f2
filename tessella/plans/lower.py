"""Lowering of the semantic plan to one lazy DataFrame (i, j, x).

What Catalyst cannot know is decided here: operations over one base become one projection without a join, absent zeros
are enumerated only where an operation changes them, and finite row or column factors scale sparse values in place.
Everything else (pushdown, pruning, join choice, partial aggregation, spill) is left to Spark.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ieee
from .expr import DENSE, SPARSE, Binary, Broadcast, Expr, Gather, MatMul, ScalarBinary, Slice, Source, Transpose, Unary, postorder

#: Factors and selectors of this many cells or fewer are broadcast (24 bytes each); larger ones are joined by shuffle.
BROADCAST_CELLS = 1_000_000
#: Operations put into one Column before it gets a name of its own.
NESTED = 24


def small(df: DataFrame, cells: int) -> DataFrame:
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df


def grid(spark: SparkSession, shape: tuple[int, int]) -> DataFrame:
    """Every coordinate; the shorter axis is the side that is sent around, if it is small."""
    rows, cols = spark.range(shape[0]).toDF("i"), spark.range(shape[1]).toDF("j")
    if shape[0] < shape[1]:
        return cols.crossJoin(small(rows, shape[0])).select("i", "j")
    return rows.crossJoin(small(cols, shape[1]))


def filled(df: DataFrame, shape: tuple[int, int], value: float) -> DataFrame:
    """df with a row for every coordinate of the shape."""
    return grid(df.sparkSession, shape).join(df, ["i", "j"], "left").select("i", "j", F.coalesce("x", F.lit(value)).alias("x"))


def base_of(root: Expr) -> dict[int, Expr]:
    """For each node, the node whose rows its value is a function of; itself where it is none of one other node."""
    out: dict[int, Expr] = {}
    for n in postorder(root):
        if isinstance(n, (Unary, ScalarBinary)):
            out[id(n)] = out[id(n.x)]
        elif isinstance(n, Binary) and not n.scaling and out[id(n.a)] is out[id(n.b)]:
            out[id(n)] = out[id(n.a)]
        else:
            out[id(n)] = n
    return out


def lower(root: Expr) -> DataFrame:
    """The DataFrame of a plan; one per node that is a base, made once."""
    base = base_of(root)
    made: dict[int, DataFrame] = {}

    def frame(node: Expr) -> DataFrame:
        b = base[id(node)]
        return made[id(b)] if node is b else pointwise(node, b, made[id(b)])

    for n in postorder(root):
        if base[id(n)] is n:
            made[id(n)] = _base(n, frame)
    return frame(root)


def pointwise(root: Expr, base: Expr, df: DataFrame) -> DataFrame:
    """root over the rows of base: one projection, in named steps where it is deep or a value is used again."""
    if root.storage == DENSE and base.storage == SPARSE:
        df = filled(df, base.shape, base.implicit)
    inner, todo, seen = [], [root], set()
    uses: Counter[int] = Counter()
    while todo:
        n = todo.pop()
        if n is base or id(n) in seen:
            continue
        seen.add(id(n))
        for c in n.children:
            uses[id(c)] += 1
            todo.append(c)
    inner = [n for n in postorder(root) if id(n) in seen]
    column: dict[int, tuple[Column, int]] = {id(base): (F.col("x"), 0)}
    for n in inner:
        args = [column[id(c)] for c in n.children]
        c, depth = apply(n, [a[0] for a in args]), 1 + max(a[1] for a in args)
        if n is not root and (uses[id(n)] > 1 or depth >= NESTED):
            name = f"v{len(column)}"
            df = df.withColumn(name, c)
            c, depth = F.col(name), 0
        column[id(n)] = (c, depth)
    return df.select("i", "j", column[id(root)][0].alias("x"))


def apply(n: Expr, args: list[Column]) -> Column:
    if isinstance(n, Unary):
        return ieee.UNARY[n.op](args[0])
    if isinstance(n, ScalarBinary):
        s = F.lit(float(n.scalar))
        return ieee.BINARY[n.op](s, args[0]) if n.reverse else ieee.BINARY[n.op](args[0], s)
    return ieee.BINARY[n.op](*args)


def _base(n: Expr, frame) -> DataFrame:
    if isinstance(n, Source):
        x = F.col("x").cast("double")
        df = n.frame() if callable(n.frame) else n.frame
        return df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.coalesce(x, ieee.nan()).alias("x"))
    if isinstance(n, Transpose):
        return frame(n.x).select(F.col("j").alias("i"), F.col("i").alias("j"), "x")
    if isinstance(n, Broadcast):
        return _broadcast(n, frame(n.x))
    if isinstance(n, Slice):
        return frame(n.x).filter(_inside("i", n.rows) & _inside("j", n.cols)).select(_moved("i", n.rows), _moved("j", n.cols), "x")
    if isinstance(n, Gather):
        k = "ij"[n.axis]
        joined = frame(n.x).join(small(n.selector, n.count), F.col(k) == F.col("source_index"))
        return joined.select(*(F.col("output_index").alias(c) if c == k else F.col(c) for c in "ij"), "x")
    if isinstance(n, MatMul):
        a = frame(n.a).select("i", F.col("j").alias("k"), F.col("x").alias("a"))
        b = frame(n.b).select(F.col("i").alias("k"), "j", F.col("x").alias("b"))
        return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("x"))
    return _joined(n, frame)


def _broadcast(n: Broadcast, df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    for k, axis in enumerate("ij"):
        if n.x.shape[k] != n.shape[k]:
            values = spark.range(n.shape[k]).toDF(axis)
            other = df.drop(axis)
            cells = n.x.shape[1 - k]
            df = values.crossJoin(small(other, cells)) if cells <= n.shape[k] else other.crossJoin(small(values, n.shape[k]))
    return df.select("i", "j", "x")


def _inside(axis: str, cut: tuple[int, int, int]) -> Column:
    start, step, count = cut
    if count == 0:
        return F.lit(False)
    last = start + step * (count - 1)
    c = F.col(axis)
    inside = c.between(min(start, last), max(start, last))
    return inside if abs(step) == 1 or count == 1 else inside & ((c - F.lit(start)) % F.lit(abs(step)) == 0)


def _moved(axis: str, cut: tuple[int, int, int]) -> Column:
    start, step, count = cut
    if count <= 1:
        return F.lit(0).cast("long").alias(axis)
    if (start, step) == (0, 1):
        return F.col(axis)
    return F.expr(f"({axis} - {start}L) div {step}L").alias(axis)


def _joined(n: Binary, frame) -> DataFrame:
    if n.scaling:
        values, factor = n.scaling
        return _scaled(n, frame(values), factor, frame(factor.x))
    a = frame(n.a).withColumnRenamed("x", "a")
    b = frame(n.b).withColumnRenamed("x", "b")
    va, vb = (v.implicit if v.storage == SPARSE else None for v in (n.a, n.b))
    if va is None and vb is None:
        both = a.join(b, ["i", "j"])
    elif vb is not None and va is None:
        both = a.join(b, ["i", "j"], "left")
    elif va is not None and vb is None:
        both = b.join(a, ["i", "j"], "left")
    else:  # one shuffle with partial aggregation; a coordinate has one row a side at most
        none = F.lit(None).cast("double")
        both = a.withColumn("b", none).unionByName(b.withColumn("a", none)).groupBy("i", "j").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        if n.storage == DENSE:
            both = grid(a.sparkSession, n.shape).join(both, ["i", "j"], "left")
    ca = F.col("a") if va is None else F.coalesce("a", F.lit(va))
    cb = F.col("b") if vb is None else F.coalesce("b", F.lit(vb))
    return both.select("i", "j", ieee.BINARY[n.op](ca, cb).alias("x"))


def _scaled(n: Binary, values: DataFrame, factor: Broadcast, f: DataFrame) -> DataFrame:
    keys = [k for k, axis in enumerate("ij") if factor.x.shape[k] == factor.shape[k] and (factor.shape[k] != 1)]
    names = ["ij"[k] for k in keys]
    f = f.select(*names, F.col("x").alias("f"))
    cells = factor.x.shape[0] * factor.x.shape[1]
    joined = values.join(small(f, cells), names, "left") if names else values.crossJoin(F.broadcast(f))
    return joined.select("i", "j", (F.col("x") * F.coalesce("f", F.lit(0.0))).alias("x"))
