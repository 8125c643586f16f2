"""Reductions over a matrix, implicit zeros counted without being enumerated."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ieee import nan, negative_zero
from ..plans.expr import DENSE, Expr
from ..plans.lower import lower, small

OPS = ("sum", "mean", "var", "std", "min", "max", "any", "all", "nansum", "nanmean", "nanvar", "nanstd", "nanmin", "nanmax")


def cells(expr: Expr, axis: int | None) -> int:
    """Cells that one result stands for."""
    return expr.shape[0] * expr.shape[1] if axis is None else expr.shape[axis]


def missing(op: str, n: int, ddof: float) -> float | bool:
    """The result over n zeros."""
    if op in ("any", "all"):
        return op == "all" and n == 0
    if "var" in op or "std" in op:
        return 0.0 if n > ddof else math.nan
    return math.nan if "mean" in op and n == 0 else 0.0


def _extreme(low: bool, skip: bool, n: float) -> Column:
    x = F.col("x")
    ok = ~F.isnan(x)
    best = (F.min if low else F.max)(F.when(ok, x))
    absent = F.count("*") < F.lit(n)
    with_zero = F.when(absent, (F.least if low else F.greatest)(F.coalesce(best, F.lit(0.0)), F.lit(0.0))).otherwise(best)
    negative = F.coalesce(F.bool_or((x == 0) & negative_zero(x)), F.lit(False))
    positive = F.coalesce(F.bool_or((x == 0) & ~negative_zero(x)), F.lit(False)) | absent
    minus = negative if low else ~positive
    # a literal -0.0 would be taken for 0.0 by the optimiser
    out = F.when(with_zero == 0, F.when(minus, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.abs(with_zero)).otherwise(with_zero)
    if skip:
        return F.coalesce(out, nan())
    return F.when(F.bool_or(F.isnan(x)), nan()).otherwise(F.coalesce(out, nan()))


def _plain(op: str, n: int) -> Column:
    x, ok = F.col("x"), ~F.isnan("x")
    total = F.coalesce(F.sum(F.when(ok, x)), F.lit(0.0))
    count = F.lit(float(n)) - F.sum(F.isnan("x").cast("double"))
    return {
        "sum": lambda: F.sum(x),
        "mean": lambda: F.sum(x) / F.lit(float(n)) if n else nan(),
        "nansum": lambda: total,
        "nanmean": lambda: F.when(count <= 0, nan()).otherwise(F.try_divide(total, count)),
        "min": lambda: _extreme(True, False, float(n)),
        "max": lambda: _extreme(False, False, float(n)),
        "nanmin": lambda: _extreme(True, True, float(n)),
        "nanmax": lambda: _extreme(False, True, float(n)),
        "any": lambda: F.coalesce(F.bool_or(F.isnan(x) | (x != 0)), F.lit(False)),
        "all": lambda: (F.count("*") >= F.lit(float(n))) & F.coalesce(F.bool_and(F.isnan(x) | (x != 0)), F.lit(True)),
    }[op]()


def _variance(df: DataFrame, key: list[str], op: str, n: int, ddof: float, groups: int) -> DataFrame:
    """Two passes: scale and least finite value of each group, then the central moment of the scaled distances from it.

    Absent zeros join the moment by the merging rule for two sets, so that none is enumerated.
    """
    finite = ~F.isnan("x") & (F.abs("x") != math.inf)
    first = df.groupBy(*key).agg(
        F.max(F.when(finite, F.abs("x"))).alias("scale"),
        F.min(F.when(finite, F.col("x"))).alias("anchor"),
        F.count("*").cast("double").alias("c"),
        F.sum(F.isnan("x").cast("double")).alias("nans"),
        F.sum((F.abs("x") == math.inf).cast("double")).alias("infs"),
    )
    # a power of two, so that scaling does not round
    scale = F.when(F.coalesce("scale", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("scale")).cast("double")))
    first = first.withColumn("scale", scale).withColumn("anchor", F.coalesce("anchor", F.lit(0.0)))
    joined = df.join(small(first.select(*key, "scale", "anchor"), groups), key) if key else df.crossJoin(F.broadcast(first.select("scale", "anchor")))
    apart = F.col("x") - F.col("anchor")
    z = F.when(F.abs(apart) == math.inf, F.try_divide("x", "scale") - F.try_divide("anchor", "scale")).otherwise(F.try_divide(apart, F.col("scale")))
    second = joined.filter(finite).select(*key, z.alias("z")).groupBy(*key).agg(F.avg("z").alias("mu"), F.var_pop("z").alias("v"), F.count("*").cast("double").alias("fc"))
    both = first.join(second, key, "left") if key else first.crossJoin(F.broadcast(second))
    mu, v, fc = (F.coalesce(c, F.lit(0.0)) for c in ("mu", "v", "fc"))
    zeros = F.lit(float(n)) - F.col("c")
    gap = F.try_divide("anchor", "scale") + mu
    m2 = v * fc + F.when((zeros > 0) & (fc > 0), gap * gap * F.try_divide(fc * zeros, fc + zeros)).otherwise(F.lit(0.0))
    skip = op.startswith("nan")
    free = F.lit(float(Fraction(n) - Fraction(ddof)))
    free = free - F.col("nans") if skip else free
    spent = nan() if skip else F.when(m2 > 0, F.lit(math.inf)).otherwise(nan())
    root = F.sqrt(F.try_divide(m2, free)) * F.col("scale")
    value = root if op.endswith("std") else root * root
    exact = F.try_divide(m2, free) * F.col("scale") * F.col("scale")
    value = value if op.endswith("std") else F.when((F.abs(exact) == math.inf) | (exact == 0), value).otherwise(exact)
    bad = F.col("infs") > 0 if skip else (F.col("infs") > 0) | (F.col("nans") > 0)
    return both.select(*key, F.when(bad, nan()).when(free <= 0, spent).otherwise(value).alias("value"))


def reduced(expr: Expr, op: str, axis: int | None, ddof: float = 0.0) -> DataFrame:
    """(index, value) of an axis, or (value): groups with stored cells only."""
    df, n = lower(expr), cells(expr, axis)
    key = [] if axis is None else ["j" if axis == 0 else "i"]
    if "var" in op or "std" in op:
        groups = 1 if axis is None else expr.shape[1 - axis]
        out = _variance(df.select(*key, "x"), key, op, n, ddof, groups)
    else:
        out = df.groupBy(*key).agg(_plain(op, n).alias("value"))
    return out.select(*(F.col(k).alias("index") for k in key), "value")


def reduced_frame(expr: Expr, op: str, axis: int, ddof: float = 0.0) -> DataFrame:
    """(index, value) for every index of the axis that stays, lazily."""
    out, n = reduced(expr, op, axis, ddof), cells(expr, axis)
    if expr.storage == DENSE and n:
        return out
    size = expr.shape[1 - axis]
    return expr_range(out, size).join(out, "index", "left").select("index", F.coalesce("value", F.lit(missing(op, n, ddof))).alias("value"))


def expr_range(df: DataFrame, size: int) -> DataFrame:
    return df.sparkSession.range(size).toDF("index")
