"""Elementwise functions that follow NumPy's rules for NaN, infinities and signed zeros, as Spark Columns.

Spark differs by default: division by zero raises or gives NULL, logarithms of non-positive values are NULL, floor and ceil
return integers, and NaN equals itself and exceeds all. Every function here takes and returns non-NULL doubles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F



def _lit(v: float) -> Column:
    return F.lit(float(v))


def nan() -> Column:
    return F.lit(float("nan"))


def negative_zero(x: Column) -> Column:
    """Whether a zero is -0.0 (undefined for other values)."""
    return F.pow(x, _lit(-1.0)) < 0


def _guarded(f: Callable[[Column], Column], low: float) -> Callable[[Column], Column]:
    def out(x: Column) -> Column:
        return F.when(F.isnan(x), x).when(x < low, nan()).when(x == low, _lit(-math.inf)).otherwise(f(x))

    return out


def floor(x: Column) -> Column:
    r = F.rint(x)
    return F.when(F.isnan(x), x).when(r > x, r - 1.0).otherwise(r)


def ceil(x: Column) -> Column:
    return -floor(-x)


def trunc(x: Column) -> Column:
    return F.when(F.isnan(x) | (x == 0), x).when(x < 0, ceil(x)).otherwise(floor(x))


def sign(x: Column) -> Column:
    return F.when(F.isnan(x), x).when(x == 0, _lit(0.0)).otherwise(F.signum(x))


UNARY: dict[str, Callable[[Column], Column]] = {
    "negative": lambda x: -x,
    "absolute": F.abs,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "expm1": F.expm1,
    "log": _guarded(F.ln, 0.0),
    "log1p": _guarded(F.log1p, -1.0),
    "log2": _guarded(F.log2, 0.0),
    "log10": _guarded(F.log10, 0.0),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "floor": floor,
    "ceil": ceil,
    "trunc": trunc,
    "sign": sign,
    "isnan": lambda x: F.isnan(x).cast("double"),
}


def divide(a: Column, b: Column) -> Column:
    by_zero = F.when((a == 0) | F.isnan(a), nan()).when((a < 0) != negative_zero(b), _lit(-math.inf)).otherwise(_lit(math.inf))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def power(a: Column, b: Column) -> Column:
    return F.when(a == 1.0, _lit(1.0)).when((a == -1.0) & (F.abs(b) == math.inf), _lit(1.0)).when((a == 0) & (b == 0.5), a).otherwise(F.pow(a, b))


def _ordered(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: (~F.isnan(a) & ~F.isnan(b) & f(a, b)).cast("double")


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "true_divide": divide,
    "power": power,
    "greater": _ordered(lambda a, b: a > b),
    "greater_equal": _ordered(lambda a, b: a >= b),
    "less": _ordered(lambda a, b: a < b),
    "less_equal": _ordered(lambda a, b: a <= b),
    "equal": _ordered(lambda a, b: a == b),
    "not_equal": lambda a, b: (F.isnan(a) | F.isnan(b) | (a != b)).cast("double"),
}


def value(op: str, *args: float) -> float:
    """The operation on host floats, for coordinates that are not stored."""
    with np.errstate(all="ignore"):
        if op == "power" and args[0] == 0 and args[1] == 0.5:
            return args[0]
        return float(getattr(np, op)(*(np.float64(a) for a in args)))
