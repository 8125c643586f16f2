"""The semantic plan: an immutable DAG of matrix operations, and what can be told from it without data."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame

from ..functions import ieee

DENSE, SPARSE = "dense", "sparse"
#: Deepest plan that is accepted.
MAX_DEPTH = 768


@dataclass(frozen=True, eq=False)
class Expr:
    shape: tuple[int, int] = field(init=False)

    @property
    def children(self) -> tuple[Expr, ...]:
        return ()

    @cached_property
    def depth(self) -> int:
        return 1 + max((c.depth for c in self.children), default=0)

    @cached_property
    def implicit(self) -> float | None:
        """What a coordinate without a stored row would hold, or None where every coordinate has one.

        A value other than zero is kept, as a later operation may bring it back to zero (exp(A) - 1); such a matrix is
        dense, and lowering enumerates it.
        """
        return self._implicit()

    @property
    def storage(self) -> str:
        return SPARSE if self.implicit == 0 else DENSE

    @cached_property
    def finite(self) -> bool:
        """Whether all values are proved finite: owned inputs under operations that only move coordinates."""
        return self._finite()

    @cached_property
    def has_sparse_source(self) -> bool:
        return any(c.has_sparse_source for c in self.children)

    def _implicit(self) -> float | None:
        return self.children[0].implicit

    def _finite(self) -> bool:
        return False

    def _set(self, shape: tuple[int, int]) -> None:
        object.__setattr__(self, "shape", (int(shape[0]), int(shape[1])))
        if self.depth > MAX_DEPTH:
            raise RecursionError(f"plans are at most {MAX_DEPTH} operations deep; compute() an intermediate result")

    def fields(self) -> dict[str, Any]:
        return {}


@dataclass(frozen=True, eq=False)
class Source(Expr):
    frame: DataFrame | Callable[[], DataFrame]  # a function is asked at each lowering: its rows may be replaced
    size: tuple[int, int]
    kind: str
    is_finite: bool = False
    name: str | None = None

    def __post_init__(self):
        self._set(self.size)

    @cached_property
    def has_sparse_source(self) -> bool:
        return self.kind == SPARSE

    def _implicit(self):
        return 0.0 if self.kind == SPARSE else None

    def _finite(self):
        return self.is_finite

    def fields(self):
        return {"name": self.name, "storage": self.kind, "finite_values": self.is_finite}


@dataclass(frozen=True, eq=False)
class Unary(Expr):
    op: str
    x: Expr

    def __post_init__(self):
        self._set(self.x.shape)

    @property
    def children(self):
        return (self.x,)

    def _implicit(self):
        v = self.x.implicit
        return None if v is None else ieee.value(self.op, v)

    def fields(self):
        return {"op": self.op}


@dataclass(frozen=True, eq=False)
class ScalarBinary(Expr):
    op: str
    x: Expr
    scalar: float
    reverse: bool = False

    def __post_init__(self):
        self._set(self.x.shape)

    @property
    def children(self):
        return (self.x,)

    def _implicit(self):
        v = self.x.implicit
        if v is None:
            return None
        return ieee.value(self.op, *((self.scalar, v) if self.reverse else (v, self.scalar)))

    def fields(self):
        return {"op": self.op, "scalar": special(self.scalar), "reverse": self.reverse}


@dataclass(frozen=True, eq=False)
class Binary(Expr):
    op: str
    a: Expr
    b: Expr

    def __post_init__(self):
        if self.a.shape != self.b.shape:
            raise ValueError(f"shapes {self.a.shape} and {self.b.shape} differ")
        self._set(self.a.shape)

    @property
    def children(self):
        return (self.a, self.b)

    @cached_property
    def scaling(self) -> tuple[Expr, Broadcast] | None:
        """(sparse values, finite broadcast factor) where the product needs no row for an absent coordinate."""
        if self.op == "multiply":
            for values, factor in ((self.a, self.b), (self.b, self.a)):
                if values.storage == SPARSE and isinstance(factor, Broadcast) and factor.storage == DENSE and factor.finite:
                    return values, factor
        return None

    def _implicit(self):
        if self.scaling:
            return 0.0
        va, vb = self.a.implicit, self.b.implicit
        return None if va is None or vb is None else ieee.value(self.op, va, vb)

    def fields(self):
        return {"op": self.op}


@dataclass(frozen=True, eq=False)
class Transpose(Expr):
    x: Expr

    def __post_init__(self):
        self._set(self.x.shape[::-1])

    @property
    def children(self):
        return (self.x,)

    def _finite(self):
        return self.x.finite


@dataclass(frozen=True, eq=False)
class Broadcast(Expr):
    x: Expr
    size: tuple[int, int]

    def __post_init__(self):
        for a, b in zip(self.x.shape, self.size, strict=True):
            if a not in (1, b):
                raise ValueError(f"shape {self.x.shape} does not broadcast to {self.size}")
        self._set(self.size)

    @property
    def children(self):
        return (self.x,)

    def _finite(self):
        return self.x.finite

    def fields(self):
        return {"size": list(self.size)}


@dataclass(frozen=True, eq=False)
class Slice(Expr):
    """Rows and columns as (start, step, count)."""

    x: Expr
    rows: tuple[int, int, int]
    cols: tuple[int, int, int]

    def __post_init__(self):
        self._set((self.rows[2], self.cols[2]))

    @property
    def children(self):
        return (self.x,)

    def _finite(self):
        return self.x.finite

    def fields(self):
        return {"rows": list(self.rows), "cols": list(self.cols)}


@dataclass(frozen=True, eq=False)
class Gather(Expr):
    x: Expr
    axis: int
    selector: DataFrame
    count: int

    def __post_init__(self):
        self._set((self.count, self.x.shape[1]) if self.axis == 0 else (self.x.shape[0], self.count))

    @property
    def children(self):
        return (self.x,)

    def _finite(self):
        return self.x.finite

    def fields(self):
        return {"axis": self.axis, "count": self.count}


@dataclass(frozen=True, eq=False)
class MatMul(Expr):
    a: Expr
    b: Expr

    def __post_init__(self):
        if self.a.shape[1] != self.b.shape[0]:
            raise ValueError(f"matmul: inner dimensions of {self.a.shape} and {self.b.shape} differ")
        self._set((self.a.shape[0], self.b.shape[1]))

    @property
    def children(self):
        return (self.a, self.b)

    def _implicit(self):
        if self.a.shape[1] == 0 or SPARSE in (self.a.storage, self.b.storage):
            return 0.0
        return None


def special(v: float) -> Any:
    if math.isnan(v):
        return {"special_float": "nan"}
    if math.isinf(v):
        return {"special_float": "inf" if v > 0 else "-inf"}
    return {"special_float": "-0.0"} if v == 0 and math.copysign(1, v) < 0 else v


def postorder(root: Expr) -> list[Expr]:
    """Every node once, children first, without recursion."""
    out, seen, todo = [], set(), [(root, False)]
    while todo:
        node, done = todo.pop()
        if done:
            out.append(node)
        elif id(node) not in seen:
            seen.add(id(node))
            todo.append((node, True))
            todo += [(c, False) for c in reversed(node.children)]
    return out


def to_plan(root: Expr) -> dict[str, Any]:
    """The DAG as JSON-compatible data; a node used twice stands once."""
    number: dict[int, int] = {}
    nodes = []
    for n in postorder(root):
        number[id(n)] = len(nodes)
        nodes.append({"id": len(nodes), "kind": type(n).__name__, "shape": list(n.shape), "storage": n.storage, "inputs": [number[id(c)] for c in n.children], **n.fields()})
    return {"plan_version": 1, "root": number[id(root)], "nodes": nodes}
