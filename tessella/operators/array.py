"""NumPy-shaped matrices, vectors and scalars over semantic plans."""

from __future__ import annotations

import json
import math
import operator
from numbers import Real
from typing import TYPE_CHECKING, Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DensifyError, SessionMismatchError, UnsupportedError
from ..plans import expr as E
from ..plans.lower import lower
from . import reduce as R

if TYPE_CHECKING:
    from ..sources.session import Session

UFUNC_UNARY = {getattr(np, n): n for n in "negative absolute sqrt exp expm1 log log1p log2 log10 sin cos tan arcsin arccos arctan sinh cosh tanh floor ceil trunc sign isnan".split()}
UFUNC_BINARY = {getattr(np, n): n for n in "add subtract multiply true_divide power greater greater_equal less less_equal equal not_equal".split()}
REDUCERS = {getattr(np, n): n for n in R.OPS} | {np.amin: "min", np.amax: "max"}


class Lazy:
    """What matrices, vectors and scalars share: a session, a plan, arithmetic and inspection."""

    __array_priority__ = 1000
    __hash__ = None

    def __init__(self, session: Session, plan: E.Expr):
        self.session, self.expr = session, plan

    dtype = np.dtype("float64")

    @property
    def storage(self) -> str:
        return self.expr.storage

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    def to_frame(self) -> DataFrame:
        """The coordinate rows (i, j, x), lazily."""
        self.session.check_open()
        return self.session.frame(self.expr)

    def plan(self) -> dict[str, Any]:
        """The semantic plan as JSON-compatible data."""
        return {**E.to_plan(self.expr), "result": {"rank": self.ndim, "shape": list(self.shape)}}

    def compile(self) -> str:
        """The optimised logical plan as text; nothing is run."""
        return self.to_frame()._jdf.queryExecution().optimizedPlan().toString()

    def explain(self) -> str:
        """Spark's physical plan as text."""
        return self.to_frame()._jdf.queryExecution().toString()

    def compute(self, name: str | None = None):
        """The result written to the session's folder, as a new source of the same rank; not proved finite."""
        return type(self)._of(self.session, self.session.written(self.expr, name))

    def __bool__(self) -> bool:
        raise ValueError("the truth value of a lazy array is ambiguous; use any() or all()")

    def __repr__(self) -> str:
        return f"{type(self).__name__}(shape={self.shape}, storage={self.storage!r})"

    @classmethod
    def _of(cls, session, plan):
        return cls(session, plan)

    def _unary(self, op: str):
        return self._wrap(E.Unary(op, self.expr))

    def _wrap(self, plan: E.Expr):
        self.session.guard(plan)
        return self._of(self.session, plan)

    def _binary(self, op: str, other: Any, reverse: bool = False):
        if isinstance(other, (Real, np.bool_)) and not isinstance(other, Lazy):
            return self._wrap(E.ScalarBinary(op, self.expr, float(other), reverse))
        if not isinstance(other, Lazy) and np.iscomplexobj(other):
            raise UnsupportedError("complex values are not supported")
        if not isinstance(other, Lazy):
            if not isinstance(other, (np.ndarray, list, tuple)):
                return NotImplemented
            other = self.session.operand(other)
            if not isinstance(other, Lazy):
                return self._binary(op, other, reverse)
        if other.session is not self.session:
            raise SessionMismatchError("operands belong to different sessions")
        a, b = (other, self) if reverse else (self, other)
        shape = np.broadcast_shapes(a.expr.shape, b.expr.shape)
        x, y = (v.expr if v.expr.shape == shape else E.Broadcast(v.expr, shape) for v in (a, b))
        plan = E.Binary(op, x, y)
        for v in (x, y):  # a dense operand that expands
            if isinstance(v, E.Broadcast) and v.storage == E.DENSE and not plan.scaling:
                self.session.guard_cells(v.shape)
        self.session.guard(plan)
        return most_ranked(a, b)._of(self.session, plan)

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        if method != "__call__" or any(v is not None and not (isinstance(v, tuple) and all(x is None for x in v)) for v in kwargs.values()):
            return NotImplemented
        if ufunc in UFUNC_UNARY:
            return self._unary(UFUNC_UNARY[ufunc])
        if ufunc is np.matmul:
            return inputs[0] @ inputs[1] if isinstance(inputs[0], Lazy) else inputs[1].__rmatmul__(inputs[0])
        if ufunc in UFUNC_BINARY:
            a, b = inputs
            return a._binary(UFUNC_BINARY[ufunc], b) if isinstance(a, Lazy) else b._binary(UFUNC_BINARY[ufunc], a, True)
        return NotImplemented


def most_ranked(a: Lazy, b: Lazy) -> type[Lazy]:
    for kind in (Matrix, Vector, Scalar):
        if isinstance(a, kind) or isinstance(b, kind):
            return kind
    raise TypeError


def _method(op: str, reverse: bool = False):
    return lambda self, other: self._binary(op, other, reverse)


for _name, _op in {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "true_divide", "pow": "power"}.items():
    setattr(Lazy, f"__{_name}__", _method(_op))
    setattr(Lazy, f"__r{_name}__", _method(_op, True))
for _name, _op in {"gt": "greater", "ge": "greater_equal", "lt": "less", "le": "less_equal", "eq": "equal", "ne": "not_equal"}.items():
    setattr(Lazy, f"__{_name}__", _method(_op))
for _op in UFUNC_UNARY.values():
    setattr(Lazy, _op, (lambda op: lambda self: self._unary(op))(_op))
Lazy.__neg__ = Lazy.negative
Lazy.__abs__ = Lazy.absolute


class Matrix(Lazy):
    """A lazy two-dimensional matrix."""

    @classmethod
    def _of(cls, session, plan):
        return (SparseMatrix if plan.storage == E.SPARSE else DenseMatrix)(session, plan)

    @property
    def shape(self) -> tuple[int, int]:
        return self.expr.shape

    def __len__(self) -> int:
        return self.shape[0]

    @property
    def T(self) -> Matrix:
        return self._wrap(self.expr.x if isinstance(self.expr, E.Transpose) else E.Transpose(self.expr))

    def transpose(self, *axes) -> Matrix:
        if len(axes) == 1 and (axes[0] is None or isinstance(axes[0], (tuple, list))):
            axes = axes[0]
        if axes is None or len(axes) == 0:
            return self.T
        axes = tuple(operator.index(a) % 2 if -2 <= operator.index(a) < 2 else 9 for a in axes)
        if sorted(axes) != [0, 1]:
            raise ValueError("transpose takes the axes 0 and 1, each once")
        return self.T if axes == (1, 0) else self

    def _matmul(self, other: Any, reverse: bool):
        if not isinstance(other, Lazy):
            if np.ndim(other) != 2:
                raise UnsupportedError("matmul takes two-dimensional operands")
            other = self.session.operand(other)
        if not isinstance(other, Matrix):
            raise UnsupportedError("matmul takes two-dimensional operands")
        if other.session is not self.session:
            raise SessionMismatchError("operands belong to different sessions")
        a, b = (other, self) if reverse else (self, other)
        return self._wrap(E.MatMul(a.expr, b.expr))

    def __matmul__(self, other):
        return self._matmul(other, False)

    def __rmatmul__(self, other):
        return self._matmul(other, True)

    def __getitem__(self, key):
        from .indexing import index

        return index(self, key)

    def take(self, indices, axis=None, out=None, mode="raise"):
        if axis is None or out is not None or mode != "raise":
            raise UnsupportedError("take needs an axis, and neither out nor another mode")
        axis = _axis(axis)
        return self[indices, :] if axis == 0 else self[:, indices]

    def to_numpy(self) -> np.ndarray:
        """A dense host array; coordinates are checked."""
        self.session.guard_cells(self.shape)
        i, j, x = collected(self.to_frame())
        out = np.full(self.shape, 0.0 if self.expr.implicit is None else self.expr.implicit)
        if len(i):
            if i.min() < 0 or j.min() < 0 or i.max() >= self.shape[0] or j.max() >= self.shape[1]:
                raise ValueError("a coordinate lies outside the shape")
            if len(np.unique(i * self.shape[1] + j)) != len(i):
                raise ValueError("a coordinate occurs twice")
        if self.storage == E.DENSE and len(i) != self.size:
            raise ValueError("a dense matrix lacks coordinates")
        out[i, j] = x
        return out

    toarray = to_numpy

    def __array__(self, dtype=None, copy=None):
        return self.to_numpy().astype(dtype or float, copy=False)

    def to_coo(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value arrays without zeros, up to the session's limit."""
        most = self.session.max_sparse_host_values
        i, j, x = collected(self.to_frame().limit(most + 1))
        if len(i) > most:
            raise DensifyError(f"the result has over {most} rows")
        return i[x != 0], j[x != 0], x[x != 0]

    def to_scipy(self, format: str = "csr"):
        import scipy.sparse

        i, j, x = self.to_coo()
        return scipy.sparse.coo_matrix((x, (i, j)), shape=self.shape).asformat(format)

    def show(self, edgeitems: int = 5) -> None:
        """Prints the corners; only edge coordinates are queried."""
        print(self.preview(edgeitems))

    def preview(self, edgeitems: int = 5) -> str:
        edges = [list(range(n)) if n <= 2 * edgeitems else [*range(edgeitems), *range(n - edgeitems, n)] for n in self.shape]
        near = [F.lit(True) if n <= 2 * edgeitems else (F.col(c) < edgeitems) | (F.col(c) >= n - edgeitems) for c, n in zip("ij", self.shape, strict=True)]
        cells = len(edges[0]) * len(edges[1])
        i, j, x = collected(self.to_frame().filter(near[0] & near[1]).limit(cells + 1))
        if len(i) > cells:
            raise ValueError("a coordinate occurs twice")
        out = np.full((len(edges[0]), len(edges[1])), 0.0 if self.expr.implicit is None else self.expr.implicit)
        out[np.searchsorted(edges[0], i), np.searchsorted(edges[1], j)] = x
        text = [[np.format_float_positional(v, precision=8, trim="0") if np.isfinite(v) and 1e-4 <= abs(v) < 1e16 or v == 0 else str(v) for v in row] for row in out]
        wide = max((len(v) for row in text for v in row), default=1)
        lines = []
        for k, row in enumerate(text):
            if k == edgeitems and len(edges[0]) < self.shape[0]:
                lines.append("...")
            part = [v.rjust(wide) for v in row]
            if len(edges[1]) < self.shape[1]:
                part.insert(edgeitems, "...")
            lines.append("[" + " ".join(part) + "]")
        return "\n".join(lines)

    def reduce(self, op: str, axis=None, dtype=None, out=None, ddof=0, keepdims=False, initial=None, where=True, correction=None, mean=None):
        """Runs a reduction and returns host values."""
        if out is not None or initial is not None or mean is not None or (dtype is not None and np.dtype(dtype) != np.float64):
            raise UnsupportedError("out, initial, mean and other dtypes are not supported")
        if np.ndim(where) or not where:
            raise UnsupportedError("masked reductions are not supported")
        if isinstance(keepdims, np.bool_):
            raise TypeError("keepdims must be an integer or bool")
        keepdims, axis = bool(operator.index(keepdims)), None if axis is None else _axis(axis)
        ddof = correction if correction is not None else ddof
        if not isinstance(ddof, Real) or not math.isfinite(ddof) or ddof < 0:
            raise ValueError("ddof must be finite and not negative")
        n = R.cells(self.expr, axis)
        if n == 0 and ("min" in op or "max" in op):
            raise ValueError("zero-size array to reduction operation without identity")
        self.session.check_open()
        kind = bool if op in ("any", "all") else float
        if axis is None:
            row = R.reduced(self.expr, op, None, ddof).first()
            value = R.missing(op, n, ddof) if row is None or row["value"] is None else row["value"]
            if op == "sum" and row["value"] is None:
                value = 0.0
            return np.full((1, 1), value) if keepdims else np.bool_(value) if kind is bool else np.float64(value)
        size = self.shape[1 - axis]
        if size > self.session.max_host_values:
            raise DensifyError(f"the result has over {self.session.max_host_values} values")
        found = R.reduced(self.expr, op, axis, ddof).toArrow()
        values = np.full(size, R.missing(op, n, ddof), kind)
        values[found["index"].to_numpy()] = found["value"].to_numpy(zero_copy_only=False)
        return np.expand_dims(values, axis) if keepdims else values

    def reduced_frame(self, op: str, axis: int, ddof: float = 0.0) -> DataFrame:
        """(index, value) of a reduction as a lazy DataFrame."""
        return R.reduced_frame(self.expr, op, _axis(axis), ddof)

    def __array_function__(self, func, types, args, kwargs):
        if func in REDUCERS:
            return self.reduce(REDUCERS[func], *args[1:], **kwargs)
        if func is np.transpose:
            return self.transpose(*args[1:], *kwargs.values())
        if func is np.take:
            return self.take(*args[1:], **kwargs)
        return NotImplemented


for _op in R.OPS:
    setattr(Matrix, _op, (lambda op: lambda self, *a, **k: self.reduce(op, *a, **k))(_op))
Matrix.asin, Matrix.acos, Matrix.atan = Matrix.arcsin, Matrix.arccos, Matrix.arctan


class DenseMatrix(Matrix):
    """Every coordinate has a row."""


class SparseMatrix(Matrix):
    """A coordinate without a row holds zero."""


class Vector(Lazy):
    """A lazy vector; its plan is a matrix of one row."""

    @property
    def shape(self) -> tuple[int]:
        return (self.expr.shape[1],)

    def __len__(self) -> int:
        return self.shape[0]

    def _matrix(self) -> Matrix:
        return Matrix._of(self.session, self.expr)

    def to_numpy(self) -> np.ndarray:
        if self.shape[0] > self.session.max_host_values:
            raise DensifyError(f"the result has over {self.session.max_host_values} values")
        _, j, x = collected(self.to_frame())
        out = np.full(self.shape, 0.0 if self.expr.implicit is None else self.expr.implicit)
        out[j] = x
        return out

    toarray = to_numpy

    def __array__(self, dtype=None, copy=None):
        return self.to_numpy().astype(dtype or float, copy=False)

    def sum(self, axis=None, dtype=None, out=None, keepdims=False, initial=None, where=True):
        return self._reduce("sum", axis, dtype, out, keepdims, initial, where)

    def mean(self, axis=None, dtype=None, out=None, keepdims=False, where=True):
        return self._reduce("mean", axis, dtype, out, keepdims, None, where)

    def _reduce(self, op, axis, dtype, out, keepdims, initial, where):
        if axis not in (None, 0, -1):
            raise ValueError(f"axis {axis} is out of bounds for a vector")
        value = self._matrix().reduce(op, None, dtype, out, initial=initial, where=where)
        return np.full(1, value) if keepdims else value

    def __array_function__(self, func, types, args, kwargs):
        if func is np.transpose and len(args) == 1 and not kwargs:
            return self
        if func in (np.sum, np.mean):
            return (self.sum if func is np.sum else self.mean)(*args[1:], **kwargs)
        return NotImplemented

    @property
    def T(self) -> Vector:
        return self


class Scalar(Lazy):
    """A lazy scalar; its plan is a matrix of one cell."""

    shape = ()

    def item(self) -> float:
        row = self.to_frame().select("x").first()
        if row is None:
            return 0.0 if self.expr.implicit is None else self.expr.implicit
        return math.nan if row["x"] is None else row["x"]

    def to_numpy(self) -> np.ndarray:
        return np.array(self.item())

    def __array__(self, dtype=None, copy=None):
        return self.to_numpy().astype(dtype or float, copy=False)

    def __float__(self) -> float:
        return self.item()

    def __array_function__(self, func, types, args, kwargs):
        if func is np.transpose and len(args) == 1 and not kwargs:
            return self
        return NotImplemented


def _axis(axis) -> int:
    if isinstance(axis, (tuple, list)):
        raise UnsupportedError("tuple axes are not supported")
    axis = operator.index(axis)
    if not -2 <= axis < 2:
        raise np.exceptions.AxisError(axis, 2)
    return axis % 2


def collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = df.select("i", "j", "x").toArrow()
    return t["i"].to_numpy(), t["j"].to_numpy(), t["x"].to_numpy(zero_copy_only=False).astype(float)


def plan_json(x: Lazy) -> str:
    return json.dumps(x.plan(), allow_nan=False)
