"""NumPy's basic and one-axis advanced indexing."""

from __future__ import annotations

import operator

import numpy as np

from ..errors import UnsupportedError
from ..plans import expr as E
from .array import Matrix, Scalar, Vector


def index(m: Matrix, key):
    """x[key]: slices and integers of either axis, and integers in order or a mask on one axis."""
    keys = list(key) if isinstance(key, tuple) else [key]
    if any(k is None for k in keys):
        raise UnsupportedError("new axes are not supported")
    if any(isinstance(k, (bool, np.bool_)) for k in keys):
        raise UnsupportedError("scalar masks are not supported")
    dots = [n for n, k in enumerate(keys) if k is Ellipsis]
    if len(dots) > 1:
        raise IndexError("an index can have one ellipsis only")
    if dots:
        at = dots[0]
        keys[at : at + 1] = [slice(None)] * (3 - len(keys))
    if len(keys) > 2:
        raise IndexError("too many indices: a matrix has two dimensions")
    keys += [slice(None)] * (2 - len(keys))
    if any(np.ndim(k) > 1 for k in keys if not isinstance(k, slice)):
        raise UnsupportedError("selectors have one dimension")
    parts = [_part(k, n) for k, n in zip(keys, m.shape, strict=True)]
    if sum(isinstance(p, np.ndarray) for p in parts) > 1:
        raise UnsupportedError("one axis at a time can have a selector; use x[rows, :][:, cols]")
    cuts = [(p, 1, 1) if isinstance(p, int) else p if isinstance(p, tuple) else (0, 1, n) for p, n in zip(parts, m.shape, strict=True)]
    plan = m.expr
    if any(c != (0, 1, n) for c, n in zip(cuts, m.shape, strict=True)):
        plan = E.Slice(plan, *cuts)
    for axis, p in enumerate(parts):
        if isinstance(p, np.ndarray):
            plan = E.Gather(plan, axis, m.session.selector(p), len(p))
    single = [isinstance(p, int) for p in parts]
    m.session.guard(plan)
    if all(single):
        return Scalar(m.session, plan)
    if single[0]:
        return Vector(m.session, plan)
    if single[1]:
        return Vector(m.session, E.Transpose(plan))
    return Matrix._of(m.session, plan)


def _part(k, n: int):
    """An int, a cut (start, step, count), or an array of positions."""
    if isinstance(k, slice):
        r = range(*k.indices(n))
        return (r.start if len(r) else 0, r.step if len(r) > 1 else 1, len(r))
    if isinstance(k, (list, tuple, np.ndarray)) and np.ndim(k) == 1:
        a = np.asarray(k)
        if a.dtype == bool:
            if len(a) != n:
                raise IndexError(f"a mask of {len(a)} does not fit an axis of {n}")
            return np.flatnonzero(a).astype(np.int64)
        if a.size == 0:
            return np.zeros(0, np.int64)
        if a.dtype.kind not in "iu":
            raise IndexError("selectors hold integers or booleans")
        if a.min() < -n or a.max() >= n:
            raise IndexError(f"an index is out of bounds for an axis of {n}")
        a = a.astype(np.int64)
        return np.where(a < 0, a + n, a)
    try:
        at = operator.index(k)
    except TypeError:
        raise IndexError("indices are integers, slices, or sequences of integers or booleans") from None
    if not -n <= at < n:
        raise IndexError(f"index {at} is out of bounds for an axis of {n}")
    return at % n
