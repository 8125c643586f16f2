"""Errors of the matrix library."""


class MatrixError(Exception):
    """Base of the library's own errors."""


class SessionMismatchError(MatrixError, ValueError):
    """Operands belong to different sessions."""


class DensifyError(MatrixError, MemoryError):
    """A result would hold more cells than the session allows."""


class UnsupportedError(MatrixError, NotImplementedError):
    """NumPy offers this; the library does not."""
