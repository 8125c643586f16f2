"""Spark-native analytics over matrices stored as coordinate tables."""

from .errors import DensifyError, MatrixError, SessionMismatchError, UnsupportedError
from .operators.array import DenseMatrix, Matrix, Scalar, SparseMatrix, Vector
from .sources.mtx import MatrixMarketHeader, read_matrix_market_header
from .sources.session import Capabilities, Session

__all__ = ["Capabilities", "DenseMatrix", "DensifyError", "Matrix", "MatrixError", "MatrixMarketHeader", "Scalar", "Session", "SessionMismatchError", "SparseMatrix", "UnsupportedError", "Vector", "read_matrix_market_header"]
