"""The session: inputs, limits, and what it made and has to remove."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DensifyError, UnsupportedError
from ..operators.array import Matrix, Scalar, Vector
from ..operators.reduce import OPS
from ..plans import expr as E
from ..plans.lower import lower
from .mtx import entries, read_matrix_market_header

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:/")
SCHEMA = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("x", T.DoubleType())])


@dataclass(frozen=True)
class Capabilities:
    """What a session can run."""

    name: str = "spark"
    nodes: frozenset[str] = frozenset({"Source", "Unary", "ScalarBinary", "Binary", "Transpose", "Broadcast", "Slice", "Gather", "MatMul"})
    reductions: frozenset[str] = frozenset(OPS)
    parquet: bool = True
    matrix_market: bool = True
    spill: bool = True


class Session:
    """Makes matrices over a SparkSession that it borrows; close() removes its own files and views, not Spark."""

    capabilities = Capabilities()

    def __init__(self, spark: SparkSession, *, max_densify_cells: int = 5_000_000, max_host_values: int = 50_000_000, max_sparse_host_values: int = 5_000_000, max_selector_values: int = 5_000_000, max_selector_relations: int = 256, temp_directory: str | None = None):
        limits = dict(max_densify_cells=max_densify_cells, max_host_values=max_host_values, max_sparse_host_values=max_sparse_host_values, max_selector_values=max_selector_values, max_selector_relations=max_selector_relations)
        for k, v in limits.items():
            if isinstance(v, bool) or not isinstance(v, int) or v < 0:
                raise ValueError(f"{k} must be an integer of 0 or more")
            setattr(self, k, v)
        self.spark, self.temp_directory = spark, temp_directory
        self._selectors: dict[str, tuple[DataFrame, int]] = {}
        self._frames: dict[int, tuple[E.Expr, DataFrame]] = {}
        self._names: dict[str, str] = {}
        self._folders: list[str] = []
        self._closed = False

    @classmethod
    def connect(cls, master: str = "local[*]", config: dict[str, str] | None = None, **limits) -> Session:
        """A session over the running SparkSession, or a new one."""
        builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
        if SparkSession.getActiveSession() is None:
            builder = builder.master(master)
        return cls(builder.config(map=config or {}).getOrCreate(), **limits)

    def __enter__(self) -> Session:
        self.check_open()
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if not self._closed:
            self._closed = True
            self._selectors.clear()
            self._frames.clear()
            for name, kind in self._names.items():
                if kind != "table":
                    self.spark.catalog.dropTempView(name)
            for folder in self._folders:
                self._remove(folder)

    def _remove(self, folder: str) -> None:
        """Deletes a folder of any store that Spark writes to."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def check_open(self) -> None:
        if self._closed:
            raise RuntimeError("the session is closed")

    # limits

    def guard_cells(self, shape: tuple[int, int]) -> None:
        if shape[0] * shape[1] > self.max_densify_cells:
            raise DensifyError(f"{shape[0]} x {shape[1]} cells exceed max_densify_cells={self.max_densify_cells}")

    def guard(self, plan: E.Expr) -> None:
        """A dense result over a sparse source must fit the limit."""
        self.check_open()
        if plan.storage == E.DENSE and plan.has_sparse_source:
            self.guard_cells(plan.shape)

    def frame(self, plan: E.Expr) -> DataFrame:
        """The DataFrame of a plan, kept for the last 256 plans."""
        if id(plan) not in self._frames:
            if len(self._frames) >= 256:
                self._frames.pop(next(iter(self._frames)))
            self._frames[id(plan)] = (plan, lower(plan))
        return self._frames[id(plan)][1]

    # inputs

    def _name(self, name: str | None, overwrite: bool = False) -> str:
        name = name or f"m_{uuid.uuid4().hex[:12]}"
        if not NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no relation name")
        if not overwrite and (name in self._names or self.spark.catalog.tableExists(name)):
            raise ValueError(f"relation {name!r} exists")
        return name

    def _source(self, df: DataFrame, shape, kind: str, finite: bool, name: str | None) -> Matrix:
        self.check_open()
        named = self._name(name) if name else None
        if named:
            df.createOrReplaceTempView(named)
            self._names[named] = "made"
        return Matrix._of(self, E.Source(df, _shape(shape), kind, finite, named))

    def _local(self, i, j, x) -> DataFrame:
        return self.spark.createDataFrame(pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "x": pa.array(x, pa.float64())}), SCHEMA)

    def from_numpy(self, values: Any, *, name: str | None = None) -> Matrix:
        """A dense matrix from a copy of a two-dimensional numeric or Boolean array."""
        self.check_open()
        if np.iscomplexobj(values):
            raise UnsupportedError("complex values are not supported")
        a = np.array(values)
        if a.ndim != 2 or a.dtype.kind not in "biuf":
            raise ValueError("a two-dimensional numeric array is needed")
        a = a.astype(np.float64)
        self.guard_cells(a.shape)
        i, j = np.indices(a.shape)
        return self._source(self._local(i.ravel(), j.ravel(), a.ravel()), a.shape, E.DENSE, bool(np.isfinite(a).all()), name)

    def from_coo(self, row: Any, col: Any, data: Any, *, shape: tuple[int, int], name: str | None = None) -> Matrix:
        """A sparse matrix from coordinates and values; zeros go, duplicates raise."""
        self.check_open()
        shape = _shape(shape)
        if np.iscomplexobj(data):
            raise UnsupportedError("complex values are not supported")
        row, col, data = np.asarray(row), np.asarray(col), np.asarray(data)
        if not row.ndim == col.ndim == data.ndim == 1 or not len(row) == len(col) == len(data):
            raise ValueError("row, col and data must be one-dimensional and of one length")
        for c in (row, col):
            if c.size and c.dtype.kind not in "iu":
                raise TypeError("coordinates must be integers")
        row, col, data = row.astype(np.int64), col.astype(np.int64), data.astype(np.float64)
        if len(row) and (row.min() < 0 or col.min() < 0 or row.max() >= shape[0] or col.max() >= shape[1]):
            raise IndexError("a coordinate lies outside the shape")
        if len(np.unique(np.stack([row, col]), axis=1).T) != len(row):
            raise ValueError("a coordinate occurs twice")
        keep = data != 0
        return self._source(self._local(row[keep], col[keep], data[keep]), shape, E.SPARSE, bool(np.isfinite(data).all()), name)

    def from_scipy(self, values: Any, *, name: str | None = None) -> Matrix:
        """A sparse matrix from a SciPy one; duplicates are summed, zeros go."""
        c = values.tocoo(copy=True)
        c.sum_duplicates()
        c.eliminate_zeros()
        return self.from_coo(c.row, c.col, c.data, shape=c.shape, name=name)

    def from_relation(self, relation: str | DataFrame, *, shape: tuple[int, int], storage: str = E.SPARSE) -> Matrix:
        """Wraps a table, view or DataFrame (i, j, x) without reading it; the caller answers for bounds and uniqueness."""
        self.check_open()
        df = self.spark.table(relation) if isinstance(relation, str) else relation
        return self._source(_checked(df), shape, _storage(storage), False, None)

    from_dataframe = from_relation

    def from_parquet(self, paths: str | Path | list, *, shape: tuple[int, int], storage: str = E.SPARSE, name: str | None = None) -> Matrix:
        """A lazy scan of coordinate files of any integer and number types; paths of remote stores are left to Spark."""
        self.check_open()
        paths = [str(p) for p in ([paths] if isinstance(paths, (str, Path)) else paths)]
        if not paths or len(set(paths)) != len(paths):
            raise ValueError("paths must be given once each, one at least")
        for p in paths:
            if not SCHEME.match(p) and not Path(p).exists():
                raise FileNotFoundError(p)
        frames = [_checked(self.spark.read.parquet(p)) for p in paths]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return self._source(out, shape, _storage(storage), False, name)

    def from_mtx(self, path: str | Path, *, name: str | None = None, temporary: bool = False, overwrite: bool = False, assume_canonical: bool = False) -> Matrix:
        """A sparse matrix from a Matrix Market file, checked as a whole and written before it gets its name.

        A named file becomes a table of Spark's catalog, which outlives the session, unless it is `temporary`; a temporary or
        unnamed one goes with the session. `overwrite` replaces only what this method loaded in this session, and what
        was there stays if the new file is rejected; matrices made from that name before read the new rows from then on.
        """
        self.check_open()
        named = self._name(name, overwrite)
        known = self._names.get(named)
        if known not in (None, "table", "loaded") or known is None and self.spark.catalog.tableExists(named):
            raise ValueError(f"{named!r} is not a file loaded by this session and cannot be overwritten")
        head = read_matrix_market_header(path)
        shape = _shape((head.rows, head.columns))
        df = self._write(entries(self.spark, path, head, assume_canonical))
        kind = "loaded" if temporary or name is None else "table"
        if known and known != kind:
            (self.spark.catalog.dropTempView if known == "loaded" else lambda t: self.spark.sql(f"DROP TABLE `{t}`"))(named)
        if kind == "table":
            df.write.mode("overwrite").saveAsTable(named)
            self._remove(self._folders.pop())
        else:
            df.createOrReplaceTempView(named)
        self._names[named] = kind
        self._frames.clear()  # plans over the name are lowered anew
        return Matrix._of(self, E.Source(lambda: self.spark.table(named), shape, E.SPARSE, False, named))

    def operand(self, values: Any):
        """A host array in an expression: a matrix, or a vector along the columns."""
        a = np.asarray(values)
        if a.ndim == 0:
            return float(a)
        if a.ndim == 1:
            return Vector(self, self.from_numpy(a[None, :]).expr)
        if a.ndim != 2:
            raise UnsupportedError("operands have two dimensions at most")
        return self.from_numpy(a)

    def selector(self, positions: np.ndarray) -> DataFrame:
        """(source_index, output_index), kept by content."""
        self.check_open()
        digest = hashlib.sha256(np.ascontiguousarray(positions, np.int64).tobytes()).hexdigest()
        if digest not in self._selectors:
            held = sum(n for _, n in self._selectors.values())
            if held + len(positions) > self.max_selector_values or len(self._selectors) >= self.max_selector_relations:
                raise DensifyError("selectors exceed max_selector_values or max_selector_relations")
            df = self.spark.createDataFrame(pa.table({"source_index": pa.array(positions, pa.int64()), "output_index": pa.array(np.arange(len(positions)), pa.int64())}))
            self._selectors[digest] = (df, len(positions))
        return self._selectors[digest][0]

    # results

    def _folder(self) -> str:
        shared = self.temp_directory or self.spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            known = self.spark.sparkContext._jsc.sc().getCheckpointDir()
            shared = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="tessella-")  # local mode only
        return f"{shared.rstrip('/')}/tessella-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame) -> DataFrame:
        folder = self._folder()
        self._folders.append(folder)
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def stored(self, df: DataFrame) -> DataFrame:
        """`df` written to the session's folder and read again."""
        self.check_open()
        return self._write(df)

    def written(self, plan: E.Expr, name: str | None = None) -> E.Source:
        self.check_open()
        named = self._name(name) if name else None
        df = self._write(self.frame(plan))
        if named:
            df.createOrReplaceTempView(named)
            self._names[named] = "made"
        if plan.storage == E.SPARSE and np.signbit(plan.implicit):
            return E.Unary("negative", E.Source(df.withColumn("x", -F.col("x")), plan.shape, plan.storage, False, named))
        return E.Source(df, plan.shape, plan.storage, False, named)


def _shape(shape) -> tuple[int, int]:
    if len(shape) != 2:
        raise ValueError("a shape has two dimensions")
    for n in shape:
        if isinstance(n, bool) or not isinstance(n, (int, np.integer)) or not 0 <= n < 2**63:
            raise ValueError("dimensions are integers from 0 to 2**63 - 1")
    return int(shape[0]), int(shape[1])


def _storage(storage: str) -> str:
    if storage not in (E.DENSE, E.SPARSE):
        raise ValueError("storage is 'dense' or 'sparse'")
    return storage


def _checked(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    if set(kinds) != {"i", "j", "x"}:
        raise ValueError("a relation has the columns i, j and x")
    whole = ("tinyint", "smallint", "int", "bigint")
    if kinds["i"] not in whole or kinds["j"] not in whole or kinds["x"] not in (*whole, "float", "double"):
        raise TypeError("i and j must be integers and x a number")
    return df.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("x").cast("double"))


__all__ = ["Capabilities", "Scalar", "Session"]
