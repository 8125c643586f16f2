"""Further queries with DuckDB SQL: IEEE edges, NULLs, inputs and sinks, indexing forms, options, guards and errors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import errors
from .functions import ieee
from .operators.array import Lazy, Matrix
from .operators.reduce import OPS, reduced
from .queries import _EVENTS, _GRID, _QTY, _query, _table, activity, quantity
from .sources.session import Session
from .workflow import normalize_frame, preprocess

#: Where the functions of ieee.py change their rule, with both signs; NaN; and NULL, which a source reads as NaN.
BOUNDS = [0.0, 2.0**-40, 0.25, 1.0, 1.5, 3.0, math.inf]
LATTICE: list[float | None] = [*BOUNDS, *(-b for b in BOUNDS), math.nan, None]
DIGITS = 9


def _sql(v: float | None) -> str:
    return "NULL::DOUBLE" if v is None else f"'{v!r}'::DOUBLE"


_VALUES = ", ".join(f"({k}, {_sql(v)})" for k, v in enumerate(LATTICE))
_LATTICE = f"SELECT k, coalesce(x, 'nan'::DOUBLE) AS x FROM (VALUES {_VALUES}) v(k, x)"


def _told(df: DataFrame, value: str = "x") -> DataFrame:
    """The value as a rounded finite number and its kind; a zero's kind says its sign."""
    v = F.col(value)
    kind = F.when(F.isnan(v), "nan").when(v == math.inf, "inf").when(v == -math.inf, "-inf").when((v == 0) & ieee.negative_zero(v), "-0").otherwise("number")
    return df.withColumn("kind", kind).withColumn(value, F.when(F.col("kind") == "number", F.round(v, DIGITS) + 0.0).otherwise(0.0))


def _told_sql(sql: str, value: str = "x") -> str:
    return f"""SELECT * REPLACE (CASE WHEN isfinite({value}) THEN round({value}, {DIGITS}) + 0.0 ELSE 0.0 END AS {value}),
      CASE WHEN isnan({value}) THEN 'nan' WHEN {value} = 'inf'::DOUBLE THEN 'inf' WHEN {value} = '-inf'::DOUBLE THEN '-inf'
           WHEN {value} = 0 AND signbit({value}) THEN '-0' ELSE 'number' END AS kind FROM ({sql})"""


def _relation(s: Session, cells: list[tuple[int, int, float | None]], shape: tuple[int, int], storage: str) -> Matrix:
    return s.from_relation(s.spark.createDataFrame(cells, "i long, j long, x double"), shape=shape, storage=storage)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lattice(s: Session, storage: str = "dense") -> Matrix:
    return _relation(s, [(0, k, v) for k, v in enumerate(LATTICE)], (1, len(LATTICE)), storage)


_KEEP_ZERO = "CASE WHEN x = 0 THEN x ELSE {} END"
_UNARY = {
    "negative": "-x", "absolute": "abs(x)", "sqrt": "sqrt(x)", "exp": "exp(x)", "expm1": _KEEP_ZERO.format("exp(x) - 1"), "log": "ln(x)",
    "log1p": _KEEP_ZERO.format("ln(1 + x)"), "log2": "log2(x)", "log10": "log10(x)", "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)",
    "arcsin": "asin(x)", "arccos": "acos(x)", "arctan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)",
    "floor": "floor(x)", "ceil": "ceil(x)", "trunc": "trunc(x)", "sign": "CASE WHEN isnan(x) THEN x WHEN x = 0 THEN 0 ELSE sign(x) END", "isnan": "isnan(x)::INT",
}


@_query("edges_unary", _told_sql(" UNION ALL ".join(f"SELECT '{op}' AS op, k, ({e})::DOUBLE AS x FROM ({_LATTICE})" for op, e in _UNARY.items())))
def edges_unary(spark, d):
    m = _lattice(Session(spark))
    return _told(_union([m._unary(op).to_frame().select(F.lit(op).alias("op"), F.col("j").alias("k"), "x") for op in _UNARY]))


_BOTH = "NOT isnan(x) AND NOT isnan(y) AND x {} y"
_BINARY = {
    "add": "x + y", "subtract": "x - y", "multiply": "x * y", "true_divide": "x / y", "power": "pow(x, y)",
    "greater": _BOTH.format(">"), "greater_equal": _BOTH.format(">="), "less": _BOTH.format("<"), "less_equal": _BOTH.format("<="),
    "equal": _BOTH.format("="), "not_equal": "isnan(x) OR isnan(y) OR x <> y",
}
_NUMBER = "({})::INT::DOUBLE"
_PAIRS = f"SELECT a.k AS i, b.k AS j, a.x AS x, b.x AS y FROM ({_LATTICE}) a, ({_LATTICE}) b"


def _as_double(op: str, e: str) -> str:
    return e if op in ("add", "subtract", "multiply", "true_divide", "power") else _NUMBER.format(e)


@_query("edges_binary", _told_sql(" UNION ALL ".join(f"SELECT '{op}' AS op, i, j, {_as_double(op, e)} AS x FROM ({_PAIRS})" for op, e in _BINARY.items())))
def edges_binary(spark, d):
    s, n = Session(spark), len(LATTICE)
    left = _relation(s, [(i, j, LATTICE[i]) for i in range(n) for j in range(n)], (n, n), "dense")
    right = _relation(s, [(i, j, LATTICE[j]) for i in range(n) for j in range(n)], (n, n), "dense")
    return _told(_union([left._binary(op, right).to_frame().select(F.lit(op).alias("op"), "i", "j", "x") for op in _BINARY]))


@_query("edges_scalar", _told_sql(" UNION ALL ".join(f"SELECT '{op}' AS op, i, j, {_as_double(op, e)} AS x FROM ({_PAIRS}) WHERE i IN (0, 3, 7, 10, 14)" for op, e in _BINARY.items())))
def edges_scalar(spark, d):
    m = _lattice(Session(spark))
    parts = []
    for op in _BINARY:
        for i in (0, 3, 7, 10, 14):  # 0.0, 1.0, -0.0, -1.0, NaN on the left
            parts.append(m._binary(op, LATTICE[i], True).to_frame().select(F.lit(op).alias("op"), F.lit(i).alias("i"), "j", "x"))
    return _told(_union(parts))


#: A sparse 5 x 6 matrix: absent cells, signed zeros, infinities, NaN, NULL, a column of one sign and an empty one.
CELLS: list[tuple[int, int, float | None]] = [
    (0, 0, 1.5), (1, 0, -0.0), (2, 0, math.inf), (0, 1, -2.0), (1, 1, -3.25), (2, 1, -1.0), (3, 1, -4.0), (4, 1, -0.5),
    (0, 2, math.nan), (3, 2, 2.0), (1, 3, None), (2, 3, 6.0), (4, 3, 0.125), (3, 4, math.inf), (4, 4, -math.inf),
]
_CELLS = "SELECT r.range AS i, c.range AS j, coalesce(v.x, CASE WHEN v.i IS NULL THEN 0 ELSE 'nan'::DOUBLE END) AS x FROM range(5) r CROSS JOIN range(6) c LEFT JOIN (VALUES " + ", ".join(f"({i}, {j}, {_sql(x)})" for i, j, x in CELLS) + ") v(i, j, x) ON v.i = r.range AND v.j = c.range"
_V, _W = "CASE WHEN isnan(x) THEN NULL ELSE x END", "CASE WHEN isfinite(x) THEN x END"
_NAN = "'nan'::DOUBLE"
_BAD, _INF = "bool_or(isnan(x))", "bool_or(isinf(x))"
_REDUCE = {
    "sum": "sum(x)", "mean": "sum(x) / count(*)", "nansum": f"coalesce(sum({_V}), 0)", "nanmean": f"coalesce(sum({_V}) / count({_V}), {_NAN})",
    "var": f"CASE WHEN {_BAD} OR {_INF} THEN {_NAN} ELSE var_pop({_W}) END", "std": f"CASE WHEN {_BAD} OR {_INF} THEN {_NAN} ELSE stddev_pop({_W}) END",
    "nanvar": f"CASE WHEN {_INF} THEN {_NAN} ELSE coalesce(var_pop({_W}), {_NAN}) END", "nanstd": f"CASE WHEN {_INF} THEN {_NAN} ELSE coalesce(stddev_pop({_W}), {_NAN}) END",
    "min": f"CASE WHEN {_BAD} THEN {_NAN} ELSE min({_V}) END", "max": f"CASE WHEN {_BAD} THEN {_NAN} ELSE max({_V}) END",
    "nanmin": f"coalesce(min({_V}), {_NAN})", "nanmax": f"coalesce(max({_V}), {_NAN})",
    "any": "bool_or(isnan(x) OR x <> 0)::INT", "all": "bool_and(isnan(x) OR x <> 0)::INT",
}


def _reduced_sql(group: str, key: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{op}' AS op, {key} AS index, (({e}) + 0.0)::DOUBLE AS value FROM ({_CELLS}) {group}" for op, e in _REDUCE.items())
    return _told_sql(parts, "value")


def _reductions(spark: SparkSession, frame: Callable[[Matrix, str], DataFrame]) -> DataFrame:
    m = _relation(Session(spark), CELLS, (5, 6), "sparse")
    value = F.col("value").cast("double") + 0.0
    return _told(_union([frame(m, op).select(F.lit(op).alias("op"), "index", value.alias("value")) for op in OPS]), "value")


for _axis, _key in ((0, "j"), (1, "i")):
    _query(f"edges_reduce_axis{_axis}", _reduced_sql("GROUP BY 2", _key))(lambda spark, d, axis=_axis: _reductions(spark, lambda m, op: m.reduced_frame(op, axis)))
_query("edges_reduce_all", _reduced_sql("", "0::BIGINT"))(lambda spark, d: _reductions(spark, lambda m, op: reduced(m.expr, op, None).withColumn("index", F.lit(0).cast("long"))))


def _named(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    return _told(spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name string, value double"), "value")


def _named_sql(values: dict[str, str], source: str) -> str:
    return _told_sql(" UNION ALL ".join(f"SELECT '{k}' AS name, ({v})::DOUBLE AS value FROM ({source})" for k, v in values.items()), "value")


@_query(
    "reduction_options",
    _named_sql(
        {
            "var_ddof": "round(var_samp(x), 4)", "std_correction": "round(sqrt(var_pop(x) * count(*) / (count(*) - 2)), 4)", "var_fraction": "round(var_pop(x) * count(*) / (count(*) - 0.5), 4)",
            "keepdims": "round(sum(x), 2)", "vector_sum": "round(sum(x) FILTER (i = 3), 2)", "vector_mean": "round(avg(x) FILTER (i = 3), 4)", "amax": "max(x)", "whole": "round(sum(x), 2)",
        },
        _GRID,
    ),
)
def reduction_options(spark, d):
    m = activity(Session(spark), d)
    kept = np.sum(m, axis=0, keepdims=True)
    vector = m[3, :]
    return _named(spark, {
        "var_ddof": round(m.var(ddof=1), 4), "std_correction": round(m.std(correction=2), 4), "var_fraction": round(m.var(ddof=0.5), 4), "keepdims": round(kept.sum(), 2) if kept.shape == (1, 5) else -1,
        "vector_sum": round(vector.sum(), 2), "vector_mean": round(vector.mean(), 4), "amax": np.amax(m), "whole": round(np.sum(m, where=True), 2),
    })


# inputs and sinks


@_query("upload_coordinates", "SELECT n_nationkey AS i, n_regionkey AS j, n_nationkey * 1.5::DOUBLE AS x FROM nation WHERE n_nationkey <> 0")
def upload_coordinates(spark, d):
    rows = _table(spark, d, "nation").select("n_nationkey", "n_regionkey").toPandas()
    return Session(spark).from_coo(rows.n_nationkey, rows.n_regionkey, rows.n_nationkey * 1.5, shape=(len(rows), 5)).to_frame()


class _Coordinates:
    """What a SciPy coordinate matrix offers, for boxes without SciPy."""

    def __init__(self, row, col, data, shape):
        self.row, self.col, self.data, self.shape = np.asarray(row), np.asarray(col), np.asarray(data, float), shape

    def tocoo(self, copy=False):
        return _Coordinates(self.row.copy(), self.col.copy(), self.data.copy(), self.shape)

    def sum_duplicates(self):
        cells, where = np.unique(np.stack([self.row, self.col]), axis=1, return_inverse=True)
        (self.row, self.col), self.data = cells, np.bincount(where.ravel(), self.data)

    def eliminate_zeros(self):
        keep = self.data != 0
        self.row, self.col, self.data = self.row[keep], self.col[keep], self.data[keep]


@_query("upload_scipy", "SELECT n_regionkey AS i, 0::BIGINT AS j, sum(n_nationkey - 10)::DOUBLE AS x FROM nation GROUP BY 1 HAVING sum(n_nationkey - 10) <> 0")
def upload_scipy(spark, d):
    rows = _table(spark, d, "nation").select("n_nationkey", "n_regionkey").toPandas()
    return Session(spark).from_scipy(_Coordinates(rows.n_regionkey, rows.n_regionkey * 0, rows.n_nationkey - 10, (5, 1))).to_frame()


@_query("upload_dense", _told_sql(f"SELECT k AS i, 0::BIGINT AS j, x FROM ({_LATTICE}) WHERE k < 15"))
def upload_dense(spark, d):
    return _told(Session(spark).from_numpy(np.array(LATTICE[:15], float)[:, None]).to_frame())


@_query("relation_nulls", _told_sql("SELECT * FROM (VALUES ('dense', 0, 0, 'nan'::DOUBLE), ('dense', 0, 1, 0.0), ('sparse', 0, 1, 'nan'::DOUBLE)) v(kind_of, i, j, x)"))
def relation_nulls(spark, d):
    s = Session(spark)
    dense, sparse = _relation(s, [(0, 0, None), (0, 1, 0.0)], (1, 2), "dense"), _relation(s, [(0, 1, None)], (1, 2), "sparse")
    return _told(_union([m.to_frame().select(F.lit(k).alias("kind_of"), F.col("i").cast("int"), F.col("j").cast("int"), "x") for k, m in (("dense", dense), ("sparse", sparse))]))


@_query("parquet_scan", _QTY)
def parquet_scan(spark, d):
    """Two coordinate files of narrow types, and one of wide types for keys that do not fit those, read as one matrix.

    Files are told by keys alone, so that each aggregates its own rows only; one whose values are no floats has doubles.
    """
    s = Session(spark)
    rows, folder = quantity(s, d).to_frame(), s._folder()
    i, j, x = map(F.col, "ijx")
    fits = i.between(-(2**31), 2**31 - 1) & j.between(-(2**15), 2**15 - 1)
    file = F.when(~fits, "wide").when(i % 2 == 0, "even").otherwise("odd")
    paths = {name: f"{folder}/{name}" for name in ("even", "odd", "wide")}
    rows.filter(file == "wide").write.parquet(paths["wide"])
    for name in ("even", "odd"):
        seen, keys = Observation(), (i.cast("int"), j.cast("smallint"))
        cells = rows.filter(file == name)
        cells.observe(seen, F.count_if(~x.cast("float").eqNullSafe(x)).alias("rounded")).select(*keys, x.cast("float")).write.parquet(paths[name])
        if seen.get["rounded"]:
            cells.select(*keys, x).write.mode("overwrite").parquet(paths[name])
    return s.from_parquet(list(paths.values()), shape=(_table(spark, d, "part").count(), _table(spark, d, "supplier").count())).to_frame()


def _file(s: Session, lines: list[str]) -> str:
    """A text file of these lines, written by Spark where the session may write."""
    folder = s._folder()
    s.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    path = s.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(s.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return next(str(f.getPath().toString()).replace("file:/", "file:///", 1) for f in found if f.getPath().getName().startswith("part-"))


def _nations(spark, d) -> list[tuple[int, int]]:
    return sorted(tuple(r) for r in _table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect())


def _mtx(kind: str, symmetry: str, n: int, cells: list[str]) -> list[str]:
    return [f"%%MatrixMarket matrix coordinate {kind} {symmetry}", "% made by a query", "", f"{n} {n} {len(cells)}", *cells]


@_query("mtx_general", "SELECT n_nationkey AS i, n_regionkey AS j, sum(w)::DOUBLE AS x FROM (SELECT *, n_nationkey - 7.5 AS w FROM nation UNION ALL SELECT *, 2.5 FROM nation) GROUP BY 1, 2 HAVING sum(w) <> 0")
def mtx_general(spark, d):
    """Duplicates are summed, cells that cancel go, white space and comments do not count."""
    cells = [f"  {i + 1}\t{j + 1}   {i - 7.5}" for i, j in _nations(spark, d)] + [f"{i + 1} {j + 1} +2.5e0" for i, j in _nations(spark, d)]
    s = Session(spark)
    return s.from_mtx(_file(s, _mtx("real", "general", 25, cells))).to_frame()


@_query("mtx_trusted", "SELECT n_nationkey AS i, n_regionkey AS j, (n_nationkey - 3)::DOUBLE AS x FROM nation")
def mtx_trusted(spark, d):
    s = Session(spark)
    return s.from_mtx(_file(s, _mtx("integer", "general", 25, [f"{i + 1} {j + 1} {i - 3}" for i, j in _nations(spark, d)])), assume_canonical=True).to_frame()


_LOWER = "SELECT n_nationkey AS i, n_regionkey AS j FROM nation WHERE n_nationkey {} n_regionkey"


@_query("mtx_symmetric", f"SELECT i, j, 1.0::DOUBLE AS x FROM ({_LOWER.format('>=')}) UNION SELECT j, i, 1.0::DOUBLE FROM ({_LOWER.format('>=')})")
def mtx_symmetric(spark, d):
    s = Session(spark)
    return s.from_mtx(_file(s, _mtx("pattern", "symmetric", 25, [f"{i + 1} {j + 1}" for i, j in _nations(spark, d) if i >= j]))).to_frame()


@_query("mtx_skew", f"SELECT i, j, (i + 1)::DOUBLE AS x FROM ({_LOWER.format('>')}) UNION ALL SELECT j, i, -(i + 1)::DOUBLE FROM ({_LOWER.format('>')})")
def mtx_skew(spark, d):
    s = Session(spark)
    return s.from_mtx(_file(s, _mtx("real", "skew-symmetric", 25, [f"{i + 1} {j + 1} {i + 1}" for i, j in _nations(spark, d) if i > j]))).to_frame()


@_query("mtx_replaced", "SELECT n_nationkey AS i, n_regionkey AS j, 2.0::DOUBLE AS x FROM nation")
def mtx_replaced(spark, d):
    """A temporary name is loaded twice; a matrix over the first file reads the second one."""
    s = Session(spark)
    name = f"replaced_{abs(hash(s))}"
    files = [_file(s, _mtx("real", "general", 25, [f"{i + 1} {j + 1} {v}" for i, j in _nations(spark, d)])) for v in (1, 2)]
    m = s.from_mtx(files[0], name=name, temporary=True)
    m.to_frame()
    s.from_mtx(files[1], name=name, temporary=True, overwrite=True)
    return m.to_frame()


def _host(spark: SparkSession, i, j, x) -> DataFrame:
    return spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(i, j, x, strict=True)], "i long, j long, x double")


@_query("collect_dense", f"SELECT i, j, x FROM ({_GRID})")
def collect_dense(spark, d):
    a = np.asarray(activity(Session(spark), d))
    return _host(spark, *np.indices(a.shape).reshape(2, -1), a.ravel())


@_query("collect_coordinates", f"SELECT i, j, x - 1 AS x FROM (SELECT i, j, round(x) AS x FROM ({_EVENTS})) WHERE x <> 1")
def collect_coordinates(spark, d):
    """Sparse export drops explicit zeros."""
    s = Session(spark)
    rows = activity(s, d).to_frame().select("i", "j", (F.round("x") - 1).alias("x"))
    return _host(spark, *s.from_relation(rows, shape=activity(s, d).shape).to_coo())


@_query("collect_vector_and_scalar", f"SELECT j, x FROM ({_GRID}) WHERE i = 2 UNION ALL SELECT 5, x FROM ({_GRID}) WHERE i = 1 AND j = 3")
def collect_vector_and_scalar(spark, d):
    m = activity(Session(spark), d)
    values = [*m[2, :].to_numpy(), m[1, 3].item()]
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "j long, x double")


@_query("preview_corners", f"WITH last AS (SELECT max(i) + 1 AS rows FROM ({_GRID})) SELECT CASE WHEN i < 2 THEN i ELSE i - rows + 4 END AS line, CASE WHEN j < 2 THEN j ELSE j - 1 END AS place, round(x, 2) AS x FROM ({_GRID}), last WHERE (i < 2 OR i >= rows - 2) AND (j < 2 OR j >= 3)")
def preview_corners(spark, d):
    text = activity(Session(spark), d).preview(2)
    lines = [[float(v) for v in line.strip("[]").split() if v != "..."] for line in text.splitlines() if line != "..."]
    return spark.createDataFrame([(i, j, round(v, 2)) for i, line in enumerate(lines) for j, v in enumerate(line)], "line long, place long, x double")


@_query("plan_nodes", "SELECT * FROM (VALUES (0, 'Source', 'sparse'), (1, 'ScalarBinary', 'sparse'), (2, 'Unary', 'dense'), (3, 'ScalarBinary', 'sparse'), (4, 'Transpose', 'sparse')) v(id, kind, storage)")
def plan_nodes(spark, d):
    """exp(2A) - 1 is sparse again, as the value of absent cells is kept through exp."""
    m = _relation(Session(spark), CELLS, (5, 6), "sparse")
    plan = (np.exp(m * 2) - 1).T.plan()
    return spark.createDataFrame([(n["id"], n["kind"], n["storage"]) for n in plan["nodes"]], "id int, kind string, storage string")


@_query("implicit_restored", _told_sql(f"SELECT j AS i, i AS j, exp(x * 2) - 1 AS x FROM ({_CELLS}) WHERE x <> 0 OR isnan(x)"))
def implicit_restored(spark, d):
    m = _relation(Session(spark), CELLS, (5, 6), "sparse")
    return _told((np.exp(m * 2) - 1).T.to_frame().filter("x <> 0"))


@_query("plan_texts", "SELECT * FROM (VALUES ('compile', true), ('explain', true), ('repr', true)) v(name, told)")
def plan_texts(spark, d):
    m = activity(Session(spark), d) * 2
    told = {"compile": "Aggregate" in m.compile(), "explain": "HashAggregate" in m.explain(), "repr": repr(m).startswith("SparseMatrix")}
    return spark.createDataFrame(list(told.items()), "name string, told boolean")


@_query("surface", "SELECT * FROM (VALUES ('len', 5.0), ('ndim', 2.0), ('size', 30.0), ('rows', 5.0), ('float64', 1.0), ('vector_len', 6.0), ('scalar_ndim', 0.0), ('bool_raises', 1.0), ('reduce_ufunc_raises', 1.0), ('kwarg_raises', 1.0), ('transposed', 6.0), ('vector_transposed', 6.0)) v(name, value)")
def surface(spark, d):
    m = _relation(Session(spark), CELLS, (5, 6), "sparse")

    def raises(f, kind) -> float:
        try:
            f()
        except kind:
            return 1.0
        return 0.0

    values = {
        "len": len(m), "ndim": m.ndim, "size": m.size, "rows": m.shape[0], "float64": m.dtype == np.float64, "vector_len": len(m[0, :]), "scalar_ndim": m[0, 0].ndim, "bool_raises": raises(lambda: bool(m), ValueError),
        "reduce_ufunc_raises": raises(lambda: np.add.reduce(m), TypeError), "kwarg_raises": raises(lambda: np.add(m, 1, where=np.ones((5, 6), bool)), TypeError), "transposed": np.transpose(m).shape[0], "vector_transposed": np.transpose(m[0, :]).shape[0],
    }
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name string, value double")


# indexing


def _picked(spark: SparkSession, parts: dict[str, Lazy]) -> DataFrame:
    return _union([m.to_frame().select(F.lit(k).alias("name"), "i", "j", "x") for k, m in parts.items()])


_E = f"(SELECT i, j, x FROM ({_EVENTS}))"


@_query(
    "index_forms",
    f"""SELECT 'slice_gather' AS name, o.k AS i, j - 1 AS j, x FROM {_E} JOIN (VALUES (0, 4), (1, 1), (2, 4)) o(k, s) ON i = s WHERE j BETWEEN 1 AND 3
      UNION ALL SELECT 'ellipsis', i, j, x FROM {_E} UNION ALL SELECT 'empty_key', i, j, x FROM {_E}
      UNION ALL SELECT 'short_key', 0, j, x FROM {_E} WHERE i = 3 UNION ALL SELECT 'negative', 0, j, x FROM {_E} WHERE i = (SELECT max(user_id) FROM events)
      UNION ALL SELECT 'short_slice', i - 2, j, x FROM {_E} WHERE i BETWEEN 2 AND 5 UNION ALL SELECT 'trailing', i, 0, x FROM {_E} WHERE j = 4 AND i < 9""",
)
def index_forms(spark, d):
    m = activity(Session(spark), d)
    return _picked(spark, {"slice_gather": m[[4, 1, 4], 1:4], "ellipsis": m[...], "empty_key": m[()], "short_key": m[3], "negative": m[-1, :], "short_slice": m[2:6], "trailing": m[..., 4:][:9]})


@_query("one_row_factor", f"SELECT i, j, x * 2.5 AS x FROM {_E}")
def one_row_factor(spark, d):
    s = Session(spark)
    return (activity(s, d) * s.from_numpy(np.array([[2.5]]))).to_frame()


@_query("vector_arithmetic", f"SELECT a.j AS j, round(a.x * b.x + 3, 4) AS x FROM ({_GRID}) a JOIN ({_GRID}) b ON a.j = b.j AND a.i = 1 AND b.i = 4")
def vector_arithmetic(spark, d):
    m = activity(Session(spark), d)
    return (m[1, :] * m[4, :] + m[0, 0] * 0 + 3).to_frame().select("j", F.round("x", 4).alias("x"))


# guards and errors


def _rejections(s: Session, d: str) -> dict[str, tuple[Callable[[], object], type[BaseException]]]:
    spark = s.spark
    tight = Session(spark, max_densify_cells=10, max_host_values=2, max_sparse_host_values=3, max_selector_values=3, max_selector_relations=1)
    m, n = _relation(s, CELLS, (5, 6), "sparse"), _relation(tight, CELLS, (5, 6), "sparse")
    load = lambda kind, symmetry, cells, size=3: lambda: s.from_mtx(_file(s, _mtx(kind, symmetry, size, cells)))

    def deep():
        x = m
        for _ in range(800):
            x = x * 1.0

    def closed():
        other = Session(spark)
        other.close()
        other.from_numpy(np.zeros((1, 1)))

    def twice():
        s.from_coo([0], [0], [1.0], shape=(1, 1), name="twice_named")
        s.from_coo([0], [0], [1.0], shape=(1, 1), name="twice_named")

    return {
        "densify": (lambda: n + 1, errors.DensifyError), "dense_upload": (lambda: tight.from_numpy(np.zeros((5, 5))), errors.DensifyError), "dense_collect": (lambda: n.to_numpy(), errors.DensifyError),
        "host_values": (lambda: n.sum(axis=0), errors.DensifyError), "sparse_host_values": (lambda: n.to_coo(), errors.DensifyError), "selector_values": (lambda: n[[0, 1, 2, 3], :], errors.DensifyError),
        "expansion": (lambda: tight.from_numpy(np.zeros((4, 1))) + tight.from_numpy(np.zeros((1, 4))), errors.DensifyError), "depth": (deep, RecursionError), "sessions": (lambda: m + n, errors.SessionMismatchError),
        "closed": (closed, RuntimeError), "complex": (lambda: s.from_numpy(np.zeros((1, 1), complex)), errors.UnsupportedError), "new_axis": (lambda: m[None, :], errors.UnsupportedError),
        "two_gathers": (lambda: m[[0], [1]], errors.UnsupportedError), "out_of_bounds": (lambda: m[9, :], IndexError), "float_selector": (lambda: m[np.array([0.5]), :], IndexError),
        "tuple_axis": (lambda: m.sum(axis=(0, 1)), errors.UnsupportedError), "masked": (lambda: m.sum(where=np.ones((5, 6), bool)), errors.UnsupportedError), "flat_take": (lambda: m.take([0]), errors.UnsupportedError),
        "matmul_rank": (lambda: m @ np.ones(6), errors.UnsupportedError), "coo_twice": (lambda: s.from_coo([0, 0], [1, 1], [1.0, 2.0], shape=(2, 2)), ValueError), "coo_outside": (lambda: s.from_coo([2], [0], [1.0], shape=(2, 2)), IndexError),
        "no_path": (lambda: s.from_parquet([], shape=(1, 1)), ValueError), "path_twice": (lambda: s.from_parquet([d, d], shape=(1, 1)), ValueError), "path_missing": (lambda: s.from_parquet("/nowhere.parquet", shape=(1, 1)), FileNotFoundError),
        "columns": (lambda: s.from_relation(spark.range(3).toDF("k"), shape=(3, 1)), ValueError), "name_twice": (twice, ValueError), "name_syntax": (lambda: s.from_coo([0], [0], [1.0], shape=(1, 1), name="no name"), ValueError),
        "mtx_count": (lambda: s.from_mtx(_file(s, _mtx("real", "general", 3, ["1 1 1"])[:3] + ["3 3 2", "1 1 1"])), ValueError), "mtx_outside": (load("real", "general", ["4 1 1.0"]), ValueError), "mtx_text": (load("real", "general", ["1 1 one"]), ValueError),
        "mtx_fields": (load("real", "general", ["1 1 1.0 7"]), ValueError), "mtx_integer_fraction": (load("integer", "general", ["1 1 2.5"]), ValueError), "mtx_integer_exponent": (load("integer", "general", ["1 1 1e0"]), ValueError),
        "mtx_skew_diagonal": (load("real", "skew-symmetric", ["2 2 1.0"]), ValueError), "mtx_kind": (load("complex", "general", ["1 1 1 1"]), ValueError),
    }


_CASES = "densify dense_upload dense_collect host_values sparse_host_values selector_values expansion depth sessions closed complex new_axis two_gathers out_of_bounds float_selector tuple_axis masked flat_take matmul_rank coo_twice coo_outside no_path path_twice path_missing columns name_twice name_syntax mtx_count mtx_outside mtx_text mtx_fields mtx_integer_fraction mtx_integer_exponent mtx_skew_diagonal mtx_kind".split()


@_query("rejections", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', true)" for c in _CASES) + ") v(name, rejected)")
def rejections(spark, d):
    """Whether each wrong use raises the error that is documented for it."""
    with Session(spark) as s:
        out = []
        for name, (f, kind) in _rejections(s, d).items():
            try:
                f()
                out.append((name, False))
            except kind:
                out.append((name, True))
    return spark.createDataFrame(out, "name string, rejected boolean")


@_query("closed_session", "SELECT false AS view_left, true AS raises")
def closed_session(spark, d):
    s = Session(spark)
    name = f"closing_{abs(hash(s))}"
    m = s.from_mtx(_file(s, _mtx("real", "general", 3, ["1 1 1.0"])), name=name, temporary=True)
    s.close()
    try:
        m.to_frame()
        raises = False
    except RuntimeError:
        raises = True
    return spark.createDataFrame([(bool(spark.catalog.tableExists(name)), raises)], "view_left boolean, raises boolean")


# the workflow's statistics, and its form that keeps all on the cluster

_COUNTS = f"""WITH e AS (SELECT i, j, n AS x FROM ({_EVENTS})), g AS (SELECT j, row_number() OVER (ORDER BY j) - 1 AS k FROM e GROUP BY j HAVING count(*) >= 3),
  c AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k, sum(x) AS total FROM e JOIN g USING (j) GROUP BY i),
  m AS (SELECT c.k AS i, g.k AS j, ln(1 + x * 10000 / total) AS x FROM e JOIN g USING (j) JOIN c USING (i))"""


@_query("preprocess_statistics", _COUNTS + ", f AS (SELECT g.k AS gene, coalesce(m.x, 0) AS x FROM c CROSS JOIN g LEFT JOIN m ON m.i = c.k AND m.j = g.k) SELECT gene, round(avg(x), 4) AS mean, round(var_samp(x), 4) AS variance FROM f GROUP BY 1")
def preprocess_statistics(spark, d):
    p = preprocess(activity(Session(spark), d, "n"))
    return spark.createDataFrame([(k, round(float(a), 4), round(float(b), 4)) for k, (a, b) in enumerate(zip(p.mean, p.variance, strict=True))], "gene long, mean double, variance double")


@_query("preprocess_on_cluster", _COUNTS + " SELECT i, j, round(x, 4) AS x FROM m")
def preprocess_on_cluster(spark, d):
    return normalize_frame(activity(Session(spark), d, "n")).select("i", "j", F.round("x", 4).alias("x"))
