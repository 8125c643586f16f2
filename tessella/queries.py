"""One query for each operator over the driver's tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.array import Matrix
from .operators.reduce import OPS
from .sources.session import Session
from .workflow import normalize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TYPES = ["click", "error", "purchase", "signup", "view"]


def _query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def quantity(s: Session, d: str) -> Matrix:
    """part x supplier, sum of quantities; sparse."""
    spark = s.spark
    rows = _table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("x"))
    return s.from_relation(rows, shape=(_table(spark, d, "part").count(), _table(spark, d, "supplier").count()))


def _users(spark: SparkSession, d: str) -> int:
    return (_table(spark, d, "events").agg(F.max("user_id")).first()[0] or 0) + 1


def activity(s: Session, d: str, value: str = "x") -> Matrix:
    """user x event type, sum of values (x) or count (n); sparse."""
    kind = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    rows = _table(s.spark, d, "events").groupBy(F.col("user_id").alias("i"), kind.alias("j")).agg((F.round(F.sum("value"), 2) if value == "x" else F.count("*").cast("double")).alias("x"))
    return s.from_relation(rows, shape=(_users(s.spark, d), len(TYPES)))


def balances(s: Session, d: str) -> Matrix:
    """1 x supplier account balances in thousands, with 0, -0.0, -1, 1 and 0.5 among them; dense."""
    k = F.col("s_suppkey")
    x = F.when(k % 10 == 0, 0.0).when(k % 10 == 1, -1.0).when(k % 10 == 2, 1.0).when(k % 10 == 3, 0.5).otherwise(F.round(F.col("s_acctbal") / 1000, 3))
    df = _table(s.spark, d, "supplier")
    return s.from_relation(df.select(F.lit(0).cast("long").alias("i"), k.cast("long").alias("j"), x.alias("x")), shape=(1, df.count()), storage="dense")


def owned_costs(s: Session, d: str) -> Matrix:
    """1 x supplier factors as an owned, finite input."""
    n = _table(s.spark, d, "supplier").count()
    return s.from_numpy(1.0 + np.arange(n, dtype=float)[None] % 7)


def described(df: DataFrame, value: str = "x", digits: int = 4) -> DataFrame:
    """The value as a rounded finite number and a kind, so that engines agree on how non-finite ones are written."""
    v = F.col(value)
    kind = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").otherwise("number")
    return df.withColumn("kind", kind).withColumn(value, F.when(F.col("kind") == "number", F.round(v, digits) + 0.0).otherwise(0.0))


def _described(sql: str, value: str = "x", digits: int = 4) -> str:
    return f"""SELECT * REPLACE (CASE WHEN isfinite({value}) THEN round({value}, {digits}) + 0.0 ELSE 0.0 END AS {value}),
      CASE WHEN isnan({value}) THEN 'nan' WHEN {value} = 'inf'::DOUBLE THEN 'inf' WHEN {value} = '-inf'::DOUBLE THEN '-inf' ELSE 'number' END AS kind FROM ({sql})"""


_SUPPLY = "SELECT s_suppkey AS j, CASE s_suppkey % 10 WHEN 0 THEN 0.0 WHEN 1 THEN -1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 ELSE round(s_acctbal / 1000, 3) END::DOUBLE AS x FROM supplier"
_EVENTS = f"SELECT user_id AS i, list_position({TYPES}, event_type) - 1 AS j, round(sum(value), 2) AS x, count(*)::DOUBLE AS n FROM events GROUP BY ALL"
_GRID = f"SELECT i, j, coalesce(e.x, 0) AS x, coalesce(e.n, 0) AS n FROM (SELECT u.range AS i, t.range AS j FROM range((SELECT max(user_id) + 1 FROM events)) u, range(5) t) LEFT JOIN ({_EVENTS}) e USING (i, j)"
_QTY = "SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS x FROM lineitem GROUP BY ALL"

_UNARY_SQL = {
    "negative": "-x", "absolute": "abs(x)", "sqrt": "CASE WHEN x < 0 THEN 'nan'::DOUBLE ELSE sqrt(greatest(x, 0)) END", "exp": "exp(x)", "expm1": "exp(x) - 1",
    "log": "CASE WHEN x < 0 THEN 'nan'::DOUBLE WHEN x = 0 THEN '-inf'::DOUBLE ELSE ln(CASE WHEN x > 0 THEN x ELSE 1 END) END",
    "log1p": "CASE WHEN x < -1 THEN 'nan'::DOUBLE WHEN x = -1 THEN '-inf'::DOUBLE ELSE ln(1 + CASE WHEN x > -1 THEN x ELSE 1 END) END",
    "log2": "CASE WHEN x < 0 THEN 'nan'::DOUBLE WHEN x = 0 THEN '-inf'::DOUBLE ELSE log2(CASE WHEN x > 0 THEN x ELSE 1 END) END",
    "log10": "CASE WHEN x < 0 THEN 'nan'::DOUBLE WHEN x = 0 THEN '-inf'::DOUBLE ELSE log10(CASE WHEN x > 0 THEN x ELSE 1 END) END",
    "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)",
    "arcsin": "CASE WHEN abs(x) > 1 THEN 'nan'::DOUBLE ELSE asin(greatest(-1, least(1, x))) END", "arccos": "CASE WHEN abs(x) > 1 THEN 'nan'::DOUBLE ELSE acos(greatest(-1, least(1, x))) END",
    "arctan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)", "floor": "floor(x)", "ceil": "ceil(x)", "trunc": "trunc(x)", "sign": "sign(x)::DOUBLE", "isnan": "isnan(x)::INT::DOUBLE",
}

for _op, _sql in _UNARY_SQL.items():
    _query(f"unary_{_op}", _described(f"SELECT j, ({_sql})::DOUBLE AS x FROM ({_SUPPLY})"))(
        lambda spark, d, op=_op: described(balances(Session(spark), d)._unary(op).to_frame().select("j", "x"))
    )

_BINARY_SQL = {
    "add": "x + n", "subtract": "x - n", "multiply": "x * n", "power": "CASE WHEN x = 0 AND n = 0 THEN 1 ELSE pow(x / 100, least(n, 3)) END",
    "true_divide": "CASE WHEN n = 0 THEN CASE WHEN x = 0 THEN 'nan'::DOUBLE WHEN x > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE x / CASE WHEN n = 0 THEN 1 ELSE n END END",
    "greater": "(x > n)::INT", "greater_equal": "(x >= n)::INT", "less": "(x < n)::INT", "less_equal": "(x <= n)::INT", "equal": "(x = n)::INT", "not_equal": "(x <> n)::INT",
}


#: A quotient of cents by a count has ties at few digits.
_DIGITS = {"true_divide": 10}


def _binary(spark, d, op):
    s = Session(spark)
    a, b = activity(s, d), activity(s, d, "n")
    if op == "power":
        out = (a / 100) ** (b * (b <= 3) + (b > 3) * 3)
    else:
        out = a._binary(op, b)
    df = out.to_frame() if out.storage == "dense" else _dense(out)
    return described(df, digits=_DIGITS.get(op, 4))


def _dense(m: Matrix) -> DataFrame:
    from .plans.lower import filled

    return filled(m.to_frame(), m.shape, m.expr.implicit)


for _op, _sql in _BINARY_SQL.items():
    _query(f"binary_{_op}", _described(f"SELECT i, j, ({_sql})::DOUBLE AS x FROM ({_GRID})", digits=_DIGITS.get(_op, 4)))(lambda spark, d, op=_op: _binary(spark, d, op))


def _with_nan(s: Session, d: str) -> Matrix:
    m = activity(s, d)
    df = m.to_frame().withColumn("x", F.when(F.col("i") % 7 == 3, float("nan")).otherwise(F.col("x")))
    return s.from_relation(df, shape=m.shape)


_NAN_GRID = f"SELECT i, j, CASE WHEN i % 7 = 3 AND n > 0 THEN NULL ELSE x END AS v, i % 7 = 3 AND n > 0 AS bad FROM ({_GRID})"
_REDUCTION_SQL = {
    "sum": "sum(v)", "mean": "avg(v)", "var": "var_pop(v)", "std": "stddev_pop(v)", "min": "min(v)", "max": "max(v)", "any": "bool_or(bad OR v <> 0)", "all": "bool_and(bad OR v <> 0)",
    "nansum": "coalesce(sum(v), 0)", "nanmean": "avg(v)", "nanvar": "var_pop(v)", "nanstd": "stddev_pop(v)", "nanmin": "min(v)", "nanmax": "max(v)",
}
for _op in OPS:
    for _axis, _key in ((0, "j"), (1, "i")):
        _e = _REDUCTION_SQL[_op]
        if _op in ("any", "all"):
            _sql = f"SELECT {_key} AS index, coalesce({_e}, false) AS value FROM ({_NAN_GRID}) GROUP BY 1"
            _query(f"reduce_{_op}_axis{_axis}", _sql)(lambda spark, d, op=_op, axis=_axis: _with_nan(Session(spark), d).reduced_frame(op, axis))
        else:
            _e = f"coalesce({_e}, 'nan'::DOUBLE)" if _op.startswith("nan") else f"CASE WHEN bool_or(bad) THEN 'nan'::DOUBLE ELSE {_e} END"
            _query(f"reduce_{_op}_axis{_axis}", _described(f"SELECT {_key} AS index, ({_e})::DOUBLE AS value FROM ({_NAN_GRID}) GROUP BY 1", "value"))(
                lambda spark, d, op=_op, axis=_axis: described(_with_nan(Session(spark), d).reduced_frame(op, axis), "value")
            )


@_query("column_means_log1p", "SELECT r.range AS index, round(coalesce(m, 0) / (SELECT count(*) FROM part), 4) + 0.0 AS value FROM range((SELECT count(*) FROM supplier)) r LEFT JOIN (SELECT j, sum(ln(1 + x * 0.5)) AS m FROM (" + _QTY + ") GROUP BY j) ON j = r.range")
def column_means(spark, d):
    out = np.log1p(quantity(Session(spark), d) * 0.5).reduced_frame("mean", 0)
    return out.select("index", (F.round("value", 4) + 0.0).alias("value"))


@_query("reduce_all_cells", f"SELECT round(sum(x), 2) AS total, round(sum(x) / ((SELECT count(*) FROM part) * (SELECT count(*) FROM supplier)), 4) AS mean, max(x) AS top FROM ({_QTY})")
def reduce_all(spark, d):
    from .operators.reduce import reduced

    m = quantity(Session(spark), d)
    part = [reduced(m.expr, op, None).withColumnRenamed("value", name) for op, name in (("sum", "total"), ("mean", "mean"), ("max", "top"))]
    out = part[0].crossJoin(F.broadcast(part[1])).crossJoin(F.broadcast(part[2]))  # one row each
    return out.select(F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "top")


@_query("sample_variance", _described("SELECT j AS index, var_samp(x)::DOUBLE AS value FROM (SELECT s.range AS j, coalesce(q.x, 0) AS x FROM range((SELECT count(*) FROM part)) p CROSS JOIN range((SELECT count(*) FROM supplier)) s LEFT JOIN (" + _QTY + ") q ON q.i = p.range AND q.j = s.range) GROUP BY 1", "value"))
def sample_variance(spark, d):
    return described(quantity(Session(spark), d).reduced_frame("var", 0, 1.0), "value")


@_query("slice_steps", f"SELECT (i - 5) // 3 AS i, 4 - j AS j, x FROM ({_EVENTS}) WHERE i BETWEEN 5 AND 100 AND (i - 5) % 3 = 0".replace(", count(*)::DOUBLE AS n", ""))
def slice_steps(spark, d):
    return activity(Session(spark), d)[5:101:3, ::-1].to_frame()


@_query("gather_repeats", f"SELECT o.k AS i, j, x FROM ({_EVENTS}) JOIN (VALUES (0, 7), (1, 2), (2, 7), (3, 0)) o(k, s) ON i = s")
def gather_repeats(spark, d):
    return activity(Session(spark), d)[[7, 2, 7, 0], :].to_frame()


@_query("gather_mask", f"SELECT i, CASE j WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS j, x FROM ({_EVENTS}) WHERE j IN (0, 2, 4)")
def gather_mask(spark, d):
    return activity(Session(spark), d)[:, [True, False, True, False, True]].to_frame()


@_query("take_columns", f"SELECT i, o.k AS j, x FROM ({_EVENTS}) JOIN (VALUES (0, 4), (1, 1)) o(k, s) ON j = s")
def take_columns(spark, d):
    return np.take(activity(Session(spark), d), [4, 1], axis=1).to_frame()


@_query("transpose", f"SELECT j AS i, i AS j, x FROM ({_EVENTS})")
def transpose(spark, d):
    return activity(Session(spark), d).T.to_frame()


@_query("row_vector", f"SELECT j, round(x * 2 + j, 4) AS x FROM ({_GRID}) WHERE i = 3")
def row_vector(spark, d):
    m = activity(Session(spark), d)
    out = m[3, :] * 2 + np.arange(5.0)
    return out.to_frame().select("j", F.round("x", 4).alias("x"))


@_query("scalar_cell", f"SELECT round(x + 1, 4) AS x FROM ({_GRID}) WHERE i = 2 AND j = 1")
def scalar_cell(spark, d):
    return (activity(Session(spark), d)[2, 1] + 1).to_frame().select(F.round("x", 4).alias("x"))


@_query("broadcast_subtract", f"SELECT i, j, round(x - (j + 1) * 10, 4) AS x FROM ({_GRID})")
def broadcast_subtract(spark, d):
    out = activity(Session(spark), d) - np.arange(1.0, 6.0) * 10
    return out.to_frame().select("i", "j", F.round("x", 4).alias("x"))


@_query("sparse_scaling", f"SELECT i, j, x * (1 + j % 7) AS x FROM ({_QTY})")
def sparse_scaling(spark, d):
    s = Session(spark)
    return (quantity(s, d) * owned_costs(s, d)).to_frame()


@_query("sparse_add", "WITH a AS (" + _QTY + "), b AS (SELECT l_partkey AS i, l_suppkey AS j, count(*)::DOUBLE AS x FROM lineitem WHERE l_quantity > 25 GROUP BY ALL) SELECT i, j, coalesce(a.x, 0) + coalesce(b.x, 0) AS x FROM a FULL JOIN b USING (i, j)")
def sparse_add(spark, d):
    s = Session(spark)
    a = quantity(s, d)
    rows = _table(spark, d, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.count("*").cast("double").alias("x"))
    return (a + s.from_relation(rows, shape=a.shape)).to_frame()


@_query("dense_join_dense", "SELECT vec_id AS i, d - 1 AS j, round(embedding[d]::DOUBLE * embedding[d]::DOUBLE * 2, 4) + 0.0 AS x FROM embeddings, range(1, 65) r(d)")
def dense_join_dense(spark, d):
    s = Session(spark)
    e = _table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x"))
    shape = (e.count(), 64)
    a, b = (s.from_relation(rows, shape=shape, storage="dense") for _ in range(2))
    return (a * b * 2).to_frame().select("i", "j", (F.round("x", 4) + 0.0).alias("x"))


@_query("matmul_suppliers", f"WITH q AS ({_QTY}) SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS x FROM q a JOIN q b ON a.i = b.i GROUP BY ALL")
def matmul_suppliers(spark, d):
    m = quantity(Session(spark), d)
    return (m.T @ m).to_frame()


@_query("matmul_dense", f"SELECT i, k.range AS j, round(sum(x * (j + k.range)), 2) AS x FROM ({_GRID}), range(3) k GROUP BY ALL")
def matmul_dense(spark, d):
    m = activity(Session(spark), d) + 0.0
    w = np.add.outer(np.arange(5.0), np.arange(3.0))
    out = m @ w
    return _dense(out).select("i", "j", F.round("x", 2).alias("x")) if out.storage == "sparse" else out.to_frame()


@_query("pointwise_fusion", f"SELECT i, j, round(ln(1 + x * 2) + sqrt(x) * x, 4) AS x FROM ({_EVENTS}) WHERE x >= 0")
def pointwise_fusion(spark, d):
    s = Session(spark)
    m = activity(s, d)
    out = np.log1p(m * 2) + np.sqrt(m) * m
    return out.to_frame().filter(~F.isnan("x")).select("i", "j", F.round("x", 4).alias("x"))


@_query("computed_result", f"SELECT i, j, x + n AS x FROM ({_EVENTS})")
def computed_result(spark, d):
    s = Session(spark)
    return (activity(s, d) + activity(s, d, "n")).compute().to_frame()


@_query("preview_edges", f"SELECT i, j, x FROM ({_EVENTS}) WHERE (i < 3 OR i >= (SELECT max(user_id) - 2 FROM events))")
def preview_edges(spark, d):
    m = activity(Session(spark), d)
    return m.to_frame().filter((F.col("i") < 3) | (F.col("i") >= m.shape[0] - 3))


@_query(
    "preprocess_counts",
    f"""WITH e AS (SELECT i, j, n AS x FROM ({_EVENTS})), g AS (SELECT j, row_number() OVER (ORDER BY j) - 1 AS k FROM e GROUP BY j HAVING count(*) >= 3),
      c AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k, sum(x) AS total FROM e JOIN g USING (j) GROUP BY i)
      SELECT c.k AS i, g.k AS j, round(ln(1 + x * 10000 / total), 4) AS x FROM e JOIN g USING (j) JOIN c USING (i)""",
)
def preprocess_counts(spark, d):
    out, _, _ = normalize(activity(Session(spark), d, "n"))
    return out.to_frame().select("i", "j", F.round("x", 4).alias("x"))
