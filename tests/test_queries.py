"""Every matrix query against its DuckDB SQL, compared as the sorted rows of equally named columns."""

import glob
import os

import duckdb
import pytest

from tessella import edge_queries  # noqa: F401
from tessella import queries as q

DATA = os.environ.get("QUERY_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(r[k] for k in order) for r in values)


@pytest.mark.parametrize("name", q.QUERIES)
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(q.ORACLES[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want


@pytest.mark.parametrize(
    "cells",
    [
        [(0, 0, 1.0), (1, 32767, 2.0), (2, 32768, 3.0), (3, 59999, 4.0), (3, 59999, 5.0)],
        [(2**31 - 1, 1, 1.0), (2**31, 1, 2.0), (2**31 + 1, 40000, 3.0), (-3, 2, 4.0), (-4, 2, 5.0)],
        [(0, 0, 0.1), (0, 1, 2.0**24), (0, 1, 1.0), (1, 0, 1e300), (1, 1, 2.0), (2, 40000, 0.1)],
    ],
    ids=["suppliers", "parts", "values"],
)
def test_parquet_scan_beyond_narrow_types(spark, tmp_path, cells):
    """Keys and sums that int, smallint or float do not hold."""
    for table, schema, values in [
        ("lineitem", "l_partkey long, l_suppkey long, l_quantity double", cells),
        ("part", "p_partkey long", [(0,)]),
        ("supplier", "s_suppkey long", [(0,)]),
    ]:
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = q.QUERIES["parquet_scan"](spark, str(tmp_path))
    cursor = con.execute(q.ORACLES["parquet_scan"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_parquet_of_a_scheme_with_one_slash(session, tmp_path):
    """Hadoop writes local folders, a checkpoint folder too, as file:/."""
    session.spark.createDataFrame([(0, 1, 2.5)], "i int, j short, x float").write.parquet(str(tmp_path / "p"))
    assert session.from_parquet(f"file:{tmp_path}/p", shape=(1, 2)).to_numpy().tolist() == [[0.0, 2.5]]
