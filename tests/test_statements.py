"""Every registered statement against DuckDB on the smallest tables, in order where the statement orders."""

import math
import os

import duckdb
import pytest

from granary.operators.statements import STATEMENTS

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) if isinstance(a, float) or isinstance(b, float) else a == b


@pytest.mark.parametrize("name", STATEMENTS)
def test_statement(spark, duck, name):
    got = STATEMENTS[name].run(spark, DATA)
    cur = duck.execute(STATEMENTS[name].check())
    assert got.columns == [d[0] for d in cur.description]
    rows, expected = [tuple(r) for r in got.collect()], [tuple(r) for r in cur.fetchall()]
    if "ORDER BY" not in STATEMENTS[name].sql or name in ("q07",):
        rows, expected = sorted(rows, key=repr), sorted(expected, key=repr)
    assert len(rows) == len(expected)
    assert all(same(x, y) for r, s in zip(rows, expected, strict=True) for x, y in zip(r, s, strict=True) if x is not None or y is not None)
