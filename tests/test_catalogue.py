"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from cellweave import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    return c


def plain(v):
    if v is None or v is pd.NA or isinstance(v, (float, np.floating)) and v != v:
        return None
    return v.item() if isinstance(v, np.generic) else v


def alike(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return abs(a - b) <= 2e-5 * max(1.0, abs(a))
    return a == b


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    made = [tuple(plain(r[i]) for i in order) for r in values]
    return sorted(made, key=lambda r: [(v is None, isinstance(v, str), round(v, 2) if isinstance(v, float) else v if v is not None else 0) for v in r if not isinstance(v, float)] + [repr(r)])


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    made = duck.execute(SQL[name])
    names = [d[0] for d in made.description]
    want = rows(made.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(alike(x, y) for x, y in zip(a, b)), (a, b)


def test_queries_without_sql_give_rows(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    for name in QUERIES.keys() - SQL.keys():
        assert QUERIES[name](spark, SF).count() > 0, name
