"""Every query with SQL gives what DuckDB gives on the smallest tables; the others run."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from quillspark.plans.catalog import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def told(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 8) + 0.0)
    return str(value)


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(told(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert len(set(df.columns)) == len(df.columns)
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_by_name(df.columns, rows) == rows_by_name(names, result.fetchall())
