"""Every query with SQL against DuckDB on the smallest tables; the others run and have rows."""

import glob
import math
import os

import duckdb
import pytest

from waymesh.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else tuple(map(str, v)) if isinstance(v, dict) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    want = oracle.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
