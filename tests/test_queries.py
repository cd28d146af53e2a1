"""Every registered query of the engine against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from palisade import case_oracles, file_oracles, file_queries, oracles, queries

ORACLE = oracles.ORACLE | case_oracles.ORACLE | file_oracles.ORACLE
QUERIES = queries.QUERIES | file_queries.QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "" if math.isnan(x) else f"{x:.9g}"
    return "" if x is None else f"{x:.9g}" if hasattr(x, "as_tuple") else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_duckdb(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted([plain(r[columns.index(c)]) for c in order] for r in found.fetchall())
    assert sorted([plain(r[c]) for c in order] for r in got.collect()) == want


def test_all_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES) and not set(queries.QUERIES) & set(file_queries.QUERIES)
