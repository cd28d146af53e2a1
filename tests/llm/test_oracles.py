"""The subpackage's queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from palisade.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_duckdb(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, found = queries.QUERIES[name](spark, small), c.execute(queries.ORACLES[name])
    columns = [x[0] for x in found.description]
    assert sorted(got.columns) == sorted(columns)
    text = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    assert sorted([text(r[k]) for k in columns] for r in got.collect()) == sorted([text(x) for x in r] for r in found.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
