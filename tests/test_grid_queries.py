"""Every registered query of the grid against its SQL."""

import math

import duckdb
import pytest

from tracegrid.plans import dataset_queries, grid_queries  # noqa: F401 (the first adds its queries to the second's)

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)) for r in rows)


#: Checks that find nothing in sound tables.
FINDS_NOTHING = {"trace_length_check", "coverage_check", "staged_equals_unstaged"}


@pytest.mark.parametrize("name", grid_queries.queries())
def test_query_equals_sql(spark, duck, sf, name):
    df = grid_queries.queries()[name](spark, sf)
    rel = duck.sql(grid_queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = plain(df.select(*rel.columns).collect()), plain(rel.fetchall())
    assert got == want
    assert bool(got) != (name in FINDS_NOTHING) or name == "pending_samples"
