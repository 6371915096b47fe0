"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest
from latticelu import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (df[cols].sort_values(cols).reset_index(drop=True) for df in (got, want))
    assert len(a) == len(b) > 0
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry_lists_them_all():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())
