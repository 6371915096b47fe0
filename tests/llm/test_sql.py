import duckdb
import pytest
from latticelu.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (df[cols].sort_values(cols).reset_index(drop=True) for df in (got, want))
    assert len(a) == len(b) > 0
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
