"""Oracle parity on sf0.001: every registered query with SQL equals DuckDB (rows and values)."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def names():
    """Every oracle of the library's own queries (those of the training-data operators have their own tests)."""
    from docquery.plans.oracle import oracle_statements
    from docquery.plans.registry import REGISTRY
    return sorted(set(oracle_statements()) & set(REGISTRY))


@pytest.mark.skipif(not os.path.exists(SF), reason="test data absent")
@pytest.mark.parametrize("name", names())
def test_oracle(spark, name):
    import duckdb

    import __spark_entry__ as E
    from scripts.oracle_check import TABLES, norm

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    s = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(E.oracle_sql()[name])
    idx = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(rel.columns) == cols
    d = sorted(repr(tuple(norm(r[idx[c]]) for c in cols)) for r in rel.fetchall())
    assert s == d


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(df.columns) >= {"query_id", "pos", "chunk_id"}
    assert df.count() >= 0
