"""Every query of the catalogue against its DuckDB oracle on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from corpusloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).fetchdf()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert a.equals(b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
