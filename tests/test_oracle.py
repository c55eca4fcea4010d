"""Every registered query against its SQL statement, value by value."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA
from tidemark.plans import oracle, registry

# The month shown has few accounts in the smallest folder, and none at high risk.
EMPTY_HERE = {"risk_by_segment"}
TABLES = "region nation customer supplier part orders lineitem".split()
QUERIES = registry.QUERIES
ORACLE = oracle.statements()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLE[name])
    assert columns == sorted(expected.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert got or name in EMPTY_HERE, "no rows"
    assert _ordered(got) == _ordered(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_is_lazy_and_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["month", "mrr", "arr"]
    assert df.count() == 80
