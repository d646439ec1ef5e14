"""Each registered query against its SQL twin."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from cohortspan.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in os.listdir(SF_DIR):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF_DIR}/{name}'")
    return db


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    result = tables.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = ordered(result.fetchall())
    assert expected
    assert ordered(tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()) == expected


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys()
    assert ORACLES.keys() <= entry.oracle_sql().keys()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["scenario_id", "Treatments", "QALY", "Cost", "ICER"]
    assert df.count() > 0
