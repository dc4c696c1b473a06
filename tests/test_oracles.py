"""Every query with an oracle against DuckDB on the tables of the correctness gate."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, differences

DATA = "/root/testdata/sf0.01"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, db, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    assert differences(got, db.execute(ORACLES[name]).df()) is None


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["subject_id", "lifelog_date", "d_mscreen_on_min", "d_mscreen_on_min__roll_mean_7"]
    assert df.count() > 0


def test_registry_is_consistent():
    assert set(ORACLES) <= set(entry.queries())
    assert len(entry.queries()) > 130
