"""Every registered query against its SQL, on the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, differences, types_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    problems, n = differences(df, con, sql)
    assert not problems, problems
    assert not types_of(df, con, sql)
    assert n > 0 or name in ("source_contains", "ingest_errors")  # nothing to find at this scale


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
