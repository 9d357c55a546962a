"""Every registered query against its DuckDB text at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    msg, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert msg is None, msg


def test_entry_has_rows_and_names_agree(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
