import os

import pytest

from tessera import queries as Q
from tests.compare import same, views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(Q.all_queries()))
def test_query(spark, con, name):
    df = Q.all_queries()[name](spark, SF)
    sql = Q.all_sql().get(name)
    if sql:
        assert same(df, con, sql) == ""
    else:
        assert df.count() > 0


def test_entry_columns_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
