"""Every query of the library with SQL gives what DuckDB gives over the same tables."""

import pytest

from oracle import compare, duck
from paperloom.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    if name not in ORACLE:
        QUERIES[name](spark, SF).count()
    else:
        why = compare(spark, con, SF, name, QUERIES[name], ORACLE[name])
        assert why is None, why


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
