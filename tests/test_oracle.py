"""Every registered query against its DuckDB SQL (names, row count, values), as the driver checks."""

import pytest

from basin.plans import io_queries, order_queries, time_queries  # noqa: F401
from basin.plans.queries import ORACLE, QUERIES
from tests.oracle_check import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    res = compare(spark, sf_dir, [name], con=con, verbose=False)[name]
    if name in ORACLE:
        assert res[0] == "ok", res
    else:
        assert res[0] == "rows-only", res


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.queries()) >= set(entry.oracle_sql())
