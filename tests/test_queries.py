"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import pytest
from compare import oracle_rows, query_rows

from sievelight.plans.catalog import QUERIES
from sievelight.plans.oracle import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert query_rows(QUERIES[name](spark, sf_dir)) == oracle_rows(ORACLE_SQL[name], sf_dir)
