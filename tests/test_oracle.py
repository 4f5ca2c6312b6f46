"""Every log query against its SQL over the smallest tables."""

import pytest
from conftest import rows_of

from siltlog.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    assert rows_of(QUERIES[name](spark, sf).toPandas()) == rows_of(duck.execute(ORACLE[name]).df())


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(ORACLE) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["start", "group", "count"]
