import __spark_entry__ as entry
import pytest

from lagweave.plans import fusion_queries, panel_queries, study_queries

from .compare import same

SQL = panel_queries.oracle_sql() | fusion_queries.oracle_sql() | study_queries.oracle_sql()
QUERIES = panel_queries.queries() | fusion_queries.queries() | study_queries.queries()


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.001")


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert SQL.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()
