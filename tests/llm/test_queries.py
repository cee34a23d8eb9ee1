import pytest

from lagweave.llm import queries

from ..compare import same


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001")


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
