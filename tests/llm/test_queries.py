"""The queries of the training-data operators that SQL can express, and that all of them are registered."""

import pytest

import __spark_entry__
from tessella.llm.queries import ORACLE_SQL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, __spark_entry__.queries()[name], ORACLE_SQL[name], "/root/testdata/sf0.01")


def test_all_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
