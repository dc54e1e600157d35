"""The registered text queries against their SQL: given tables, awkward tables and empty tables."""

import pytest
from compare import difference

from stayline.llm.oracle import ORACLE_SQL
from stayline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_given_tables(spark, duck_of, name):
    assert difference(spark, duck_of(SF), QUERIES[name], ORACLE_SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_awkward_tables(spark, duck_of, awkward, name):
    assert difference(spark, duck_of(awkward), QUERIES[name], ORACLE_SQL[name], awkward) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
