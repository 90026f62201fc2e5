"""Registered queries of the training-data operators against their SQL."""

import pytest

import __spark_entry__ as entry
from check_queries import differences, duck
from wakeline.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert set(queries.SQL) <= set(queries.QUERIES) <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert differences(got, duck(SF).execute(queries.SQL[name]).df()) == []
