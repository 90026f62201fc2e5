"""Every registered query against its SQL, and checks of the plans."""

import pytest

import __spark_entry__ as entry
from check_queries import differences, duck
from wakeline.catalog import oracle, registry

SF = "/root/testdata/sf0.001"
SQL = oracle.SQL


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) - set(SQL) <= {"model_forecast", "growth_model"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, con.execute(SQL[name]).df()) == []


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "video_id"


@pytest.mark.parametrize("name", ["shared_videos", "feature_matrix", "sentiment_comparison_video", "latest_n"])
def test_no_cross_joins(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["shared_videos", "video_engagement_url"])
def test_distinct_counts_do_not_multiply_rows(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_top_k_is_pruned_before_the_shuffle(spark):
    plan = entry.queries()["latest_n"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
