"""Joins whose sides both grow with the requests are never broadcast, however small the files are that they come from."""

import pytest

from sondage.plans import registry

D = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e8_unsupported_numbers", "e12_repair_answers"])
def test_answers_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in _plan(registry.queries()[name](spark, D))


def test_facets_and_mentions_are_not_broadcast(spark):
    """Joins on requests, their parts and facets are merges; of mentions, only the labels' side may be broadcast."""
    plan = _plan(registry.queries()["e5_evaluate_coverage"](spark, D))
    joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
    assert joins and not [line for line in joins if "query_id" in line or "text_id" in line]
    used = [line for line in plan.split("\n") if "SortMergeJoin [bounded" in line or "SortMergeJoin [key" in line]
    assert used


def test_customers_are_dealt_over_tasks(spark):
    """A small file is one task otherwise; what a question's steps share is computed once."""
    df = registry.queries()["r19_query_variants"](spark, D)
    assert "REPARTITION_BY_NUM" in _plan(df)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("_held") >= 3
