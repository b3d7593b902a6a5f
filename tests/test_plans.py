"""Plan shape checks: no cartesian products or nested-loop joins in the read
operators, map-side top-k for the per-district top balance."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

READS = ["order_status", "stock_level", "popular_items", "popular_item_pct", "top_balance",
         "top_balance_by_district", "related_customers", "related_pairs", "oldest_pending", "order_amount"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", READS)
def test_no_cartesian(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_window_group_limit(spark):
    p = _plan(E.queries()["top_balance_by_district"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_top_balance_take_ordered(spark):
    p = _plan(E.queries()["top_balance"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
