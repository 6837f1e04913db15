"""Physical-plan hygiene of every registered query: no cross products or
nested-loop joins, partial group limits for top-k per group, pruned scans."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

SMOKE = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product_or_nested_loop_join(spark, name):
    plan = _plan(QUERIES[name](spark, SMOKE))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["conversation_window", "conversation_window_newest", "match_asset"])
def test_topk_per_group_has_partial_limit(spark, name):
    plan = _plan(QUERIES[name](spark, SMOKE))
    assert plan.count("WindowGroupLimit") >= 2  # partial before the exchange, final after


def test_flagship_scans_only_needed_columns(spark):
    plan = _plan(QUERIES["ticket_stats_daily"](spark, SMOKE))
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in plan
    assert "o_totalprice" not in plan and "c_acctbal" not in plan
