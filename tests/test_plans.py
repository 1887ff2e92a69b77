import re

import pytest

from flowtide.functions import buckets
from flowtide.operators import condense
from flowtide.plans import dashboard, flows
from flowtide.operators.filters import FlowFilter
from flowtide.sources import jsonl


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_condensing_hashes_and_combines_before_the_shuffle(inputs):
    text = plan(condense.condense(inputs.flows, buckets.minute))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text.split("Exchange hashpartitioning")[1]


def test_conversation_sums_stay_in_hash_aggregation(inputs):
    from flowtide.plans import conversations

    text = plan(conversations.by_ip(inputs.tables(), FlowFilter(hours=6), inputs.as_of))
    assert "SortAggregate" not in text and "TakeOrderedAndProject" in text


def test_time_filter_reaches_below_the_aggregations(inputs):
    text = plan(flows.selected(inputs.tables(), FlowFilter(hours=1), inputs.as_of))
    below = text.split("Exchange hashpartitioning")[-1]
    assert "Filter" in below


def test_top_lists_take_ordered(inputs):
    text = plan(dashboard.top(inputs.tables(), "src", inputs.as_of))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_names_join_the_page_not_the_table(inputs):
    text = plan(flows.listing(inputs.tables(), FlowFilter(hours=6), inputs.as_of, sort="bytes"))
    assert text.index("BroadcastHashJoin") < text.index("SortAggregate")
    below = text.split("Exchange hashpartitioning", 1)[1]
    assert "BroadcastHashJoin" not in below


def test_reading_lines_stays_in_the_jvm_and_parses_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"src_addr":"::1"}\n')
    text = plan(condense.condense(jsonl.read_flows(spark, str(tmp_path)), buckets.minute, True))
    assert "EvalPython" not in text
    assert len(re.findall("try_parse_json|parsejson", text, re.I)) == 1


QUERIES = [
    "agg_conversations_5m", "agg_interface_1m", "flows_list", "top_app", "top_interfaces", "dashboard_summary",
    "history_view", "ip_labels", "interface_inventory", "stats_conversations_interface", "rebuild_interface",
]


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_joins_and_no_python(spark, name):
    import __spark_entry__ as entry

    text = plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert not re.search("BroadcastNestedLoopJoin|CartesianProduct|EvalPython", text)
