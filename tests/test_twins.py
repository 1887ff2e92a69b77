"""A cross-section of the registered queries against their SQL twins.

``python tests/compare.py <folder>`` runs all of them.
"""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "agg_conversations_5m", "agg_stats_5m", "agg_interface_1m", "agg_app_1m", "flt_if_text", "flt_stats",
    "join_stats_if", "dashboard_summary", "top_app", "top_exporter", "top_interfaces", "device_timeseries",
    "flows_list", "flows_summary_destination", "conversations_ip", "conversations_interface", "stats_flows",
    "smart_period_flows", "exporters_list", "interface_inventory", "interface_refresh", "dim_edits_apply",
    "src_jsonl_batch", "src_jsonl_stream", "stream_exactly_once", "rebuild_app", "purge_report",
]


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    assert difference(spark, duck, name, SF_DIR) is None


def test_every_query_has_a_twin():
    from flowtide.workload.registry import QUERIES, TWINS

    assert set(QUERIES) == set(TWINS)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
