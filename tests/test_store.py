import json
import shutil
from datetime import datetime, timedelta

import pytest
from brute import conversations
from pyspark.sql import functions as F
from test_condense import DAY, check, flow, found, frame, random_flows

from flowtide.jobs import compact, purge, rebuild, retention
from flowtide.operators import dimensions, rollups
from flowtide.operators.filters import FlowFilter
from flowtide.plans import flows as flow_reports
from flowtide.sources import files, jsonl
from flowtide.sources.store import COMPACTED, TableStore
from flowtide.streaming import ingest

HERE = __file__.rsplit("/", 1)[0]


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "tables"))


def fill(store, flows, batches=3):
    for n in range(batches):
        ingest.ingest_flows(store, frame(store.spark, flows[n::batches]), n)


def totals(store):
    return {
        name: tuple(store.merged(name).agg(*(F.sum(c) for c in rollups.MEASURES)).first())
        for name in (*rollups.ROLLUP_NAMES, "statistics")
    }


def test_golden_lines(spark):
    parsed = jsonl.parse(jsonl.read_lines(spark, f"{HERE}/data/raw_flows.jsonl"))
    rows = jsonl.normalize(parsed)
    good = jsonl.good_flows(rows).orderBy("seq").collect()
    assert [r.src_addr for r in good] == ["10.0.0.5", "2001:db8::1", None, None]
    assert [r.bytes for r in good] == [1500, 80, 64, 0]
    assert [r.packets for r in good] == [3, 1, 0, 0]
    assert [r.proto for r in good] == [6, 17, 1, 58]
    assert [r.exporter for r in good] == ["192.0.2.1", "192.0.2.1", None, None]
    assert [r.flow_type for r in good] == ["NETFLOW_V9", "IPFIX", "", "None"]
    assert good[3].src_port is None
    assert good[0].flow_time == datetime(2023, 11, 14, 22, 13, 20, 123456)
    refused = sorted((r.reason, r.value) for r in jsonl.quarantine(rows).collect())
    assert [r[0] for r in refused] == ["bad address"] + ["malformed"] * 4


def test_stream_of_lines_quarantines_and_counts(spark, store, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    shutil.copy(f"{HERE}/data/raw_flows.jsonl", source / "a.jsonl")
    ingest.start(spark, str(source), store, str(tmp_path / "cp"), drain=True).awaitTermination()
    (source / "b.jsonl").write_text(json.dumps({"proto": "udp", "bytes": 5, "dst_port": 53}) + "\n")
    ingest.start(spark, str(source), store, str(tmp_path / "cp"), drain=True).awaitTermination()
    assert store.partials("quarantine").count() == 5
    assert [r["count"] for r in store.partials("batch_log").orderBy("batch").collect()] == [4, 1]
    assert store.conversations().agg(F.sum("flow_count")).first()[0] == 5
    assert {r.ip for r in store.exporters.collect()} == {"192.0.2.1"}


def test_batches_replay_and_compaction_change_nothing(store):
    flows = random_flows(600, 11)
    fill(store, flows)
    want, sums = conversations(flows), totals(store)
    check(found(store.conversations()), want)
    ingest.ingest_flows(store, frame(store.spark, flows[1::3]), 1)
    check(found(store.conversations()), want)
    compact.compact(store)
    day = store.days("conversations")[0]
    assert store.batches("conversations", day) == [COMPACTED, 2]
    check(found(store.conversations()), want)
    assert totals(store) == sums
    # The newest batch may come again and still replaces itself.
    ingest.ingest_flows(store, frame(store.spark, flows[2::3]), 2)
    check(found(store.conversations()), want)
    assert totals(store) == sums


def test_compacted_rows_are_read_without_merging_where_nothing_came_later(store):
    old = [flow(n, DAY + timedelta(seconds=n)) for n in range(50)]
    new = [flow(100 + n, DAY + timedelta(hours=2, seconds=n)) for n in range(50)]
    for batch, rows in enumerate((old[:25], old[25:], new)):
        ingest.ingest_flows(store, frame(store.spark, rows), batch)
    compact.compact(store)
    check(found(store.conversations()), conversations(old + new))
    compact.compact_day(store, "conversations", store.days("conversations")[0])
    plan = store.conversations()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    check(found(store.conversations()), conversations(old + new))


def test_day_partitions_prune(spark, store):
    for n in range(4):
        ingest.ingest_flows(store, frame(spark, [flow(n, DAY + timedelta(days=n))]), n)
    as_of = DAY + timedelta(days=3)
    rows = flow_reports.selected(store, FlowFilter(hours=3), as_of)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.splitlines() if "FileScan parquet" in x)
    partition = line.split("PartitionFilters: [")[1].split("]")[0]
    assert "d#" in partition and ">=" in partition
    assert "GreaterThanOrEqual(bucket_start" in plan
    assert rows.count() == 1


def test_retention_keeps_whole_conversations(store):
    flows = random_flows(800, 12)
    fill(store, flows)
    as_of = flows[-1]["received_at"] + timedelta(minutes=45)
    cutoff = as_of - timedelta(hours=1)
    retention.expire_conversations(store, as_of, 1)
    want = {k: v for k, v in conversations(flows).items() if v["last_seen"] >= cutoff}
    assert 0 < len(want) < len(conversations(flows))
    check(found(store.conversations()), want)
    # Compaction removes the hidden buckets; what readers see stays the same.
    hidden = F.col("bucket_start") < F.lit(cutoff - timedelta(minutes=5))
    stored = store.spark.read.parquet(store.path("conversations"))
    assert stored.filter(hidden).count() > 0
    for day in store.days("conversations"):
        compact.compact_day(store, "conversations", day)
    stored = store.spark.read.parquet(store.path("conversations"))
    assert stored.filter(hidden).count() == 0
    check(found(store.conversations()), want)


def test_retention_drops_days(store):
    for n in range(4):
        ingest.ingest_flows(store, frame(store.spark, [flow(n, DAY + timedelta(days=n))]), n)
    retention.expire_statistics(store, DAY + timedelta(days=3), 2)
    assert len(store.days("statistics")) == 3 and len(store.days("total_1m")) == 3
    assert len(store.days("conversations")) == 4


def test_purge(store):
    flows = random_flows(500, 13)
    fill(store, flows)
    late = flows[-1]["received_at"] + timedelta(hours=1)
    with pytest.raises(RuntimeError):
        purge.purge(store, "192.0.2.1", flows[-1]["received_at"])
    with pytest.raises(LookupError):
        purge.purge(store, "192.0.2.77", late)
    counts = purge.purge(store, "192.0.2.1", late).first()
    gone = [f for f in flows if f["exporter"] == "192.0.2.1"]
    left = [f for f in flows if f["exporter"] != "192.0.2.1"]
    assert counts.deleted_flows == len(gone)
    check(found(store.conversations()), conversations(left))
    assert {r.ip for r in store.exporters.collect()} == {"192.0.2.2"}
    assert store.rollup("exporter_1m").filter("exporter = '192.0.2.1'").count() == 0
    assert totals(store)["total_1m"] == (sum(f["bytes"] for f in left), sum(f["packets"] for f in left), len(left))


def test_history_survives_a_purge_only_when_kept(store):
    """Statistics stand in for conversations that have expired."""
    old = [flow(n, DAY + timedelta(seconds=n), exporter=f"192.0.2.{1 + n % 2}") for n in range(10)]
    new = [flow(100, DAY + timedelta(days=2))]
    ingest.ingest_flows(store, frame(store.spark, old), 0)
    ingest.ingest_flows(store, frame(store.spark, new), 1)
    as_of = DAY + timedelta(days=2, hours=1)
    retention.expire_conversations(store, as_of, 24)
    purge.purge(store, "192.0.2.2", as_of)
    assert totals(store)["total_1m"][2] == 6
    rebuild.rebuild_rollups(store)
    assert totals(store)["total_1m"][2] == 1


def test_an_interrupted_swap_is_finished(spark, store, tmp_path):
    fill(store, random_flows(60, 14), 1)
    before, day = totals(store), store.days("total_1m")[0]
    staged, target = f"{store.staging}/x", store.path("total_1m")
    name = f"d={day}/batch=0"
    shutil.copytree(f"{target}/{name}", f"{staged}/{name}")
    files._write_text(spark, f"{staged}/{files.PLAN_FILE}", json.dumps({"target": target, "replaced": [name], "new": [name]}))
    shutil.rmtree(f"{target}/{name}")
    (tmp_path / "tables/_staging/half").mkdir()
    store.recover()
    assert totals(store) == before
    assert files.subdirs(spark, store.staging) == []


def test_backfill_only_into_empty_statistics(store):
    flows = random_flows(200, 15)
    ingest.ingest_flows(store, frame(store.spark, flows), 0)
    want = totals(store)["statistics"]
    for day in store.days("statistics"):
        store.drop_day("statistics", day)
    rebuild.backfill(store)
    rebuild.backfill(store)
    assert totals(store)["statistics"] == want


def test_maintenance_then_replay_counts_once(store):
    flows = random_flows(120, 21)
    fill(store, flows)
    want = totals(store)
    last = frame(store.spark, flows[2::3])
    rebuild.rebuild_rollups(store)
    ingest.ingest_flows(store, last, 2)
    assert {n: t[2] for n, t in totals(store).items() if n in ("total_1m", "statistics")} == {n: want[n][2] for n in ("total_1m", "statistics")}
    for day in store.days("statistics"):
        store.drop_day("statistics", day)
    rebuild.backfill(store)
    ingest.ingest_flows(store, last, 2)
    assert totals(store)["statistics"] == want["statistics"]


def test_an_unfinished_first_batch_is_not_folded(store):
    flows = random_flows(60, 22)
    ingest.ingest_flows(store, frame(store.spark, flows), 0)
    want = totals(store)
    for day in store.days("batch_log"):
        store.drop_day("batch_log", day)
    compact.compact(store)
    ingest.ingest_flows(store, frame(store.spark, flows), 0)
    assert totals(store) == want


def test_purge_at_the_retention_edge(store):
    flows = [flow(n, DAY + timedelta(seconds=20 * n), exporter=f"192.0.2.{1 + n % 2}") for n in range(40)]
    ingest.ingest_flows(store, frame(store.spark, flows), 0)
    as_of = DAY + timedelta(hours=1, minutes=3)
    retention.expire_conversations(store, as_of, 1)
    purge.purge(store, "192.0.2.2", as_of)
    assert totals(store)["total_1m"][2] == totals(store)["exporter_1m"][2] == totals(store)["statistics"][2] == 20


def test_purge_without_visible_conversations_and_again_after_a_crash(store, monkeypatch):
    flows = [flow(n, DAY + timedelta(seconds=n), exporter=f"192.0.2.{1 + n % 2}") for n in range(10)]
    ingest.ingest_flows(store, frame(store.spark, flows), 0)
    as_of = DAY + timedelta(hours=20)
    retention.expire_conversations(store, as_of, 1)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(purge, "rebuild_rollups", crash)
        with pytest.raises(OSError):
            purge.purge(store, "192.0.2.2", as_of)
    purge.purge(store, "192.0.2.2", as_of)
    assert totals(store)["total_1m"][2] == totals(store)["exporter_1m"][2] == 5
    assert {r.ip for r in store.exporters.collect()} == {"192.0.2.1"}


def test_name_edits(spark):
    known = spark.createDataFrame([("192.0.2.1", None, None, "h", "old", None)], "ip string, first_seen timestamp, last_seen timestamp, hostname string, custom_name string, sys_descr string")
    edits = spark.createDataFrame([("192.0.2.1/32", " new ", 1), ("192.0.2.1", "  ", 2), ("192.0.2.9", "x", 3)], "ip string, name string, edit_seq long")
    assert [(r.ip, r.custom_name) for r in dimensions.apply_exporter_names(known, edits).collect()] == [("192.0.2.1", None)]
    names = spark.createDataFrame([("10.0.0.1", "a")], "ip string, name string")
    ips = spark.createDataFrame([("2001:DB8::1", " b ", 1), ("10.0.0.1", "c", 2)], "ip string, name string, edit_seq long")
    assert sorted(tuple(r) for r in dimensions.apply_ip_names(names, ips).collect()) == [("10.0.0.1", "c"), ("2001:db8::1", "b")]
    assert dimensions.delete_ip_names(names, ips.select("ip")).count() == 0


def test_interface_names_and_refused_edits(spark):
    from flowtide import schemas

    known = spark.createDataFrame([], schemas.INTERFACES)
    edits = spark.createDataFrame([("192.0.2.1", 7, " wan ", 1)], "exporter string, if_index int, name string, edit_seq long")
    row = dimensions.apply_interface_names(known, edits).first()
    assert (row.exporter, row.if_index, row.custom_name) == ("192.0.2.1", 7, "wan")
    ports = spark.range(1, 502).selectExpr(
        "6 as proto", "int(id) as port", "'x' as description", "id as edit_seq", "'big' as request_id"
    ).unionByName(spark.sql("select 6 as proto, 600 as port, 'y' as description, 1L as edit_seq, 'ok' as request_id"))
    assert dimensions.valid_port_edits(ports).count() == 502  # a request of any size
    bad = spark.sql("""select * from values (6, 70000, 'x'), (300, 1, 'x'), (6, 1, ' '), (cast(null as int), 1, 'x'), (6, 1, 'x')
        as t(proto, port, description)""")
    assert sorted(r.reason for r in dimensions.refused_port_edits(bad).collect()) == [
        "description not of 1 to 100 characters", "port outside 1..65535", "protocol outside 0..255", "protocol outside 0..255"
    ]
    assert dimensions.valid_port_edits(bad).count() == 1
    described = spark.createDataFrame([(6, 600, "y")], "proto int, port int, description string")
    assert dimensions.delete_port_descriptions(described, described).count() == 0


def test_polled_device_names(spark):
    from flowtide import schemas

    known = spark.createDataFrame([("192.0.2.1", None, None, "old", "mine", None), ("192.0.2.2", None, None, "b", None, None)], schemas.EXPORTERS)
    polls = spark.createDataFrame([("192.0.2.1/32", 'STRING: "gw"', "router 7.1")], "ip string, hostname string, sys_descr string")
    rows = {r.ip: (r.hostname, r.custom_name, r.sys_descr) for r in dimensions.refresh_exporters(known, polls).collect()}
    assert rows == {"192.0.2.1": ("gw", "mine", "router 7.1"), "192.0.2.2": ("b", None, None)}


def test_storage_figures(store):
    from flowtide.jobs import reports

    fill(store, random_flows(100, 16), 1)
    row = reports.storage(store.conversations()).first()
    assert row.aggregated_flows == 100 and 0 < row.service_coverage <= 1
    sizes = reports.table_bytes(store)
    assert sizes["conversations"] > 0 and sizes["quarantine"] == 0
