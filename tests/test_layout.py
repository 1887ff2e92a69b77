"""What a read lists and opens, levels and sketches, replays on other days, upkeep."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from test_condense import DAY, check, flow, found, frame, random_flows
from test_plans import plan

from brute import conversations
from flowtide.jobs import compact, rebuild, upkeep
from flowtide.operators.filters import FlowFilter
from flowtide.plans import conversations as talks
from flowtide.plans import dashboard, flows, history, statistics
from flowtide.sources import files
from flowtide.sources.store import COMPACTED, TableStore
from flowtide.streaming import ingest


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "tables"))


def days_of_flows(days, per_day=30):
    gap = 86_400 // per_day
    return [flow(n, DAY + timedelta(seconds=n * gap), exporter=f"192.0.2.{1 + n % 3}") for n in range(days * per_day)]


def test_a_read_lists_its_own_days_and_opens_the_batches_it_meets(store, monkeypatch):
    for n in range(16):
        rows = store.spark.createDataFrame([(DAY + timedelta(hours=6 * n, minutes=k), 1, 1, 1) for k in range(3)], "bucket timestamp, bytes long, packets long, flows long")
        store.append("total_1m", rows, n)
    listed, real = [], files.subdirs

    def counted(spark, path, prefix=""):
        listed.append(path)
        return real(spark, path, prefix)

    monkeypatch.setattr(files, "subdirs", counted)
    low = DAY + timedelta(hours=12)
    rows = store.partials("total_1m", low, low + timedelta(hours=1))
    assert len(listed) == 2  # the table and one of four days
    assert {f.rsplit("/", 1)[0].rsplit("batch=", 1)[1] for f in rows.inputFiles()} == {"2"}
    assert rows.count() == 3
    # Without notes the same rows come from more files.
    files.drop(store.spark, f"{store.root}/_zones")
    rows = store.partials("total_1m", low, low + timedelta(hours=1))
    assert len(rows.inputFiles()) > 1 and rows.count() == 3


def test_a_batch_that_comes_again_on_other_days_leaves_nothing(store):
    first = [flow(n, DAY + timedelta(days=n % 2)) for n in range(10)]
    ingest.ingest_flows(store, frame(store.spark, first), 0)
    again = [flow(n, DAY + timedelta(days=3 + n % 2)) for n in range(10)]
    ingest.ingest_flows(store, frame(store.spark, again), 0)
    check(found(store.conversations()), conversations(again))
    assert store.rollup("total_1m").agg(F.sum("flows")).first()[0] == 10
    assert len(store.zones("total_1m", store.days("total_1m")[-1])) == 1
    ingest.ingest_flows(store, frame(store.spark, []), 0)
    assert store.rollup("total_1m").count() == 0 and store.batch("conversations", 0) is None


def test_windows_from_levels_equal_minutes(store):
    rows = days_of_flows(5, 240)
    ingest.ingest_flows(store, frame(store.spark, rows), 0)
    ingest.ingest_flows(store, frame(store.spark, [flow(9_000 + n, DAY + timedelta(days=n, hours=5)) for n in range(4)]), 1)
    compact.compact(store)
    sums = lambda r: tuple(r.agg(F.sum("bytes"), F.sum("packets"), F.sum("flows"), F.min("first"), F.max("last")).first())
    for low, high in ((None, None), (DAY, None), (DAY + timedelta(hours=30, minutes=7), DAY + timedelta(days=3, minutes=59)),
                      (DAY + timedelta(minutes=1), DAY + timedelta(minutes=2)), (DAY + timedelta(days=1), DAY + timedelta(days=2) - timedelta(microseconds=1))):
        minutes = store.rollup("exporter_1m", low, high).withColumns({"first": F.col("bucket"), "last": F.col("bucket")})
        for grain in (3_600, 86_400):
            assert sums(store.spans("exporter_1m", low, high, grain)) == sums(minutes), (low, high, grain)
    start = datetime(DAY.year, DAY.month, DAY.day)
    whole = store.spans("total_1m", start, start + timedelta(days=9)).count()
    assert whole * 50 < store.rollup("total_1m", start, start + timedelta(days=9)).count()
    # A replay of the open batch and a second folding change nothing.
    before = sums(store.spans("exporter_1m"))
    ingest.ingest_flows(store, frame(store.spark, [flow(9_000 + n, DAY + timedelta(days=n, hours=5)) for n in range(4)]), 1)
    compact.compact(store)
    assert sums(store.spans("exporter_1m")) == before
    as_of = DAY + timedelta(days=5)
    view = history.view(store, "exporter", as_of, 24, 365).collect()
    kept = [r for r in rows if r["received_at"] < as_of - timedelta(hours=24)]
    assert sum(r.flows for r in view) == len(kept) + 4
    assert min(r.first_bucket for r in view) == DAY.replace(tzinfo=None)


def test_sketches_count_without_reading_keys(store):
    rows = [flow(n, DAY + timedelta(seconds=n), src_addr=f"10.{n % 7}.{n % 250}.9") for n in range(3_000)]
    for batch in range(2):
        ingest.ingest_flows(store, frame(store.spark, rows[batch::2]), batch)
    as_of = DAY + timedelta(hours=2)
    exact = dashboard.summary(store, as_of).first()
    for folded in (False, True):
        if folded:
            compact.compact(store)
        near = dashboard.summary_approx(store, as_of)
        text = plan(near)
        assert "src_addr" not in text and "sources:binary" in text
        got = near.first()
        for name in ("exporters", "sources", "destinations"):
            assert abs(got[name] - exact[name]) <= 1 + 0.016 * exact[name]
    rebuild.rebuild_sketches(store)
    assert dashboard.summary_approx(store, as_of).first() == got
    assert dashboard.summary_approx(store, as_of + timedelta(days=3)).first().sources == 0


def test_sums_meet_one_wide_shuffle(store):
    for batch in range(2):
        ingest.ingest_flows(store, frame(store.spark, random_flows(60, batch)), batch)
    as_of = DAY + timedelta(hours=6)
    assert plan(statistics.summary(store, FlowFilter())).count("Exchange hashpartitioning") == 1
    # One exchange sums; the other merges only rows without a service.
    assert plan(talks.by_ip(store, FlowFilter(), as_of)).count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("hours", [2])
def test_sums_without_merge_equal_merged_ones(store, hours):
    rows = random_flows(500, 31)
    for batch in range(3):
        ingest.ingest_flows(store, frame(store.spark, rows[batch::3]), batch)
    as_of = rows[-1]["received_at"] + timedelta(minutes=1, seconds=7)
    for flt in (FlowFilter(hours=hours), FlowFilter(hours=hours, port=0), FlowFilter(hours=hours, q="0"),
                FlowFilter(date_from=as_of - timedelta(hours=hours), date_to=as_of - timedelta(minutes=13))):
        columns = ["src_addr", "dst_addr", "proto", "src_port", "dst_port", "service_port"]
        sums = [
            sorted(map(str, r.groupBy(*columns).agg(F.sum("bytes"), F.sum("flow_count"), F.min("first_seen"), F.max("last_seen")).collect()))
            for r in (flows.summable(store, flt, as_of), flows.selected(store, flt, as_of))
        ]
        assert sums[0] == sums[1]


def test_upkeep_between_batches(store, tmp_path):
    source, clock = tmp_path / "in", [DAY.replace(tzinfo=timezone.utc) + timedelta(days=40)]
    calls = upkeep.Upkeep(timedelta(hours=1), lambda: clock[0], detailed_hours=24, stats_days=30)
    for n in range(4):
        frame(store.spark, [flow(n, DAY + timedelta(days=13 * n))]).coalesce(1).write.mode("append").parquet(str(source))
    query = ingest.start_from_flows(store.spark, str(source), store, str(tmp_path / "cp"), True, 1, calls)
    query.awaitTermination()
    assert calls.last == clock[0] and not calls(store)
    clock[0] += timedelta(hours=1)
    assert calls(store)
    assert len(store.days("total_1m")) == 3 and len(store.days("batch_log")) == 3
    assert {b for found in store.partitions("total_1m").values() for b in found} == {COMPACTED, 3}


def test_hidden_rows_of_a_folded_day_go_when_it_is_folded_again(store):
    ingest.ingest_flows(store, frame(store.spark, days_of_flows(1, 24)), 0)
    ingest.ingest_flows(store, frame(store.spark, [flow(99, DAY + timedelta(days=1))]), 1)
    compact.compact(store)
    store.set_horizon("total_1m", datetime(DAY.year, DAY.month, DAY.day) + timedelta(hours=18))
    compact.compact(store)
    day = store.days("total_1m")[0]
    assert store.batches("total_1m", day) == [COMPACTED]
    left = store.spark.read.parquet(f"{store.path('total_1m')}/d={day}/batch=-1")
    assert left.count() == 6 and store.spans("total_1m").agg(F.sum("flows")).first()[0] == 19


def test_folded_days_answer_host_filters_from_few_row_groups(store):
    spark = store.spark
    rows = [
        flow(n, DAY + timedelta(seconds=n % 3000), src_addr=f"10.0.{n % 97}.{n % 241}", dst_addr=f"198.51.{n % 89}.{n % 239}", exporter=f"192.0.{n % 13}.{n % 17}")
        for n in range(20_000)
    ]
    folded = spark.createDataFrame(
        [(r["received_at"], r["exporter"], r["src_addr"], r["dst_addr"], 6, 443, "", 1, 2, 10, 1, 1) for r in rows], "bucket_start timestamp, exporter string,"
        " src_addr string, dst_addr string, proto int, service_port int, service_side string, in_if int, out_if int, bytes long, packets long, flows long",
    ).withColumn("batch", F.lit(COMPACTED).cast("long"))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in ("parquet.block.size", "parquet.page.size.row.check.min", "parquet.block.row.count.limit"):
        hadoop.set(name, "50")
    try:
        store.replace_days("statistics", folded, [])
    finally:
        for name in ("parquet.block.size", "parquet.page.size.row.check.min", "parquet.block.row.count.limit"):
            hadoop.unset(name)
    for column, value in (("src_addr", "10.0.5.5"), ("dst_addr", "198.51.7.7"), ("exporter", "192.0.3.3")):
        got = store.partials("statistics").filter(F.col(column) == value)
        assert got.collect() and {x[column] for x in got.collect()} == {value}
        assert got.count() == sum(r[column] == value for r in rows)
        got = got.select("bytes", column)
        got.collect()
        scan = got._jdf.queryExecution().executedPlan()
        while scan.children().size():
            scan = scan.children().apply(0)
        read = scan.metrics().apply("numOutputRows").value()
        assert read < len(rows) / 4, (column, read)
