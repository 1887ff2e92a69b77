import random
from datetime import datetime, timedelta

from brute import META, conversations

from flowtide import schemas
from flowtide.functions import buckets
from flowtide.jobs import rebuild
from flowtide.operators import condense, rollups

DAY = datetime(2024, 5, 1, 12)


def frame(spark, flows):
    rows = [tuple(f.get(n) for n in schemas.FLOWS.names) for f in flows]
    return spark.createDataFrame(rows, schemas.FLOWS)


def flow(seq, at, **more):
    base = dict.fromkeys(schemas.FLOWS.names)
    base |= {
        "seq": seq, "received_at": at, "exporter": "192.0.2.1", "flow_type": "IPFIX",
        "src_addr": "10.0.0.5", "dst_addr": "198.51.100.7", "src_port": 51000, "dst_port": 443,
        "proto": 6, "bytes": 1, "packets": 1, "in_if": 1, "out_if": 2,
    }
    return base | more


def found(df):
    rows = {}
    for r in df.collect():
        row = r.asDict()
        rows[(row.pop("bucket_start"), row.pop("conv_key"))] = row
    return rows


def random_flows(count, seed):
    rng = random.Random(seed)
    out, at = [], DAY
    for seq in range(count):
        at += timedelta(seconds=rng.choice([0, 1, 7]), microseconds=rng.randrange(5))
        out.append(
            flow(
                seq, at,
                exporter=rng.choice(["192.0.2.1", "192.0.2.2", None]),
                src_addr=rng.choice(["10.0.0.1", "2001:db8::1", None]),
                dst_addr=rng.choice(["198.51.100.1", "198.51.100.2"]),
                src_port=rng.choice([None, 0, 22, 443, 40000, 41000]),
                dst_port=rng.choice([None, 0, 53, 443, 9200, 50000]),
                proto=rng.choice([1, 6, 17, None]), bytes=rng.randrange(1000), packets=rng.randrange(9),
                in_if=rng.choice([None, 0, 1]), out_if=rng.choice([None, 1]),
                src_as=rng.choice([None, 1, 2]), dst_as=rng.choice([None, 3]),
                src_country=rng.choice([None, "", "LT"]), dst_country=rng.choice([None, "DE", "US"]),
                sampling_rate=rng.choice([None, 100, 1000]), tcp_flags=rng.choice([None, 2, 16, 24]),
                flow_type=rng.choice(["IPFIX", "NETFLOW_V9"]),
                flow_time=rng.choice([None, at - timedelta(seconds=rng.randrange(60))]),
            )
        )
    return out


def check(got, want):
    assert set(got) == set(want)
    for key, row in want.items():
        mine = got[key]
        assert {n: mine[n] for n in row} == row
        assert mine["received_at"] == mine["last_seen"]


def test_merge_example(spark):
    flows = [
        flow(1, DAY + timedelta(minutes=1, seconds=10), src_port=51000, bytes=100, packets=1, tcp_flags=2),
        flow(2, DAY + timedelta(minutes=3), src_port=51044, bytes=200, packets=2),
        flow(3, DAY + timedelta(minutes=4, seconds=59), src_port=51999, bytes=300, packets=3, tcp_flags=24),
        flow(4, DAY + timedelta(minutes=5), src_port=51000, bytes=400, packets=4, tcp_flags=16),
    ]
    rows = condense.conversations_5m(frame(spark, flows)).orderBy("bucket_start").collect()
    assert len(rows) == 2
    first, second = rows
    assert (first.src_port, first.dst_port, first.service_port, first.service_side) == (None, 443, 443, "destination")
    assert (first.bytes, first.packets, first.flow_count, first.tcp_flags) == (600, 6, 3, 24)
    assert first.received_at == first.last_seen == DAY + timedelta(minutes=4, seconds=59)
    assert (second.bytes, second.flow_count, second.tcp_flags) == (400, 1, 16)


def test_single_pass_equals_model(spark):
    flows = random_flows(1500, 1)
    check(found(condense.conversations_5m(frame(spark, flows).repartition(4))), conversations(flows))


def test_any_split_into_batches_gives_the_same(spark):
    flows, rng = random_flows(800, 2), random.Random(5)
    parts = [[] for _ in range(3)]
    for f in flows:
        rng.choice(parts).append(f)
    stored = None
    for part in parts:
        rows = condense.condense(frame(spark, part), buckets.minute)
        stored = rows if stored is None else stored.unionByName(rows)
    once = condense.merge(stored)
    check(found(condense.finish(once)), conversations(flows))
    check(found(condense.finish(condense.merge(once))), conversations(flows))


def test_landing_time_orders_before_line_number(spark):
    """With a file's landing time as lane, line numbers only count inside a file."""
    early, late = DAY + timedelta(seconds=1), DAY + timedelta(seconds=2)
    flows = [flow(900, early, tcp_flags=2, src_country="LT"), flow(5, late, tcp_flags=16, src_country="DE")]
    row = condense.conversations_5m(frame(spark, flows), arrival_lane=True).first()
    assert (row.tcp_flags, row.src_country, row.flow_count) == (16, "DE", 2)


def test_directions_and_interfaces_stay_apart(spark):
    flows = [
        flow(1, DAY), flow(2, DAY, src_addr="198.51.100.7", dst_addr="10.0.0.5"), flow(3, DAY, out_if=3),
        flow(4, DAY, exporter="192.0.2.9"),
    ]
    assert condense.conversations_5m(frame(spark, flows)).count() == 4


def test_first_zero_or_missing_port_is_kept(spark):
    flows = [flow(1, DAY, src_port=0, dst_port=None, proto=1), flow(2, DAY, src_port=None, dst_port=0, proto=1)]
    row = condense.conversations_5m(frame(spark, flows)).first()
    assert (row.src_port, row.dst_port, row.flow_count) == (0, None, 2)


def test_hairpin_counts_once_live_and_twice_rebuilt(spark):
    flows = frame(spark, [flow(1, DAY, in_if=1, out_if=1, bytes=10), flow(2, DAY, in_if=2, out_if=None, bytes=10)])
    live = {r.if_index: r.bytes for r in rollups.roll_up(flows, "interface_1m").collect()}
    again = {
        r.if_index: r.bytes
        for r in rebuild.rebuilt(condense.conversations_5m(flows), "interface_1m").collect()
    }
    assert live == {1: 10, 2: 10} and again == {1: 20, 2: 10}


def test_statistics_need_all_four_fields_and_zero_fill(spark):
    flows = [flow(1, DAY, in_if=None), flow(2, DAY, exporter=None), flow(3, DAY, proto=None), flow(4, DAY, src_addr=None)]
    rows = rollups.statistics_5m(frame(spark, flows)).collect()
    assert [(r.in_if, r.flows, r.service_side) for r in rows] == [(0, 1, "destination")]


def test_rollups_from_condensed_rows_equal_those_from_flows(spark):
    flows = frame(spark, random_flows(600, 3))
    condensed = condense.condense(flows, buckets.minute)
    for name in rollups.ROLLUP_NAMES:
        a = sorted(map(tuple, rollups.roll_up(flows, name).collect()), key=repr)
        b = sorted(map(tuple, rollups.roll_up(condensed, name).collect()), key=repr)
        assert a == b, name
    a = sorted(map(tuple, rollups.statistics_5m(flows).collect()), key=repr)
    assert a == sorted(map(tuple, rollups.statistics_5m(condensed).collect()), key=repr)


def test_sums_agree_across_tables(spark):
    flows = random_flows(500, 4)
    df = frame(spark, flows)
    total = sum(f["bytes"] for f in flows), len(flows)
    conv = condense.conversations_5m(df).agg({"bytes": "sum", "flow_count": "sum"}).first()
    roll = rollups.roll_up(df, "total_1m").agg({"bytes": "sum", "flows": "sum"}).first()
    assert (conv["sum(bytes)"], conv["sum(flow_count)"]) == total
    assert (roll["sum(bytes)"], roll["sum(flows)"]) == total


def test_meta_columns_are_complete():
    assert set(META) == set(schemas.META_TYPES)
