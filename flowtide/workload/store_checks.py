"""The reports over stored tables, and ways the store may change without changing an answer.

Every report that is registered over derived tables is registered again over a
store that four interleaved batches fed, two of them compacted, the last one
late; both have the same SQL twin.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.jobs import compact, rebuild, retention, upkeep
from flowtide.operators.filters import FlowFilter
from flowtide.plans import dashboard, flows
from flowtide.session import scratch_dir
from flowtide.sources import files, tail
from flowtide.sources.store import TableStore
from flowtide.streaming import ingest, progress
from flowtide.workload import samples
from flowtide.workload.adapter import Inputs
from flowtide.workload.base_sql import query
from flowtide.workload.job_checks import _all_rollups, _all_rollups_sql
from flowtide.workload.report_checks import LISTING_SQL
from flowtide.workload.registry import BUILDERS, TWINS, register
from flowtide.workload.table_checks import CONV

REPORTS = [
    "dashboard_summary", "top_src", "top_dst", "top_proto", "top_port", "top_exporter", "top_app", "top_interfaces",
    "device_timeseries", "traffic_timeseries", "flows_list", "latest_conversations", "flows_count",
    "flows_summary_pair", "flows_summary_source", "flows_summary_destination", "flows_summary_count", "flows_series",
    "conversations_ip", "conversations_interface", "conversations_count", "stats_flows", "stats_flows_count",
    "stats_summary_pair", "stats_summary_source", "stats_summary_destination", "stats_summary_count",
    "stats_conversations_ip", "stats_conversations_interface", "history_view", "smart_period_flows",
]
_STORES: dict[tuple[str, str], TableStore] = {}


def fed(i: Inputs, order: tuple[int, ...] = (0, 1, 2, 3), fold_after: int | None = 2) -> TableStore:
    """A store fed with interleaved quarters of the flows; batches before ``fold_after`` are folded when it comes."""
    store = TableStore(i.spark, scratch_dir(i.spark, "store") + "/tables")
    for batch, quarter in enumerate(order):
        ingest.ingest_flows(store, i.flows.filter(F.col("seq") % 4 == quarter), batch)
        if batch == fold_after:
            compact.compact(store)
    return store


def named(i: Inputs, store: TableStore) -> TableStore:
    """The store with the workload's naming tables."""
    for name in ("exporters", "interfaces", "ip_names", "dns_cache", "port_descriptions"):
        store.write_dimension(name, getattr(i, name))
    return store


def shared(i: Inputs) -> TableStore:
    """One store per session and folder, for reports that only read it."""
    key = (i.spark.sparkContext.applicationId, i.sf_dir)
    if key not in _STORES:
        _STORES[key] = named(i, fed(i))
    return _STORES[key]


@dataclass(frozen=True)
class Stored(Inputs):
    """The same inputs, their tables read from the store."""

    def tables(self) -> TableStore:
        return shared(self)


for _name in REPORTS:
    register(f"store_{_name}", lambda i, build=BUILDERS[_name]: build(Stored(i.spark, i.sf_dir)), TWINS[_name])


# -- distinct counts from sketches, history from levels ------------------------------


def _sketched(i: Inputs) -> DataFrame:
    """Estimates beside exact counts: twice the standard error of 0.8 %, and one, is allowed."""
    store = shared(i)
    near = dashboard.summary_approx(store, i.as_of, 6).select(F.posexplode(F.array("exporters", "sources", "destinations")).alias("n", "near"))
    exact = dashboard.summary(store, i.as_of, 6).select(F.posexplode(F.array("exporters", "sources", "destinations")).alias("n", "exact"))
    return near.join(exact, "n").select("n", "exact", (F.abs(F.col("near") - F.col("exact")) <= 1 + 0.016 * F.col("exact")).alias("within"))


register(
    "summary_sketched", _sketched,
    query(
        " UNION ALL ".join(
            f"SELECT CAST({n} AS INT) AS n, count(DISTINCT {key}) AS exact, true AS within FROM {table}, clock WHERE bucket >= as_of - INTERVAL '6 hours'"
            for n, (table, key) in enumerate((("exporter_1m", "exporter"), ("src_1m", "src_addr"), ("dst_1m", "dst_addr")))
        )
    ),
)


def _levels(i: Inputs) -> DataFrame:
    """Sums over windows with edges anywhere, from a folded store with a late batch."""
    store, out = shared(i), None
    for hours, minutes in ((3, 0), (7, 17), (30, 1), (24 * 365, 0)):
        low, high = i.as_of - timedelta(hours=hours, minutes=minutes), i.as_of - timedelta(minutes=11)
        sums = store.spans("app_1m", low, high).groupBy("proto", "port").agg(
            *(F.sum(c).cast("long").alias(c) for c in ("bytes", "packets", "flows")), F.min("first").alias("first"), F.max("last").alias("last")
        ).withColumn("hours", F.lit(hours))
        out = sums if out is None else out.unionByName(sums)
    return out


register(
    "window_levels", _levels,
    query(
        " UNION ALL ".join(
            f"""SELECT CAST({hours} AS INT) AS hours, proto, port, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets,
                  CAST(sum(flows) AS BIGINT) AS flows, min(bucket) AS first, max(bucket) AS last FROM app_1m, clock
                WHERE bucket BETWEEN as_of - INTERVAL '{60 * hours + minutes} minutes' AND as_of - INTERVAL '11 minutes' GROUP BY proto, port"""
            for hours, minutes in ((3, 0), (7, 17), (30, 1), (24 * 365, 0))
        )
    ),
)

# -- heaviest keys by the lists of folded days ----------------------------------------


def _listed(i: Inputs, kind: str) -> DataFrame:
    """A window that ends in no folded day, so that whole days, edges and the late batch take part."""
    return dashboard.top_listed(shared(i), kind, i.as_of, 24 * 365, 10)


for _kind in ("src", "dst"):
    register(
        f"top_{_kind}_listed", lambda i, kind=_kind: _listed(i, kind),
        query(
            f"""SELECT {_kind}_addr AS label, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(flows) AS BIGINT) AS flows
                FROM {_kind}_1m, clock WHERE bucket >= as_of - INTERVAL '8760 hours' GROUP BY {_kind}_addr
                ORDER BY bytes DESC, label LIMIT 10"""
        ),
    )

# -- growing files --------------------------------------------------------------------


def _tailed(i: Inputs) -> DataFrame:
    """Lines in files of a followed folder. The last few hundred come in one file that grows, up to the middle of a
    line and on; then the newest commit gets lost."""
    folder, store = scratch_dir(i.spark, "tail"), TableStore(i.spark, scratch_dir(i.spark, "store") + "/tables")
    work, border = scratch_dir(i.spark, "work") + "/checkpoint", i.flows.agg(F.max("seq")).first()[0] - 300
    samples.json_lines(i.flows.filter(F.col("seq") <= border)).write.text(folder)
    last = samples.json_lines(i.flows.filter(F.col("seq") > border)).limit(1_000).collect()
    text = "".join(f"{row[0]}\n" for row in last).encode()
    here = tail.Folder(folder)
    for cut in (len(text) // 2, len(text)):
        with here.fs.open_output_stream(f"{here.path}/growing.jsonl", compression=None) as out:
            out.write(text[:cut])
        ingest.start_tail(i.spark, folder, store, work, max_bytes=16_000_000, drain=True, suffix=".txt,.jsonl")
    newest = max(int(n) for n in tail.Folder(f"{work}/commits").names() if n.isdigit())
    for name in (f"{newest}", f".{newest}.crc"):
        files.drop(i.spark, f"{work}/commits/{name}")
    ingest.start_tail(i.spark, folder, store, work, max_bytes=16_000_000, drain=True, suffix=".txt,.jsonl")
    return store.partials("statistics").groupBy(
        "exporter", "src_addr", "dst_addr", "proto", "service_port", "service_side", "in_if", "out_if"
    ).agg(*(F.sum(c).cast("long").alias(c) for c in ("bytes", "packets", "flows")))


register("src_tail_growing", _tailed, TWINS["src_jsonl_stream"])

def _progress(i: Inputs) -> DataFrame:
    """Batches and rows that a listener noted while the flows were streamed in."""
    store, source = TableStore(i.spark, scratch_dir(i.spark, "store") + "/tables"), scratch_dir(i.spark, "flows") + "/parquet"
    i.flows.repartitionByRange(4, "seq").write.parquet(source)
    listener = progress.watch(store)
    try:
        ingest.start_from_flows(i.spark, source, store, scratch_dir(i.spark, "work") + "/checkpoint", True, 2).awaitTermination()
        for _ in range(300):  # events come a little later than the batches
            if len([b for found in store.partitions("stream_progress").values() for b in found]) >= 2:
                break
            time.sleep(0.1)
    finally:
        i.spark.streams.removeListener(listener)
    return store.partials("stream_progress").agg(
        F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.min(F.col("rows_per_second") > 0).alias("measured")
    )


register("stream_progress", _progress, query("SELECT CAST(2 AS BIGINT) AS batches, count(*) AS rows, true AS measured FROM flows"))

# -- maintenance, each with a replay of the newest batch after it ---------------------


def _replay_last(i: Inputs, store: TableStore) -> TableStore:
    ingest.ingest_flows(store, i.flows.filter(F.col("seq") % 4 == 3), 3)
    return store


def _upkeep_replay(i: Inputs) -> DataFrame:
    """Expiry and folding between batches, then the newest batch again."""
    store = fed(i, fold_after=None)
    upkeep.run(store, i.as_of, 6, 30)
    return _replay_last(i, store).conversations()


register("upkeep_replay", _upkeep_replay, query(f"SELECT {CONV} FROM conv, clock WHERE last_seen >= as_of - INTERVAL '6 hours'"))


def _backfill_replay(i: Inputs) -> DataFrame:
    store = fed(i)
    store.drop_days("statistics", store.days("statistics"))
    rebuild.backfill(store)
    return _replay_last(i, store).statistics()


register("backfill_job_replay", _backfill_replay, query("SELECT * FROM stats"))


def _compact_unfinished_replay(i: Inputs) -> DataFrame:
    """The newest batch has no log entry yet: it is not folded and replaces itself."""
    store = fed(i, fold_after=None)
    store.drop_batch("batch_log", 3)
    compact.compact(store)
    return _all_rollups(_replay_last(i, store))


register("compact_unfinished_replay", _compact_unfinished_replay, query(_all_rollups_sql()))


def _late_replay(i: Inputs) -> DataFrame:
    """Batches in another order, folded, the last one twice."""
    store = fed(i, (2, 0, 1, 3), 3)
    return _replay_last(i, store).conversations()


register("late_batches_folded", _late_replay, query(f"SELECT {CONV} FROM conv"))


def _seek(i: Inputs) -> DataFrame:
    """The second page of a listing, by what the first one ended with."""
    store, flt = shared(i), FlowFilter(hours=6)
    last = flows.listing(store, flt, i.as_of, sort="bytes", limit=50).collect()[-1]
    bucket = last.received_at - timedelta(
        minutes=last.received_at.minute % 5, seconds=last.received_at.second, microseconds=last.received_at.microsecond
    )
    return flows.listing(store, flt, i.as_of, sort="bytes", limit=50, seek=(last.bytes, last.conv_key, bucket))


register(
    "page_seek", _seek,
    query(
        f"""{LISTING_SQL} WHERE received_at >= as_of - INTERVAL '6 hours'
            ORDER BY bytes DESC, conv_key DESC, bucket_start DESC LIMIT 50 OFFSET 50"""
    ),
)
