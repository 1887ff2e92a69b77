"""Queries over sources, sinks, streams and maintenance jobs.

Each writes the whole derived flow table to a scratch folder, runs the job and
returns the resulting table read back, so it has an ordinary SQL twin.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.jobs import compact, purge, retention
from flowtide.operators import rollups
from flowtide.session import scratch_dir
from flowtide.sources import files, jsonl, raw
from flowtide.sources.store import TableStore
from flowtide.streaming import ingest
from flowtide.workload import samples
from flowtide.workload.adapter import Inputs
from flowtide.workload.base_sql import query
from flowtide.workload.registry import register
from flowtide.workload.table_checks import CONV

FLOW_COLUMNS = (
    "flow_time, exporter, flow_type, src_addr, dst_addr, src_port, dst_port, proto, bytes, packets, "
    "in_if, out_if, src_as, dst_as, src_country, dst_country, sampling_rate, tcp_flags"
)


def _written_lines(i: Inputs) -> str:
    folder = scratch_dir(i.spark, "lines") + "/json"
    samples.json_lines(i.flows).write.text(folder)
    return folder


# -- JSON lines -------------------------------------------------------------------

register(
    "src_jsonl_batch",
    lambda i: jsonl.read_flows(i.spark, _written_lines(i)).select(*FLOW_COLUMNS.split(", ")),
    query(f"SELECT {FLOW_COLUMNS} FROM flows"),
)


def _normalized(i: Inputs) -> DataFrame:
    lines = samples.json_lines(i.flows).withColumn("received_at", F.timestamp_micros(F.lit(0)))
    rows = jsonl.normalize(jsonl.parse(lines))
    return rows.groupBy("reason", "exporter", "src_addr", "dst_addr", "proto", "flow_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").cast("long").alias("bytes"),
        F.max("flow_time").alias("last_time"),
    )


register(
    "normalize_flow", _normalized,
    query(
        """SELECT NULL AS reason, exporter, src_addr, dst_addr, proto, flow_type, count(*) AS n,
             CAST(sum(bytes) AS BIGINT) AS bytes, max(flow_time) AS last_time FROM flows GROUP BY ALL
           UNION ALL
           SELECT 'bad address', NULL, NULL, NULL, NULL, '', count(*), 0, NULL FROM flows WHERE seq % 50 = 4
           UNION ALL
           SELECT 'malformed', NULL, NULL, NULL, NULL, '', count(*), 0, NULL FROM flows WHERE seq % 50 < 4"""
    ),
)


def _quarantined(i: Inputs) -> DataFrame:
    parsed = jsonl.parse(jsonl.read_lines(i.spark, _written_lines(i)))
    return jsonl.quarantine(jsonl.normalize(parsed)).select("value", "reason")


register(
    "src_quarantine", _quarantined,
    query(
        """SELECT CASE seq % 50 WHEN 0 THEN '{"half":' || seq WHEN 1 THEN '[' || seq || ']' WHEN 2 THEN 'null'
             WHEN 3 THEN CAST(seq AS VARCHAR) ELSE '{"src_addr":"host-' || seq || '"}' END AS value,
             CASE WHEN seq % 50 = 4 THEN 'bad address' ELSE 'malformed' END AS reason
           FROM flows WHERE seq % 50 < 5"""
    ),
)


def _store(i: Inputs) -> TableStore:
    return TableStore(i.spark, scratch_dir(i.spark, "store") + "/tables")


def _stream_lines(i: Inputs) -> DataFrame:
    """JSON files -> stream -> store; summed over time, which depends on the files."""
    store, work = _store(i), scratch_dir(i.spark, "work")
    ingest.start(i.spark, _written_lines(i), store, work + "/checkpoint", drain=True).awaitTermination()
    return store.partials("statistics").groupBy(
        "exporter", "src_addr", "dst_addr", "proto", "service_port", "service_side", "in_if", "out_if"
    ).agg(*(F.sum(c).cast("long").alias(c) for c in rollups.MEASURES))


register(
    "src_jsonl_stream", _stream_lines,
    query(
        """SELECT exporter, src_addr, dst_addr, proto, service_port, service_side, in_if, out_if,
             CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(flows) AS BIGINT) AS flows
           FROM stats GROUP BY ALL"""
    ),
)

# -- sinks ------------------------------------------------------------------------


def _filled(i: Inputs, batches: int = 2) -> TableStore:
    """A store fed with the flows in interleaved batches."""
    store = _store(i)
    for n in range(batches):
        ingest.ingest_flows(store, i.flows.filter(F.col("seq") % batches == n), n)
    return store


def _all_rollups(store: TableStore) -> DataFrame:
    """Every rollup, merged, as rows (name, key, bucket, measures)."""
    out = None
    for name in rollups.ROLLUP_NAMES:
        rows = store.merged(name)
        keys = [c for c in rollups.rollup_key(name) if c != "bucket"]
        key = F.concat_ws("|", *keys) if keys else F.lit("")
        part = rows.select(F.lit(name).alias("name"), key.alias("key"), "bucket", *rollups.MEASURES)
        out = part if out is None else out.unionByName(part)
    return out


_KEYS = {
    "total_1m": "''", "src_1m": "src_addr", "dst_1m": "dst_addr", "exporter_1m": "exporter",
    "app_1m": "proto || '|' || port", "interface_1m": "exporter || '|' || if_index",
}


def _all_rollups_sql(names=None, where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, CAST({key} AS VARCHAR) AS key, bucket, bytes, packets, flows FROM {name}, clock WHERE {where}"
        for name, key in _KEYS.items()
        if names is None or name in names
    )


register("merge_conversations", lambda i: _filled(i).conversations(), query(f"SELECT {CONV} FROM conv"))
register("merge_stats", lambda i: _filled(i, 3).statistics(), query("SELECT * FROM stats"))
register("merge_rollups", lambda i: _all_rollups(_filled(i, 3)), query(_all_rollups_sql()))


def _replayed(i: Inputs) -> DataFrame:
    store = _filled(i)
    ingest.ingest_flows(store, i.flows.filter(F.col("seq") % 2 == 1), 1)
    return store.conversations()


register("exactly_once_sink", _replayed, query(f"SELECT {CONV} FROM conv"))


def _raw_days(i: Inputs) -> DataFrame:
    path = scratch_dir(i.spark, "raw") + "/flows"
    raw.write_daily(i.flows, path)
    return raw.read_daily(i.spark, path).groupBy("d").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").cast("long").alias("bytes"),
        F.min("received_at").alias("first"), F.max("received_at").alias("last"),
    )


register(
    "raw_daily_partitions", _raw_days,
    query(
        """SELECT CAST(received_at AS DATE) AS d, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes,
             min(received_at) AS first, max(received_at) AS last FROM flows GROUP BY 1"""
    ),
)

# -- streams ----------------------------------------------------------------------


def _flow_files(i: Inputs, half: int | None = None) -> str:
    folder = scratch_dir(i.spark, "flows") + "/parquet"
    rows = i.flows if half is None else i.flows.filter(F.col("seq") % 2 == half)
    rows.repartitionByRange(4, "seq").write.parquet(folder)
    return folder


def _drained(i: Inputs, max_files: int = 2) -> tuple[TableStore, str, str]:
    source, store, work = _flow_files(i), _store(i), scratch_dir(i.spark, "work") + "/checkpoint"
    ingest.start_from_flows(i.spark, source, store, work, True, max_files).awaitTermination()
    return store, source, work


register(
    "stream_ingest", lambda i: _drained(i)[0].conversations(), query(f"SELECT {CONV} FROM conv")
)
register("stream_rollups", lambda i: _all_rollups(_drained(i)[0]), query(_all_rollups_sql()))


def _stream_replay(i: Inputs) -> DataFrame:
    """The last batch loses its commit and is run again."""
    store, source, work = _drained(i)
    last = max(b for d in store.days("batch_log") for b in store.batches("batch_log", d))
    for name in (f"{last}", f".{last}.crc"):
        files.drop(i.spark, f"{work}/commits/{name}")
    ingest.start_from_flows(i.spark, source, store, work, True, 2).awaitTermination()
    return store.conversations()


register("stream_exactly_once", _stream_replay, query(f"SELECT {CONV} FROM conv"))


def _stream_late(i: Inputs) -> DataFrame:
    """Half of the flows of every bucket arrive in a second run."""
    source, store = _flow_files(i, 0), _store(i)
    work = scratch_dir(i.spark, "work") + "/checkpoint"
    ingest.start_from_flows(i.spark, source, store, work, True).awaitTermination()
    late = i.flows.filter(F.col("seq") % 2 == 1)
    late.write.mode("append").parquet(source)
    ingest.start_from_flows(i.spark, source, store, work, True).awaitTermination()
    return store.conversations()


register("stream_late_merge", _stream_late, query(f"SELECT {CONV} FROM conv"))
register(
    "stream_batch_counts",
    lambda i: _drained(i)[0].partials("batch_log").groupBy("type").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("count").cast("long").alias("flows"),
        F.max("ts").alias("last"),
    ),
    query(
        "SELECT 'flow' AS type, CAST(2 AS BIGINT) AS batches, count(*) AS flows, max(received_at) AS last FROM flows"
    ),
)

# -- maintenance --------------------------------------------------------------------


def _retained_conversations(i: Inputs) -> DataFrame:
    store = _filled(i)
    retention.expire_conversations(store, i.as_of, 3)
    return store.conversations()


register(
    "retain_detailed", _retained_conversations,
    query(f"SELECT {CONV} FROM conv, clock WHERE last_seen >= as_of - INTERVAL '3 hours'"),
)


def _retained_statistics(i: Inputs) -> DataFrame:
    """A clock 21 hours ahead: one day of retention reaches back three hours."""
    store = _filled(i)
    retention.expire_statistics(store, i.as_of + timedelta(hours=21), 1)
    stats = store.statistics().groupBy(F.col("bucket_start").alias("bucket")).agg(
        *(F.sum(c).cast("long").alias(c) for c in rollups.MEASURES)
    )
    stats = stats.select(F.lit("statistics").alias("name"), F.lit("").alias("key"), "bucket", *rollups.MEASURES)
    return _all_rollups(store).unionByName(stats)


register(
    "retain_stats", _retained_statistics,
    query(
        _all_rollups_sql(where="bucket >= as_of - INTERVAL '3 hours'")
        + """ UNION ALL SELECT 'statistics', '', bucket_start, CAST(sum(bytes) AS BIGINT), CAST(sum(packets) AS BIGINT),
                CAST(sum(flows) AS BIGINT) FROM stats, clock WHERE bucket_start >= as_of - INTERVAL '3 hours' GROUP BY 3"""
    ),
)


def _retained_raw(i: Inputs) -> DataFrame:
    base = scratch_dir(i.spark, "raw")
    raw.write_daily(i.flows, f"{base}/flows")
    raw.drop_expired(i.spark, f"{base}/flows", f"{base}/staging", i.as_of, 3)
    return raw.read_daily(i.spark, f"{base}/flows").select("seq", "received_at", "bytes")


register(
    "retain_raw", _retained_raw,
    query("SELECT seq, received_at, bytes FROM flows, clock WHERE received_at >= as_of - INTERVAL '3 hours'"),
)


def _compacted(i: Inputs) -> DataFrame:
    store = _filled(i, 4)
    compact.compact(store)
    out = _all_rollups(store)
    for name, rows, at in (
        ("conversations", store.conversations().withColumnRenamed("flow_count", "flows"), "bucket_start"),
        ("statistics", store.statistics(), "bucket_start"),
    ):
        sums = rows.groupBy(F.col(at).alias("bucket")).agg(
            *(F.sum(c).cast("long").alias(c) for c in rollups.MEASURES)
        )
        out = out.unionByName(
            sums.select(F.lit(name).alias("name"), F.lit("").alias("key"), "bucket", *rollups.MEASURES)
        )
    return out


def _bucket_sums(name: str, table: str, flows: str) -> str:
    return f""" UNION ALL SELECT '{name}', '', bucket_start, CAST(sum(bytes) AS BIGINT), CAST(sum(packets) AS BIGINT),
      CAST(sum({flows}) AS BIGINT) FROM {table} GROUP BY 3"""


register(
    "compact", _compacted,
    query(
        _all_rollups_sql()
        + _bucket_sums("conversations", "conv", "flow_count")
        + _bucket_sums("statistics", "stats", "flows")
    ),
)
register(
    "compact_conversations",
    lambda i: _compacted_store(i).conversations(),
    query(f"SELECT {CONV} FROM conv"),
)


def _compacted_store(i: Inputs) -> TableStore:
    store = _filled(i, 4)
    compact.compact(store)
    return store


_PURGED = "192.0.2.3"


def _purged_store(i: Inputs) -> tuple[TableStore, DataFrame]:
    store = _filled(i)
    store.write_dimension("interfaces", i.interfaces)
    counts = purge.purge(store, _PURGED, i.as_of + timedelta(hours=1))
    return store, counts


def _purge_left(i: Inputs) -> DataFrame:
    """What is left: conversations, statistics and all rollups as sums per key."""
    store, _ = _purged_store(i)
    out = _all_rollups(store)
    for name, rows in (
        ("conversations", store.conversations().withColumnRenamed("flow_count", "flows")),
        ("statistics", store.statistics()),
    ):
        sums = rows.groupBy(F.col("bucket_start").alias("bucket"), F.coalesce("exporter", F.lit("-")).alias("key")).agg(
            *(F.sum(c).cast("long").alias(c) for c in rollups.MEASURES)
        )
        out = out.unionByName(sums.select(F.lit(name).alias("name"), "key", "bucket", *rollups.MEASURES))
    return out


_LEFT = "exporter IS DISTINCT FROM '192.0.2.3'"
_REBUILD_KEYS = {
    "total_1m": ("''", "true"),
    "src_1m": ("src_addr", "src_addr IS NOT NULL"),
    "dst_1m": ("dst_addr", "dst_addr IS NOT NULL"),
    "app_1m": (
        "proto || '|' || coalesce(service_port, dst_port, src_port)",
        "proto IS NOT NULL AND coalesce(service_port, dst_port, src_port) IS NOT NULL",
    ),
}
_PURGE_SQL = " UNION ALL ".join(
    [
        f"""SELECT '{name}' AS name, CAST({key} AS VARCHAR) AS key, date_trunc('minute', last_seen) AS bucket,
              CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(flow_count) AS BIGINT) AS flows
            FROM conv WHERE {_LEFT} AND {condition} GROUP BY 1, 2, 3"""
        for name, (key, condition) in _REBUILD_KEYS.items()
    ]
    + [_all_rollups_sql(("exporter_1m", "interface_1m"), _LEFT)]
    + [
        f"""SELECT '{name}', coalesce(exporter, '-'), bucket_start, CAST(sum(bytes) AS BIGINT), CAST(sum(packets) AS BIGINT),
              CAST(sum({flows}) AS BIGINT) FROM {table} WHERE {_LEFT} GROUP BY 1, 2, 3"""
        for name, table, flows in (("conversations", "conv", "flow_count"), ("statistics", "stats", "flows"))
    ]
)
register("purge_exporter", _purge_left, query(_PURGE_SQL))
register(
    "purge_report",
    lambda i: _purged_store(i)[1],
    query(
        f"""SELECT (SELECT count(*) FROM conv WHERE exporter = '{_PURGED}') AS deleted_conversation_rows,
              (SELECT CAST(coalesce(sum(flow_count), 0) AS BIGINT) FROM conv WHERE exporter = '{_PURGED}') AS deleted_flows,
              (SELECT count(*) FROM stats WHERE exporter = '{_PURGED}') AS deleted_statistics_rows,
              (SELECT count(*) FROM interfaces WHERE exporter = '{_PURGED}') AS deleted_interfaces,
              (SELECT count(*) FROM exporter_1m WHERE exporter = '{_PURGED}') AS deleted_exporter_aggregate_rows,
              (SELECT count(*) FROM interface_1m WHERE exporter = '{_PURGED}') AS deleted_interface_aggregate_rows"""
    ),
)
