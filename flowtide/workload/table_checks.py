"""Queries over filters, joins, aggregations, sorts and set operations."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from flowtide.functions import labels
from flowtide.jobs import rebuild, reports
from flowtide.operators import condense, dimensions, enrich, filters, ordering, rollups
from flowtide.operators.filters import FlowFilter
from flowtide.plans import dashboard, flows, inventory, statistics
from flowtide.schemas import CONVERSATIONS
from flowtide.workload.adapter import Inputs
from flowtide.workload.base_sql import DEVICE, inet_key, query
from flowtide.workload.registry import register

CONV = ", ".join(CONVERSATIONS.names)

# -- aggregations -------------------------------------------------------------

register(
    "agg_conversations_5m", lambda i: condense.conversations_5m(i.flows),
    query(f"SELECT {CONV} FROM conv"),
)
register("agg_stats_5m", lambda i: rollups.statistics_5m(i.flows), query("SELECT * FROM stats"))
for _name in rollups.ROLLUP_NAMES:
    register(
        f"agg_{_name}",
        lambda i, name=_name: rollups.roll_up(i.flows, name),
        query(f"SELECT * FROM {_name}"),
    )


def _partial_final(i: Inputs):
    """Two interleaved batches condensed apart, then merged: same as one pass."""
    parts = [
        condense.condense(i.flows.filter(F.col("seq") % 2 == n)) for n in (0, 1)
    ]
    return condense.finish(condense.merge(parts[0].unionByName(parts[1])))


register("agg_partial_final", _partial_final, query(f"SELECT {CONV} FROM conv"))
register(
    "agg_distinct",
    lambda i: dashboard.summary(i.tables(), i.as_of, 6).select("exporters", "sources", "destinations"),
    query(
        """SELECT (SELECT count(DISTINCT exporter) FROM exporter_1m, clock WHERE bucket >= as_of - INTERVAL '6 hours') AS exporters,
             (SELECT count(DISTINCT src_addr) FROM src_1m, clock WHERE bucket >= as_of - INTERVAL '6 hours') AS sources,
             (SELECT count(DISTINCT dst_addr) FROM dst_1m, clock WHERE bucket >= as_of - INTERVAL '6 hours') AS destinations"""
    ),
)
register(
    "agg_group_count",
    lambda i: flows.count_groups(
        i.tables().conversations(), ["src_addr", "dst_addr", "proto", "service_port"]
    ),
    query(
        "SELECT count(*) AS total FROM (SELECT DISTINCT src_addr, dst_addr, proto, service_port FROM conv)"
    ),
)


def _scan(i: Inputs):
    """Traffic per table, read the way the reports read them."""
    tables = i.tables()
    out = None
    sources = {
        "conversations": tables.conversations().withColumnRenamed("flow_count", "flows"),
        "statistics": tables.statistics(),
        **{name: tables.rollup(name) for name in rollups.ROLLUP_NAMES},
    }
    for name, rows in sources.items():
        part = rows.agg(
            F.count(F.lit(1)).alias("table_rows"),
            *(F.sum(c).cast("long").alias(c) for c in rollups.MEASURES),
        ).select(F.lit(name).alias("name"), "table_rows", *rollups.MEASURES)
        out = part if out is None else out.unionByName(part)
    return out


def _scan_sql() -> str:
    names = {"conversations": ("conv", "flow_count"), "statistics": ("stats", "flows")}
    names |= {name: (name, "flows") for name in rollups.ROLLUP_NAMES}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS table_rows, CAST(sum(bytes) AS BIGINT) AS bytes, "
        f"CAST(sum(packets) AS BIGINT) AS packets, CAST(sum({flows_}) AS BIGINT) AS flows FROM {table}"
        for name, (table, flows_) in names.items()
    )


register("scan_tables", _scan, query(_scan_sql()))

# -- filters ------------------------------------------------------------------

_SHOWN = "bucket_start, conv_key, received_at, exporter, src_addr, dst_addr, bytes, flow_count"


def _filtered(make):
    def run(i: Inputs):
        rows = flows.selected(i.tables(), make(i), i.as_of)
        return rows.select(*_SHOWN.split(", "))

    return run


def _where(condition: str) -> str:
    return query(f"SELECT {_SHOWN} FROM conv f, clock WHERE {condition}")


_FILTERS = {
    "flt_hours": (lambda i: FlowFilter(hours=3), "received_at >= as_of - INTERVAL '3 hours'"),
    "flt_range": (
        lambda i: FlowFilter(
            date_from=i.as_of - timedelta(minutes=63), date_to=i.as_of - timedelta(minutes=21)
        ),
        "received_at >= as_of - INTERVAL '63 minutes' AND received_at <= as_of - INTERVAL '21 minutes'",
    ),
    "flt_q": (
        lambda i: FlowFilter(q="44"),
        "(src_addr ILIKE '%44%' OR dst_addr ILIKE '%44%' OR exporter ILIKE '%44%' OR src_port::VARCHAR ILIKE '%44%'"
        " OR dst_port::VARCHAR ILIKE '%44%' OR service_port::VARCHAR ILIKE '%44%')",
    ),
    "flt_exporter": (lambda i: FlowFilter(exporter=" 192.0.2.2/32"), "exporter = '192.0.2.2'"),
    "flt_src": (lambda i: FlowFilter(src="2001:DB8:0::1"), "src_addr = '2001:db8::1'"),
    "flt_dst": (lambda i: FlowFilter(dst="100.3"), "dst_addr ILIKE '%100.3%'"),
    "flt_ports": (lambda i: FlowFilter(src_port=45000, dst_port=50012), "src_port = 45000 AND dst_port = 50012"),
    "flt_any_port": (
        lambda i: FlowFilter(port=9200), "(service_port = 9200 OR src_port = 9200 OR dst_port = 9200)"
    ),
    "flt_proto": (lambda i: FlowFilter(proto=17), "proto = 17"),
    "flt_if_index": (
        lambda i: FlowFilter(interface_index=2, interface_exporter="192.0.2.3", interface="ignored"),
        "(in_if = 2 OR out_if = 2) AND exporter = '192.0.2.3'",
    ),
    "flt_if_text": (
        lambda i: FlowFilter(interface="ether5"),
        "(in_if::VARCHAR = 'ether5' OR out_if::VARCHAR = 'ether5' OR EXISTS (SELECT 1 FROM interfaces n WHERE n.exporter = f.exporter"
        " AND n.if_index IN (f.in_if, f.out_if) AND (n.if_name ILIKE '%ether5%' OR n.if_descr ILIKE '%ether5%')))",
    ),
    "flt_in_out_if": (lambda i: FlowFilter(in_if=1, out_if=3), "in_if = 1 AND out_if = 3"),
}
for _name, (_make, _condition) in _FILTERS.items():
    register(_name, _filtered(_make), _where(_condition))


def _latest(i: Inputs):
    tables = i.tables()
    return filters.latest_only(tables.conversations(), tables.newest_bucket()).select(
        *_SHOWN.split(", ")
    )


register(
    "flt_latest", _latest,
    _where("bucket_start >= (SELECT max(bucket_start) - INTERVAL '10 minutes' FROM conv)"),
)
register(
    "flt_stats",
    lambda i: statistics.selected(
        i.tables(),
        FlowFilter(
            date_from=i.as_of - timedelta(hours=1), date_to=i.as_of - timedelta(minutes=11),
            q="198", dst_port=443, proto=6, exporter="192.0.2.1",
        ),
    ),
    query(
        """SELECT s.* FROM stats s, clock WHERE bucket_start >= as_of - INTERVAL '1 hour'
             AND bucket_start < as_of - INTERVAL '11 minutes' + INTERVAL '5 minutes'
             AND (src_addr ILIKE '%198%' OR dst_addr ILIKE '%198%' OR exporter ILIKE '%198%' OR service_port::VARCHAR ILIKE '%198%')
             AND service_side = 'destination' AND service_port = 443 AND proto = 6 AND exporter = '192.0.2.1'"""
    ),
)

# -- joins --------------------------------------------------------------------


def _with_names(i: Inputs, side: str):
    rows = enrich.with_interface(i.tables().conversations(), i.interfaces, side, "named")
    return rows.select(
        "bucket_start", "conv_key", side, "named_if_name", "named_if_descr", "named_if_alias"
    )


register(
    "join_exporters",
    lambda i: enrich.with_exporter(i.tables().conversations(), i.exporters).select(
        "bucket_start", "conv_key", "exporter",
        labels.display_name(F.col("exporter_custom_name"), F.col("exporter_host"), F.col("exporter")).alias("device"),
    ),
    query(
        f"""SELECT bucket_start, conv_key, f.exporter, coalesce({DEVICE}, f.exporter) AS device
            FROM conv f LEFT JOIN exporters e ON e.ip = f.exporter"""
    ),
)
for _key, _side in (("join_in_if", "in_if"), ("join_out_if", "out_if")):
    register(
        _key,
        lambda i, side=_side: _with_names(i, side),
        query(
            f"""SELECT bucket_start, conv_key, f.{_side}, n.if_name AS named_if_name, n.if_descr AS named_if_descr,
                  n.if_alias AS named_if_alias
                FROM conv f LEFT JOIN interfaces n ON n.exporter = f.exporter AND n.if_index = f.{_side}"""
        ),
    )
register(
    "join_stats_if",
    lambda i: enrich.with_both_interfaces(i.tables().statistics(), i.interfaces, absent=0).select(
        *rollups.STATS_KEY, "bytes", "inside_if_descr", "outside_if_descr"
    ),
    query(
        """SELECT s.bucket_start, s.exporter, s.src_addr, s.dst_addr, s.proto, s.service_port, s.service_side,
             s.in_if, s.out_if, s.bytes, a.if_descr AS inside_if_descr, b.if_descr AS outside_if_descr
           FROM stats s LEFT JOIN interfaces a ON a.exporter = s.exporter AND a.if_index = nullif(s.in_if, 0)
           LEFT JOIN interfaces b ON b.exporter = s.exporter AND b.if_index = nullif(s.out_if, 0)"""
    ),
)
register(
    "join_port_desc",
    lambda i: enrich.with_port_description(i.tables().rollup("app_1m"), i.port_descriptions),
    query(
        """SELECT a.proto, a.port, a.bucket, a.bytes, a.packets, a.flows, p.description
           FROM app_1m a LEFT JOIN port_descriptions p ON p.proto = a.proto AND p.port = a.port"""
    ),
)


def _topk_semi(i: Inputs):
    rows = i.tables().rollup("exporter_1m")
    best = ordering.top(
        rows.groupBy("exporter").agg(F.sum("bytes").alias("b")), [F.desc("b"), F.asc("exporter")], 2
    ).select("exporter")
    return rows.join(F.broadcast(best), "exporter", "left_semi").select("bucket", "exporter", "bytes")


register(
    "join_topk_semi", _topk_semi,
    query(
        """SELECT bucket, exporter, bytes FROM exporter_1m WHERE exporter IN (
             SELECT exporter FROM exporter_1m GROUP BY exporter ORDER BY sum(bytes) DESC, exporter LIMIT 2)"""
    ),
)
register(
    "join_subagg",
    lambda i: inventory.exporters_list(i.tables(), i.as_of).select(
        "exporter", "flows", "bytes", "interfaces"
    ),
    query(
        """SELECT e.ip AS exporter, CAST(coalesce(t.flows, 0) AS BIGINT) AS flows,
             CAST(coalesce(t.bytes, 0) AS BIGINT) AS bytes, coalesce(n.interfaces, 0) AS interfaces
           FROM exporters e
           LEFT JOIN (SELECT exporter, sum(flows) AS flows, sum(bytes) AS bytes FROM exporter_1m GROUP BY 1) t ON t.exporter = e.ip
           LEFT JOIN (SELECT exporter, count(*) AS interfaces FROM interfaces GROUP BY 1) n ON n.exporter = e.ip"""
    ),
)
_CATALOG_SQL = query(
    """SELECT coalesce(p.proto, s.proto) AS proto, coalesce(p.port, s.port) AS port,
         coalesce(p.description, s.service) AS description
       FROM services s FULL JOIN port_descriptions p ON p.proto = s.proto AND p.port = s.port"""
)
register(
    "join_catalog_override", lambda i: inventory.service_labels(i.tables(), i.spark), _CATALOG_SQL
)
register(
    "join_ip_names",
    lambda i: inventory.label_addresses(
        i.flows.select(F.col("dst_addr").alias("ip")), i.tables(), i.as_of
    ).select("ip", "name", "source"),
    query(
        """SELECT ip, name, 'manual' AS source FROM ip_names
           WHERE ip IN (SELECT dst_addr FROM flows)"""
    ),
)

# -- sorts and pages ------------------------------------------------------------

_LISTED = "conv_key, received_at, exporter, src_addr, dst_addr, out_if, bytes"
register(
    "sort_flows",
    lambda i: flows.listing(
        i.tables(), FlowFilter(hours=24), i.as_of, sort="out_if", order="desc", limit=100
    ).select(*_LISTED.split(", ")),
    query(
        f"""SELECT {_LISTED} FROM conv, clock WHERE received_at >= as_of - INTERVAL '24 hours'
            ORDER BY out_if DESC NULLS FIRST, conv_key DESC, bucket_start DESC LIMIT 100"""
    ),
)
register(
    "sort_summary",
    lambda i: flows.summary(i.tables(), FlowFilter(), sort="port", order="desc", limit=40),
    query(
        """SELECT CAST(NULL AS VARCHAR) AS peer_addr, src_addr, dst_addr, proto,
             coalesce(service_port, dst_port, src_port) AS port, CAST(sum(bytes) AS BIGINT) AS bytes,
             CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(flow_count) AS BIGINT) AS flows, max(last_seen) AS last_seen
           FROM conv GROUP BY 2, 3, 4, 5
           ORDER BY port DESC NULLS LAST, src_addr NULLS LAST, dst_addr NULLS LAST, proto NULLS LAST LIMIT 40"""
    ),
)
register(
    "sort_stats",
    lambda i: statistics.listing(i.tables(), FlowFilter(), sort="exporter", order="asc", limit=50).select(
        "received_at", "exporter", "exporter_hostname", "src_addr", "dst_addr", "service_port", "bytes"
    ),
    query(
        f"""SELECT bucket_start AS received_at, s.exporter, {DEVICE} AS exporter_hostname, src_addr, dst_addr,
              nullif(service_port, 0) AS service_port, bytes
            FROM stats s LEFT JOIN exporters e ON e.ip = s.exporter
            ORDER BY coalesce(e.hostname, s.exporter) NULLS LAST, bytes DESC, bucket_start, s.exporter, src_addr,
              dst_addr, proto, s.service_port, service_side, in_if, out_if LIMIT 50"""
    ),
)
register(
    "topk",
    lambda i: ordering.top(
        i.tables().rollup("src_1m"), [F.desc("bytes"), F.asc("src_addr"), F.asc("bucket")], 50
    ),
    query("SELECT * FROM src_1m ORDER BY bytes DESC, src_addr, bucket LIMIT 50"),
)


register(
    "page",
    lambda i: flows.listing(
        i.tables(), FlowFilter(hours=24), i.as_of, sort="src", order="asc", limit=30, offset=30
    ).select(*_LISTED.split(", ")),
    query(
        f"""SELECT {_LISTED} FROM conv, clock WHERE received_at >= as_of - INTERVAL '24 hours'
            ORDER BY {inet_key('src_addr')} NULLS LAST, conv_key DESC, bucket_start DESC LIMIT 30 OFFSET 30"""
    ),
)

# -- set operations -------------------------------------------------------------

_REBUILT = {
    "total": ("", "true"),
    "src": ("src_addr", "src_addr IS NOT NULL"),
    "dst": ("dst_addr", "dst_addr IS NOT NULL"),
    "exporter": ("exporter", "exporter IS NOT NULL"),
    "app": (
        "proto, coalesce(service_port, dst_port, src_port) AS port",
        "proto IS NOT NULL AND coalesce(service_port, dst_port, src_port) IS NOT NULL",
    ),
}
_REBUILD_SUMS = (
    "CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets, "
    "CAST(sum(flow_count) AS BIGINT) AS flows"
)
for _name, (_keys, _condition) in _REBUILT.items():
    register(
        f"rebuild_{_name}",
        lambda i, name=_name: rebuild.rebuilt(i.tables().conversations(), f"{name}_1m"),
        query(
            f"SELECT date_trunc('minute', last_seen) AS bucket{', ' + _keys if _keys else ''}, "
            f"{_REBUILD_SUMS} FROM conv WHERE {_condition} GROUP BY ALL"
        ),
    )
_BOTH_SIDES = f"""
SELECT bucket, exporter, if_index, {_REBUILD_SUMS} FROM (
  SELECT date_trunc('minute', last_seen) AS bucket, exporter, in_if AS if_index, bytes, packets, flow_count
  FROM conv WHERE exporter IS NOT NULL AND in_if IS NOT NULL
  UNION ALL
  SELECT date_trunc('minute', last_seen), exporter, out_if, bytes, packets, flow_count
  FROM conv WHERE exporter IS NOT NULL AND out_if IS NOT NULL) GROUP BY ALL"""
register(
    "rebuild_interface",
    lambda i: rebuild.rebuilt(i.tables().conversations(), "interface_1m"),
    query(_BOTH_SIDES),
)


def _union_all(i: Inputs):
    rows = i.tables().statistics().withColumn("bucket", F.col("bucket_start"))
    return rebuild.union_of_interfaces(rows, "flows")


register(
    "union_all_if", _union_all,
    query(
        """SELECT bucket, exporter, if_index, CAST(sum(bytes) AS BIGINT) AS bytes,
             CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(flows) AS BIGINT) AS flows
           FROM (SELECT bucket_start AS bucket, exporter, in_if AS if_index, bytes, packets, flows FROM stats
                 UNION ALL SELECT bucket_start, exporter, out_if, bytes, packets, flows FROM stats) GROUP BY ALL"""
    ),
)
register(
    "union_distinct_if",
    lambda i: inventory.interface_inventory(i.tables()).select("exporter", "if_index"),
    query("SELECT exporter, if_index FROM interface_1m UNION SELECT exporter, if_index FROM interfaces"),
)
register(
    "backfill_stats",
    lambda i: rebuild.backfill_statistics(i.tables().conversations()),
    query("SELECT * FROM stats"),
)
register(
    "storage_report",
    lambda i: reports.storage(i.tables().conversations()),
    query(
        """SELECT count(*) AS conversation_rows, CAST(sum(flow_count) AS BIGINT) AS aggregated_flows,
             CAST(sum(flow_count) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS compression_ratio,
             CAST(count(service_port) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS service_coverage FROM conv"""
    ),
)
_SEEN_SQL = query(
    """SELECT coalesce(e.ip, s.exporter) AS ip, least(e.first_seen, s.f) AS first_seen, greatest(e.last_seen, s.l) AS last_seen,
         e.hostname, e.custom_name, CAST(NULL AS VARCHAR) AS sys_descr
       FROM exporters e FULL JOIN (SELECT exporter, min(received_at) AS f, max(received_at) AS l FROM flows
                                   WHERE exporter IS NOT NULL GROUP BY 1) s ON s.exporter = e.ip"""
)
register(
    "dim_exporters_seen",
    lambda i: dimensions.merge_exporters(i.exporters, dimensions.exporters_seen(i.flows)),
    _SEEN_SQL,
)
register(
    "bootstrap_exporters",
    lambda i: reports.exporters_in(i.tables().conversations(), i.exporters),
    _SEEN_SQL,
)

# -- edits of the naming tables ---------------------------------------------------


def _port_edits(i: Inputs):
    """Every event edits a port description; the last valid edit of a port wins."""
    edits = i.table("events").select(
        F.col("event_id").alias("edit_seq"),
        F.when(F.col("event_id") % 2 == 0, 6).otherwise(300 - F.col("event_id") % 400).cast("int").alias("proto"),
        (F.col("event_id") % 2500).cast("int").alias("port"),
        F.when(F.col("event_id") % 9 == 0, "   ")
        .otherwise(F.concat(F.lit("  edit "), F.col("event_id").cast("string"), F.lit(" ")))
        .alias("description"),
    )
    return dimensions.apply_port_edits(i.port_descriptions, edits)


register(
    "dim_edits_apply", _port_edits,
    query(
        """SELECT coalesce(p.proto, n.proto) AS proto, coalesce(p.port, n.port) AS port,
             coalesce(n.description, p.description) AS description
           FROM port_descriptions p FULL JOIN (
             SELECT proto, port, arg_max(description, event_id) AS description FROM (
               SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 6 ELSE 300 - event_id % 400 END AS INT) AS proto,
                 CAST(event_id % 2500 AS INT) AS port, 'edit ' || event_id AS description FROM events WHERE event_id % 9 <> 0)
             WHERE proto BETWEEN 0 AND 255 AND port BETWEEN 1 AND 65535 GROUP BY 1, 2) n
           ON n.proto = p.proto AND n.port = p.port"""
    ),
)
