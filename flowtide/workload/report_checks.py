"""Queries over the reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from flowtide.operators import dimensions
from flowtide.operators.filters import FlowFilter
from flowtide.plans import (
    conversations, dashboard, flows, history, inventory, periods, statistics,
)
from flowtide.workload import samples
from flowtide.workload.adapter import Inputs
from flowtide.workload.base_sql import DEVICE, inet_key, interface_label, protocol_name, query
from flowtide.workload.registry import register


def _recent(table: str, hours: int) -> str:
    return f"(SELECT * FROM {table}, clock WHERE bucket >= as_of - INTERVAL '{hours} hours')"


def _big(*columns: str) -> str:
    return ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in columns)


# -- dashboard ------------------------------------------------------------------

register(
    "dashboard_summary",
    lambda i: dashboard.summary(i.tables(), i.as_of, 6),
    query(
        f"""SELECT {_big('flows', 'bytes', 'packets')},
              (SELECT count(DISTINCT exporter) FROM {_recent('exporter_1m', 6)}) AS exporters,
              (SELECT count(*) FROM interfaces) AS interfaces,
              (SELECT count(DISTINCT src_addr) FROM {_recent('src_1m', 6)}) AS sources,
              (SELECT count(DISTINCT dst_addr) FROM {_recent('dst_1m', 6)}) AS destinations
            FROM {_recent('total_1m', 6)}"""
    ),
)
for _kind, _table, _key in (
    ("src", "src_1m", "src_addr"), ("dst", "dst_1m", "dst_addr"),
    ("proto", "app_1m", "proto"), ("port", "app_1m", "port"),
):
    register(
        f"top_{_kind}",
        lambda i, kind=_kind: dashboard.top(i.tables(), kind, i.as_of, 6, 10),
        query(
            f"""SELECT CAST(k AS VARCHAR) AS label, bytes, flows FROM (
                  SELECT {_key} AS k, {_big('bytes', 'flows')} FROM {_recent(_table, 6)} GROUP BY 1)
                ORDER BY bytes DESC, k LIMIT 10"""
        ),
    )
register(
    "top_exporter",
    lambda i: dashboard.top(i.tables(), "exporter", i.as_of, 6, 10),
    query(
        f"""SELECT exporter, coalesce({DEVICE} || ' (' || exporter || ')', exporter) AS label, bytes, flows
            FROM (SELECT exporter, {_big('bytes', 'flows')} FROM {_recent('exporter_1m', 6)} GROUP BY 1) t
            LEFT JOIN exporters e ON e.ip = t.exporter ORDER BY bytes DESC, exporter LIMIT 10"""
    ),
)
register(
    "top_app",
    lambda i: dashboard.top(i.tables(), "app", i.as_of, 6, 20),
    query(
        f"""SELECT t.proto, t.port, bytes, flows, description,
              coalesce(description || ' ' || kind || '/' || t.port, service || ' · ' || kind || '/' || t.port,
                       kind || '/' || t.port) AS label
            FROM (SELECT proto, port, {protocol_name('a.proto')} AS kind, {_big('bytes', 'flows')}
                  FROM {_recent('app_1m', 6)} a GROUP BY 1, 2) t
            LEFT JOIN services s ON s.proto = t.proto AND s.port = t.port
            LEFT JOIN port_descriptions p ON p.proto = t.proto AND p.port = t.port
            ORDER BY bytes DESC, t.proto, t.port LIMIT 20"""
    ),
)
_IF = "'ifIndex ' || s.if_index"
register(
    "top_interfaces",
    lambda i: dashboard.top_interfaces(i.tables(), i.as_of, 2, 10),
    query(
        f"""SELECT s.exporter, s.if_index, {interface_label('i', _IF, _IF)} AS interface_name,
              coalesce({DEVICE}, s.exporter) AS device_name,
              {interface_label('i', _IF, _IF)} || ' (' || coalesce({DEVICE}, s.exporter) || ')' AS label, bytes, flows
            FROM (SELECT exporter, if_index, {_big('bytes', 'flows')} FROM {_recent('interface_1m', 2)} GROUP BY 1, 2) s
            LEFT JOIN interfaces i ON i.exporter = s.exporter AND i.if_index = s.if_index
            LEFT JOIN exporters e ON e.ip = s.exporter ORDER BY bytes DESC, s.exporter, s.if_index LIMIT 10"""
    ),
)
register(
    "device_timeseries",
    lambda i: dashboard.device_timeseries(i.tables(), i.as_of, 6, 2),
    query(
        f"""SELECT date_trunc('hour', received_at) AS bucket, exporter, {_big('bytes')}
            FROM recent WHERE exporter IN (SELECT exporter FROM recent GROUP BY exporter
                                           ORDER BY sum(bytes) DESC, exporter LIMIT 2)
            GROUP BY 1, 2""",
        """recent AS (SELECT conv.* FROM conv, clock
             WHERE received_at >= as_of - INTERVAL '6 hours' AND exporter IS NOT NULL)""",
    ),
)
_TEN = "date_trunc('hour', {c}) + (date_part('minute', {c}) // 10) * INTERVAL '10 minutes'"
register(
    "traffic_timeseries",
    lambda i: dashboard.traffic_timeseries(i.tables(), i.as_of, 24),
    query(
        f"""SELECT {_TEN.format(c='t.bucket')} AS bucket, {_big('bytes', 'packets', 'flows')}
            FROM {_recent('total_1m', 24)} t GROUP BY 1"""
    ),
)

# -- detailed flows ---------------------------------------------------------------

_IN, _OUT = "'ifIndex ' || f.in_if", "'ifIndex ' || f.out_if"
LISTING_SQL = f"""
SELECT conv_key, received_at, flow_time, f.first_seen, f.last_seen, flow_count, f.exporter, {DEVICE} AS exporter_hostname,
  flow_type, src_addr, dst_addr, src_port, dst_port, proto, bytes, packets, in_if, out_if, service_port, service_side,
  {interface_label('a', _IN, 'NULL')} AS in_if_name, {interface_label('b', _OUT, 'NULL')} AS out_if_name, sampling_rate
FROM conv f CROSS JOIN clock LEFT JOIN exporters e ON e.ip = f.exporter
LEFT JOIN interfaces a ON a.exporter = f.exporter AND a.if_index = f.in_if
LEFT JOIN interfaces b ON b.exporter = f.exporter AND b.if_index = f.out_if"""
register(
    "flows_list",
    lambda i: flows.listing(
        i.tables(), FlowFilter(hours=6, interface="ether", proto=6), i.as_of, sort="exporter",
        order="asc", limit=100, offset=20,
    ),
    query(
        f"""{LISTING_SQL} WHERE received_at >= as_of - INTERVAL '6 hours' AND proto = 6
            AND (f.in_if::VARCHAR = 'ether' OR f.out_if::VARCHAR = 'ether' OR a.if_name ILIKE '%ether%'
                 OR b.if_name ILIKE '%ether%' OR a.if_descr ILIKE '%ether%' OR b.if_descr ILIKE '%ether%')
            ORDER BY coalesce({DEVICE}, f.exporter) NULLS LAST, conv_key DESC, bucket_start DESC LIMIT 100 OFFSET 20"""
    ),
)
_LATEST_SQL = query(
    f"""{LISTING_SQL} WHERE bucket_start >= (SELECT max(bucket_start) - INTERVAL '10 minutes' FROM conv)
        ORDER BY received_at DESC, conv_key DESC, bucket_start DESC LIMIT 10"""
)
register("latest_conversations", lambda i: flows.latest(i.tables()), _LATEST_SQL)
register(
    "flows_count",
    lambda i: flows.count(i.tables(), FlowFilter(hours=6, q="10.0.1", interface="CHINA"), i.as_of),
    query(
        """SELECT count(*) AS total FROM conv f, clock WHERE received_at >= as_of - INTERVAL '6 hours'
             AND (src_addr ILIKE '%10.0.1%' OR dst_addr ILIKE '%10.0.1%' OR exporter ILIKE '%10.0.1%' OR src_port::VARCHAR ILIKE '%10.0.1%'
                  OR dst_port::VARCHAR ILIKE '%10.0.1%' OR service_port::VARCHAR ILIKE '%10.0.1%')
             AND (in_if::VARCHAR = 'CHINA' OR out_if::VARCHAR = 'CHINA' OR EXISTS (
               SELECT 1 FROM interfaces n WHERE n.exporter = f.exporter AND n.if_index IN (f.in_if, f.out_if)
               AND (n.if_name ILIKE '%CHINA%' OR n.if_descr ILIKE '%CHINA%')))"""
    ),
)

_NONE = "CAST(NULL AS VARCHAR)"
_SHAPES = {
    "pair": (
        FlowFilter(hours=6),
        f"{_NONE} AS peer_addr, src_addr, dst_addr", "coalesce(service_port, dst_port, src_port)", "true",
    ),
    "source": (
        FlowFilter(hours=6, src="10.0.1.2"),
        f"dst_addr AS peer_addr, {_NONE} AS src_addr, dst_addr",
        "coalesce(service_port, dst_port, src_port)", "src_addr = '10.0.1.2'",
    ),
    "destination": (
        FlowFilter(hours=6, dst="198.51.100."),
        f"src_addr AS peer_addr, src_addr, {_NONE} AS dst_addr",
        "coalesce(service_port, src_port, dst_port)", "dst_addr ILIKE '%198.51.100.%'",
    ),
}
_SUMMARY_ORDER = "ORDER BY bytes DESC NULLS LAST, src_addr NULLS LAST, dst_addr NULLS LAST, proto NULLS LAST, port NULLS LAST LIMIT 100"
for _mode, (_flt, _addresses, _port, _condition) in _SHAPES.items():
    register(
        f"flows_summary_{_mode}",
        lambda i, flt=_flt: flows.summary(i.tables(), flt, i.as_of, limit=100),
        query(
            f"""SELECT {_addresses}, proto, {_port} AS port, {_big('bytes', 'packets')},
                  CAST(sum(flow_count) AS BIGINT) AS flows, max(last_seen) AS last_seen
                FROM conv, clock WHERE received_at >= as_of - INTERVAL '6 hours' AND {_condition}
                GROUP BY 1, 2, 3, 4, 5 {_SUMMARY_ORDER}"""
        ),
    )
    register(
        f"stats_summary_{_mode}",
        lambda i, flt=_flt: statistics.summary(
            i.tables(), flt.with_range(i.as_of - timedelta(hours=7), i.as_of - timedelta(minutes=10)), limit=100
        ),
        query(
            f"""SELECT {_addresses}, proto, nullif(service_port, 0) AS port, {_big('bytes', 'packets', 'flows')},
                  max(bucket_start + INTERVAL '5 minutes') AS last_seen
                FROM stats, clock WHERE bucket_start >= as_of - INTERVAL '7 hours'
                  AND bucket_start < as_of - INTERVAL '5 minutes' AND {_condition}
                GROUP BY 1, 2, 3, 4, 5 {_SUMMARY_ORDER}"""
        ),
    )
register(
    "flows_summary_count",
    lambda i: flows.summary_count(i.tables(), FlowFilter(hours=6, dst="198.51.100."), i.as_of),
    query(
        """SELECT 'destination' AS mode, count(*) AS total FROM (
             SELECT DISTINCT src_addr, proto, coalesce(service_port, src_port, dst_port) FROM conv, clock
             WHERE received_at >= as_of - INTERVAL '6 hours' AND dst_addr ILIKE '%198.51.100.%')"""
    ),
)
register(
    "flows_series",
    lambda i: flows.series(i.tables(), FlowFilter(exporter="192.0.2.1", port=443), i.as_of),
    query(
        f"""SELECT {_TEN.format(c='received_at')} AS bucket, {_big('bytes', 'packets')},
              CAST(sum(flow_count) AS BIGINT) AS flows
            FROM conv WHERE exporter = '192.0.2.1' AND (service_port = 443 OR src_port = 443 OR dst_port = 443)
            GROUP BY 1"""
    ),
)

# -- who talks to whom --------------------------------------------------------------

_PAIR_ORDER = (
    f"ORDER BY bytes DESC, {inet_key('src_addr')} NULLS LAST, {inet_key('dst_addr')} NULLS LAST LIMIT 100"
)
CONVERSATIONS_IP_SQL = query(
    f"""SELECT src_addr, dst_addr, {_big('bytes', 'packets')}, CAST(sum(flow_count) AS BIGINT) AS flows,
          min(first_seen) AS first_seen, max(last_seen) AS last_seen
        FROM conv, clock WHERE received_at >= as_of - INTERVAL '24 hours' GROUP BY 1, 2 {_PAIR_ORDER}"""
)


def conversations_ip(i: Inputs):
    return conversations.by_ip(i.tables(), FlowFilter(hours=24), i.as_of, limit=100)


register("conversations_ip", conversations_ip, CONVERSATIONS_IP_SQL)


def _path_names(absent: bool) -> str:
    if absent:
        a, b = "'ifIndex ' || f.in_if", "'ifIndex ' || f.out_if"
    else:
        a, b = (
            f"'ifIndex ' || coalesce(CAST(f.{c} AS VARCHAR), '—')" for c in ("in_if", "out_if")
        )
    return (
        f"{interface_label('a', a, a)} AS in_if_name, {interface_label('b', b, b)} AS out_if_name, "
        f"coalesce({DEVICE}, f.exporter) AS device_name"
    )


_PATH_JOINS = """
LEFT JOIN exporters e ON e.ip = f.exporter
LEFT JOIN interfaces a ON a.exporter = f.exporter AND a.if_index = f.in_if
LEFT JOIN interfaces b ON b.exporter = f.exporter AND b.if_index = f.out_if
ORDER BY bytes DESC, f.exporter NULLS LAST, f.in_if NULLS LAST, f.out_if NULLS LAST LIMIT 100"""
register(
    "conversations_interface",
    lambda i: conversations.by_interface(i.tables(), FlowFilter(hours=24), i.as_of, limit=100),
    query(
        f"""SELECT f.exporter, f.in_if, f.out_if, {_path_names(False)}, bytes, packets, flows, f.last_seen
            FROM (SELECT exporter, in_if, out_if, {_big('bytes', 'packets')}, CAST(sum(flow_count) AS BIGINT) AS flows,
                    max(last_seen) AS last_seen FROM conv GROUP BY 1, 2, 3) f {_PATH_JOINS}"""
    ),
)


def _both_counts(i: Inputs):
    flt = FlowFilter(hours=6)
    parts = [
        conversations.count(i.tables(), flt, i.as_of, how).select(F.lit(how).alias("group_by"), "total")
        for how in ("ip", "interface")
    ]
    return parts[0].unionByName(parts[1])


register(
    "conversations_count", _both_counts,
    query(
        """SELECT 'ip' AS group_by, count(*) AS total FROM (SELECT DISTINCT src_addr, dst_addr FROM recent)
           UNION ALL SELECT 'interface', count(*) FROM (SELECT DISTINCT exporter, in_if, out_if FROM recent)""",
        "recent AS (SELECT conv.* FROM conv, clock WHERE received_at >= as_of - INTERVAL '6 hours')",
    ),
)

# -- statistics -----------------------------------------------------------------------

_STATS_LISTING = f"""
SELECT bucket_start AS received_at, bucket_start AS first_seen, bucket_start + INTERVAL '5 minutes' AS last_seen,
  flows AS flow_count, f.exporter, {DEVICE} AS exporter_hostname, 'statistics' AS flow_type, src_addr, dst_addr,
  CAST(NULL AS INT) AS src_port, CAST(NULL AS INT) AS dst_port, proto, bytes, packets, f.in_if, f.out_if,
  f.service_port, f.service_side, {interface_label('a', _IN, 'NULL')} AS in_if_name, {interface_label('b', _OUT, 'NULL')} AS out_if_name
FROM (SELECT * REPLACE (nullif(in_if, 0) AS in_if, nullif(out_if, 0) AS out_if, nullif(service_port, 0) AS service_port,
             nullif(service_side, '') AS service_side),
             in_if AS k_in, out_if AS k_out, service_port AS k_port, service_side AS k_side FROM stats) f
CROSS JOIN clock LEFT JOIN exporters e ON e.ip = f.exporter
LEFT JOIN interfaces a ON a.exporter = f.exporter AND a.if_index = f.in_if
LEFT JOIN interfaces b ON b.exporter = f.exporter AND b.if_index = f.out_if"""
_STATS_TIES = "bytes DESC, bucket_start, f.exporter, src_addr, dst_addr, proto, k_port, k_side, k_in, k_out"
register(
    "stats_flows",
    lambda i: statistics.listing(
        i.tables(), FlowFilter(interface_index=2), sort="out_if", order="asc", limit=100, offset=10
    ),
    query(
        f"""{_STATS_LISTING} WHERE k_in = 2 OR k_out = 2
            ORDER BY k_out NULLS LAST, {_STATS_TIES} LIMIT 100 OFFSET 10"""
    ),
)
register(
    "stats_flows_count",
    lambda i: statistics.count(i.tables(), FlowFilter(src="10.0", src_port=443)),
    query(
        """SELECT count(*) AS total FROM stats
           WHERE src_addr ILIKE '%10.0%' AND service_side = 'source' AND service_port = 443"""
    ),
)
register(
    "stats_summary_count",
    lambda i: statistics.summary_count(i.tables(), FlowFilter(src="10.0.1.2")),
    query(
        """SELECT 'source' AS mode, count(*) AS total FROM (
             SELECT DISTINCT dst_addr, proto, service_port FROM stats WHERE src_addr = '10.0.1.2')"""
    ),
)
_STATS_PAIRS = f"""
SELECT src_addr, dst_addr, {_big('bytes', 'packets', 'flows')}, min(bucket_start) AS first_seen,
  max(bucket_start + INTERVAL '5 minutes') AS last_seen FROM stats, clock"""
register(
    "stats_conversations_ip",
    lambda i: statistics.conversations_by_ip(i.tables(), FlowFilter(), limit=100),
    query(f"{_STATS_PAIRS} GROUP BY 1, 2 {_PAIR_ORDER}"),
)
register(
    "stats_conversations_interface",
    lambda i: statistics.conversations_by_interface(i.tables(), FlowFilter(), limit=100),
    query(
        f"""SELECT f.exporter, f.in_if, f.out_if, {_path_names(True)}, bytes, packets, flows, f.last_seen
            FROM (SELECT exporter, nullif(in_if, 0) AS in_if, nullif(out_if, 0) AS out_if, {_big('bytes', 'packets', 'flows')},
                    max(bucket_start + INTERVAL '5 minutes') AS last_seen FROM stats GROUP BY 1, 2, 3) f {_PATH_JOINS}"""
    ),
)


def _both_stats_counts(i: Inputs):
    parts = [
        statistics.conversations_count(i.tables(), FlowFilter(), how).select(
            F.lit(how).alias("group_by"), "total"
        )
        for how in ("ip", "interface")
    ]
    return parts[0].unionByName(parts[1])


register(
    "stats_conversations_count", _both_stats_counts,
    query(
        """SELECT 'ip' AS group_by, count(*) AS total FROM (SELECT DISTINCT src_addr, dst_addr FROM stats)
           UNION ALL SELECT 'interface', count(*) FROM (SELECT DISTINCT exporter, in_if, out_if FROM stats)"""
    ),
)

# -- custom periods and history --------------------------------------------------------


def _period(i: Inputs, start_hours: int) -> FlowFilter:
    return FlowFilter(
        date_from=i.as_of - timedelta(hours=start_hours), date_to=i.as_of - timedelta(minutes=30)
    )


_SHARED = ", ".join(periods.SHARED)


def _smart_flows(i: Inputs):
    """The same end, once inside and once reaching beyond six detailed hours."""
    parts = [
        periods.period_flows(i.tables(), _period(i, h), i.as_of, 6, limit=50) for h in (5, 9)
    ]
    return parts[0].unionByName(parts[1])


register(
    "smart_period_flows", _smart_flows,
    query(
        f"""SELECT {_SHARED} FROM ({LISTING_SQL} WHERE received_at >= as_of - INTERVAL '5 hours'
              AND received_at <= as_of - INTERVAL '30 minutes'
              ORDER BY received_at DESC, conv_key DESC, bucket_start DESC LIMIT 50)
            UNION ALL
            SELECT {_SHARED} FROM ({_STATS_LISTING} WHERE bucket_start >= as_of - INTERVAL '9 hours'
              AND bucket_start < as_of - INTERVAL '25 minutes'
              ORDER BY bucket_start DESC, {_STATS_TIES} LIMIT 50)"""
    ),
)


def _smart_conversations(i: Inputs):
    parts = [
        periods.period_conversations(i.tables(), _period(i, h), i.as_of, 6, limit=100) for h in (5, 9)
    ]
    return parts[0].unionByName(parts[1])


register(
    "smart_period_conversations", _smart_conversations,
    query(
        f"""SELECT * FROM (SELECT src_addr, dst_addr, {_big('bytes', 'packets')}, CAST(sum(flow_count) AS BIGINT) AS flows,
              min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM conv, clock
              WHERE received_at >= as_of - INTERVAL '5 hours' AND received_at <= as_of - INTERVAL '30 minutes'
              GROUP BY 1, 2 {_PAIR_ORDER})
            UNION ALL
            SELECT * FROM ({_STATS_PAIRS} WHERE bucket_start >= as_of - INTERVAL '9 hours'
              AND bucket_start < as_of - INTERVAL '25 minutes' GROUP BY 1, 2 {_PAIR_ORDER})"""
    ),
)


_HISTORY = {
    "source": ("src_1m", "src_addr", "src_addr"),
    "destination": ("dst_1m", "dst_addr", "dst_addr"),
    "exporter": ("exporter_1m", "exporter", "exporter"),
    "interface": ("interface_1m", "exporter || '#' || if_index", "exporter, if_index"),
    "application": ("app_1m", "proto || '/' || port", "proto, port"),
    "total": ("total_1m", "'all'", ""),
}


def _history(i: Inputs):
    """All six views below one another, the keys as one text."""
    shown = {
        "source": F.col("src_addr"), "destination": F.col("dst_addr"), "exporter": F.col("exporter"),
        "interface": F.concat_ws("#", "exporter", "if_index"),
        "application": F.concat_ws("/", "proto", "port"), "total": F.lit("all"),
    }
    out = None
    for kind, label in shown.items():
        part = history.view(i.tables(), kind, i.as_of, detailed_hours=3, stats_days=30).select(
            F.lit(kind).alias("kind"), label.alias("label"),
            "bytes", "packets", "flows", "first_bucket", "last_bucket",
        )
        out = part if out is None else out.unionByName(part)
    return out


register(
    "history_view", _history,
    query(
        " UNION ALL ".join(
            f"""(SELECT '{kind}' AS kind, {label} AS label, {_big('bytes', 'packets', 'flows')},
                   min(bucket) AS first_bucket, max(bucket) AS last_bucket FROM {table}, clock
                 WHERE bucket >= as_of - INTERVAL '30 days' AND bucket < as_of - INTERVAL '3 hours'
                 {'GROUP BY ' + keys if keys else ''} {'HAVING count(*) > 0'}
                 ORDER BY 3 DESC{', ' + keys if keys else ''} LIMIT 100)"""
            for kind, (table, label, keys) in _HISTORY.items()
        )
    ),
)

# -- inventory ----------------------------------------------------------------------------

_DETAIL = f"""e.ip AS exporter, e.hostname, e.custom_name, coalesce({DEVICE}, e.ip) AS display_name,
  CAST(NULL AS VARCHAR) AS sys_descr, e.first_seen, e.last_seen, e.last_seen >= c.as_of - INTERVAL '5 minutes' AS active"""
register(
    "exporters_list",
    lambda i: inventory.exporters_list(i.tables(), i.as_of),
    query(
        f"""SELECT {_DETAIL}, CAST(coalesce(t.flows, 0) AS BIGINT) AS flows, CAST(coalesce(t.bytes, 0) AS BIGINT) AS bytes,
              coalesce(n.interfaces, 0) AS interfaces
            FROM exporters e CROSS JOIN clock c
            LEFT JOIN (SELECT exporter, sum(flows) AS flows, sum(bytes) AS bytes FROM exporter_1m GROUP BY 1) t ON t.exporter = e.ip
            LEFT JOIN (SELECT exporter, count(*) AS interfaces FROM interfaces GROUP BY 1) n ON n.exporter = e.ip"""
    ),
)
register(
    "exporter_detail",
    lambda i: inventory.exporter_detail(i.tables(), i.as_of, "192.0.2.3/32"),
    query(f"SELECT {_DETAIL} FROM exporters e, clock c WHERE e.ip = '192.0.2.3'"),
)


def _devices(i: Inputs):
    """Addresses of both kinds: those seen in traffic and those of the name cache."""
    seen = i.flows.select(F.explode(F.array("src_addr", "dst_addr")).alias("ip"))
    return seen.unionByName(i.dns_cache.select("ip"))


register(
    "ip_labels",
    lambda i: inventory.label_addresses(_devices(i), i.tables(), i.as_of),
    query(
        """SELECT r.ip, coalesce(m.name, d.hostname) AS name,
             CASE WHEN m.name IS NOT NULL THEN 'manual' ELSE 'dns' END AS source,
             coalesce(m.name, d.hostname) || ' (' || r.ip || ')' AS text
           FROM (SELECT src_addr AS ip FROM flows UNION SELECT dst_addr FROM flows UNION SELECT ip FROM dns_cache) r
           LEFT JOIN ip_names m ON m.ip = r.ip
           LEFT JOIN (SELECT ip, nullif(hostname, '') AS hostname FROM dns_cache, clock
                      WHERE resolved_at > as_of - INTERVAL '24 hours' AND ip LIKE '8.8.%') d ON d.ip = r.ip
           WHERE coalesce(m.name, d.hostname) IS NOT NULL"""
    ),
)
register(
    "service_labels",
    lambda i: inventory.service_labels(i.tables(), i.spark),
    query(
        """SELECT proto, port, coalesce(max(custom), max(service)) AS description FROM (
             SELECT proto, port, service, NULL AS custom FROM services
             UNION ALL SELECT proto, port, NULL, description FROM port_descriptions) GROUP BY 1, 2"""
    ),
)
register(
    "port_descriptions_list",
    lambda i: inventory.port_descriptions(i.tables()),
    query(
        f"""SELECT proto, port, description, {protocol_name('p.proto')} AS protocol,
              description || ' ' || {protocol_name('p.proto')} || '/' || port AS label
            FROM port_descriptions p"""
    ),
)
_IF_COLUMNS = """i.if_name, i.if_descr, i.if_alias, i.custom_name, CAST(NULL AS BIGINT) AS if_speed,
  CAST(NULL AS INT) AS admin_status, CAST(NULL AS INT) AS oper_status, CAST(NULL AS TIMESTAMP) AS updated_at"""
register(
    "interface_inventory",
    lambda i: inventory.interface_inventory(i.tables()),
    query(
        f"""SELECT k.exporter, e.hostname, e.custom_name AS exporter_custom_name, coalesce({DEVICE}, k.exporter) AS display_name,
              k.if_index, {_IF_COLUMNS}
            FROM (SELECT exporter, if_index FROM interface_1m UNION SELECT exporter, if_index FROM interfaces) k
            LEFT JOIN interfaces i ON i.exporter = k.exporter AND i.if_index = k.if_index
            LEFT JOIN exporters e ON e.ip = k.exporter"""
    ),
)
register(
    "exporter_interfaces",
    lambda i: inventory.exporter_interfaces(i.tables(), "192.0.2.2"),
    query(f"SELECT i.if_index, {_IF_COLUMNS} FROM interfaces i WHERE exporter = '192.0.2.2'"),
)


def _interface_refresh(i: Inputs):
    lines = samples.rows(i, samples.WALK_SQL)
    polled_at = F.timestamp_micros(F.lit(1_704_067_200_000_000))
    return dimensions.refresh_interfaces(i.interfaces, lines, polled_at)


register(
    "interface_refresh", _interface_refresh,
    query(
        """SELECT coalesce(w.exporter, i.exporter) AS exporter, coalesce(w.if_index, i.if_index) AS if_index,
             CASE WHEN polled THEN w.if_name ELSE i.if_name END AS if_name,
             CASE WHEN polled THEN w.if_descr ELSE i.if_descr END AS if_descr,
             CASE WHEN polled THEN w.if_alias ELSE i.if_alias END AS if_alias, i.custom_name,
             w.if_speed, w.admin_status, w.oper_status,
             CASE WHEN polled THEN TIMESTAMP '2024-01-01 00:00:00' END AS updated_at
           FROM interfaces i FULL JOIN (
             SELECT '192.0.2.' || CAST(1 + c_custkey % 3 AS VARCHAR) AS exporter, CAST(c_custkey AS INT) AS if_index,
               'port' || c_custkey AS if_name, c_mktsegment AS if_descr,
               CASE WHEN c_custkey % 2 = 0 THEN 'to ' || c_name END AS if_alias,
               CASE WHEN c_custkey % 3 = 0 THEN 100000000 + c_custkey ELSE (c_custkey % 3) * 1000000000 END AS if_speed,
               1 AS admin_status, CAST(CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS INT) AS oper_status, true AS polled
             FROM customer) w ON w.exporter = i.exporter AND w.if_index = i.if_index"""
    ),
)
