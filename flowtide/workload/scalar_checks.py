"""Queries over the scalar functions, every row of the input in the output."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.functions import buckets, ip, labels, proto, service, variants
from flowtide.jobs import retention
from flowtide.operators import dimensions
from flowtide.operators.condense import with_service
from flowtide.operators.filters import clamp_column
from flowtide.plans import periods
from flowtide.workload import samples
from flowtide.workload.adapter import Inputs
from flowtide.workload.base_sql import inet_key, interface_label, protocol_name, query
from flowtide.workload.registry import register


def _duck(sql: str) -> str:
    return sql.replace("{S}", "VARCHAR").replace("{K}", "unnest(range(0, 8))")


def _sample(sql: str) -> str:
    return f"sample AS ({_duck(sql)})"


_CANONICAL = """
  CASE event_id % 8
    WHEN 0 THEN v
    WHEN 1 THEN replace(v, '/32', '')
    WHEN 2 THEN trim(v)
    WHEN 5 THEN '2001:db8::' || lower(hex(event_id % 65536))
    WHEN 6 THEN v
    WHEN 7 THEN 'fe80::' || lower(hex(1 + event_id % 60000)) || ':0:0'
    ELSE {rest} END"""


def _addresses(function):
    return lambda i: samples.rows(i, samples.ADDRESS_SQL).select(
        "event_id", "v", function(F.col("v")).alias("address")
    )


register(
    "fn_ip_from", _addresses(ip.ip_from),
    query(f"SELECT event_id, v, {_CANONICAL.format(rest='NULL')} AS address FROM sample",
          _sample(samples.ADDRESS_SQL)),
)
register(
    "fn_normalize_host", _addresses(ip.normalize_host),
    query(f"SELECT event_id, v, {_CANONICAL.format(rest='v')} AS address FROM sample",
          _sample(samples.ADDRESS_SQL)),
)
register(
    "fn_inet_sort_key",
    lambda i: samples.rows(i, samples.ADDRESS_SQL)
    .select("event_id", ip.canonical(ip.collector_host(F.col("v"))).alias("address"))
    .select("event_id", "address", ip.inet_sort_key(F.col("address")).alias("sort_key")),
    query(
        f"""
        SELECT event_id, address,
          CASE event_id % 8
            WHEN 5 THEN '620010db8' || repeat('0', 20) || lpad(lower(hex(event_id % 65536)), 4, '0')
            WHEN 7 THEN '6fe80' || repeat('0', 16) || lpad(lower(hex(1 + event_id % 60000)), 4, '0') || '00000000'
            ELSE {inet_key('address')} END AS sort_key
        FROM (SELECT event_id, CASE WHEN event_id % 8 <> 6 THEN {_CANONICAL.format(rest='NULL')} END AS address
              FROM sample)""",
        _sample(samples.ADDRESS_SQL),
    ),
)
register(
    "fn_is_global",
    lambda i: samples.rows(i, samples.GLOBAL_SQL).select(
        "event_id", "ip", ip.is_global(F.col("ip")).alias("is_global")
    ),
    query(
        """
        SELECT event_id, ip, NOT (
            a IN (0, 10, 127) OR a >= 240 OR (a = 100 AND b BETWEEN 64 AND 127)
            OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
            OR (a = 192 AND b = 0 AND c = 0 AND d NOT IN (9, 10)) OR (a = 192 AND b = 0 AND c = 2)
            OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100)
            OR (a = 203 AND b = 0 AND c = 113)) AS is_global
        FROM (SELECT *, (event_id * 37) % 256 AS a, (event_id * 101) % 256 AS b,
                     (event_id * 7) % 256 AS c, event_id % 256 AS d FROM sample)""",
        _sample(samples.GLOBAL_SQL),
    ),
)
register(
    "fn_as_int",
    lambda i: samples.rows(i, samples.NUMBER_SQL).select(
        "event_id", "line",
        variants.int_field(F.try_parse_json("line"), "f").alias("number"),
    ),
    query(
        """
        SELECT event_id, line, CAST(CASE event_id % 8 WHEN 3 THEN NULL WHEN 4 THEN 1 WHEN 5 THEN NULL
            WHEN 6 THEN NULL ELSE event_id END AS BIGINT) AS number FROM sample""",
        _sample(samples.NUMBER_SQL),
    ),
)
register(
    "fn_flow_time",
    lambda i: samples.rows(i, samples.TIME_SQL).select(
        "event_id", "line",
        variants.flow_time_field(
            F.try_parse_json("line"), "time_flow_start_ns", "time_received_ns"
        ).alias("flow_time"),
    ),
    query(
        """
        SELECT event_id, line, make_timestamp(CASE event_id % 6
            WHEN 0 THEN (1700000000123456789 + event_id) // 1000
            WHEN 1 THEN 1700000000000000 + event_id
            WHEN 2 THEN 1600000000000000 + event_id
            WHEN 5 THEN 1500000000000000 + event_id END) AS flow_time FROM sample""",
        _sample(samples.TIME_SQL),
    ),
)
register(
    "fn_parse_protocol",
    lambda i: samples.rows(i, samples.PROTO_SQL).select(
        "event_id", "v", proto.protocol_from_text(F.col("v")).alias("proto")
    ),
    query(
        """
        SELECT event_id, v, CAST(CASE event_id % 12 WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 58
            WHEN 3 THEN 43 WHEN 4 THEN event_id % 256 WHEN 7 THEN 132 WHEN 8 THEN 58
            WHEN 10 THEN 44 WHEN 11 THEN 47 END AS INT) AS proto FROM sample""",
        _sample(samples.PROTO_SQL),
    ),
)
register(
    "fn_protocol_name",
    lambda i: samples.rows(i, samples.PROTO_SQL).select(
        "event_id", "number", proto.protocol_name(F.col("number")).alias("name")
    ),
    query(f"SELECT event_id, number, {protocol_name('s.number')} AS name FROM sample s",
          _sample(samples.PROTO_SQL)),
)

_NAMED = f"named AS (SELECT *, {protocol_name('s.proto')} AS kind FROM sample s)"
_APP = """
  CASE WHEN coalesce(n.port, 0) = 0 THEN 'Other · ' || n.kind
       WHEN v.service IS NOT NULL THEN v.service || ' · ' || n.kind || '/' || n.port
       ELSE n.kind || '/' || n.port END"""
register(
    "fn_app_name",
    lambda i: samples.rows(i, samples.APP_SQL).select(
        "event_id", "proto", "port", proto.app_name(F.col("proto"), F.col("port")).alias("app")
    ),
    query(
        f"""SELECT n.event_id, n.proto, n.port, {_APP} AS app FROM named n
            LEFT JOIN services v ON v.proto = n.proto AND v.port = n.port""",
        _sample(samples.APP_SQL), _NAMED,
    ),
)
register(
    "fn_service_label",
    lambda i: samples.rows(i, samples.APP_SQL)
    .join(i.port_descriptions, ["proto", "port"], "left")
    .select(
        "event_id", "proto", "port",
        proto.service_label(F.col("description"), F.col("proto"), F.col("port")).alias("label"),
    ),
    query(
        f"""SELECT n.event_id, n.proto, n.port,
              coalesce(p.description || ' ' || n.kind || '/' || n.port, {_APP}) AS label
            FROM named n LEFT JOIN services v ON v.proto = n.proto AND v.port = n.port
            LEFT JOIN port_descriptions p ON p.proto = n.proto AND p.port = n.port""",
        _sample(samples.APP_SQL), _NAMED,
    ),
)
register(
    "fn_service_endpoint",
    lambda i: with_service(i.flows).select(
        "seq", "src_port", "dst_port", "proto", "service_port", "service_side",
        "key_src_port", "key_dst_port",
    ),
    query(
        """SELECT seq, src_port, dst_port, proto, service_port, service_side, key_src_port, key_dst_port
           FROM keyed"""
    ),
)
register(
    "fn_conversation_key",
    lambda i: with_service(i.flows).select("seq", service.conversation_key().alias("conv_key")),
    query(
        """SELECT seq, sha1(concat_ws('|', coalesce(exporter, ''), coalesce(src_addr, ''),
             coalesce(dst_addr, ''), coalesce(proto::VARCHAR, ''), coalesce(service_port::VARCHAR, ''),
             coalesce(service_side, ''), coalesce(key_src_port::VARCHAR, ''),
             coalesce(key_dst_port::VARCHAR, ''), coalesce(in_if::VARCHAR, ''),
             coalesce(out_if::VARCHAR, ''))) AS conv_key FROM keyed"""
    ),
)


def _time_buckets(i: Inputs):
    at = F.col("ts").cast("timestamp")
    return i.table("events").select(
        "event_id",
        buckets.minute(at).alias("minute"),
        buckets.five_minutes(at).alias("five"),
        buckets.ten_minutes(at).alias("ten"),
        buckets.hour(at).alias("hour"),
    )


register(
    "fn_time_buckets", _time_buckets,
    """SELECT event_id, date_trunc('minute', ts) AS minute,
         time_bucket(INTERVAL '5 minutes', ts) AS five,
         date_trunc('hour', ts) + (date_part('minute', ts) // 10) * INTERVAL '10 minutes' AS ten,
         date_trunc('hour', ts) AS hour FROM events""",
)
register(
    "fn_exporter_label",
    lambda i: samples.rows(i, samples.DEVICE_SQL).select(
        "s_suppkey",
        labels.device_label(F.col("custom_name"), F.col("hostname"), F.col("ip")).alias("label"),
        labels.display_name(F.col("custom_name"), F.col("hostname"), F.col("ip")).alias("display"),
    ),
    query(
        """SELECT s_suppkey, coalesce(name || ' (' || ip || ')', ip) AS label, coalesce(name, ip) AS display
           FROM (SELECT *, coalesce(nullif(custom_name, ''), nullif(hostname, '')) AS name FROM sample)""",
        _sample(samples.DEVICE_SQL),
    ),
)


def _interface_labels(i: Inputs):
    names = [F.col(c) for c in ("custom_name", "if_name", "if_descr", "if_alias")]
    index = F.col("if_index")
    plain = labels.if_index_text(index)
    return samples.rows(i, samples.PORT_TABLE_SQL).select(
        "c_custkey",
        labels.interface_label(*names, plain, F.lit(None).cast("string")).alias("in_listing"),
        labels.interface_label(*names, plain).alias("in_top"),
        labels.interface_label(*names, labels.if_index_text(index, labels.DASH)).alias("in_path"),
    )


register(
    "fn_interface_label", _interface_labels,
    query(
        "SELECT c_custkey, "
        + interface_label("i", "'ifIndex ' || i.if_index", "NULL") + " AS in_listing, "
        + interface_label("i", "'ifIndex ' || i.if_index", "'ifIndex ' || i.if_index") + " AS in_top, "
        + interface_label(
            "i", "'ifIndex ' || coalesce(CAST(i.if_index AS VARCHAR), '—')",
            "'ifIndex ' || coalesce(CAST(i.if_index AS VARCHAR), '—')",
        )
        + " AS in_path FROM sample i",
        _sample(samples.PORT_TABLE_SQL),
    ),
)
register(
    "fn_ilike",
    lambda i: i.table("customer").select(
        "c_custkey",
        labels.contains_text(F.col("c_name"), "CUSTOMER").alias("any_case"),
        labels.contains_text(F.col("c_mktsegment"), "b_i").alias("one_any"),
        labels.contains_text(F.col("c_mktsegment"), "a%e").alias("gap"),
        labels.contains_text(F.col("c_name"), "0\\01").alias("escaped"),
    ),
    """SELECT c_custkey, c_name ILIKE '%CUSTOMER%' AS any_case, c_mktsegment ILIKE '%b_i%' AS one_any,
         c_mktsegment ILIKE '%a%e%' AS gap, c_name ILIKE '%001%' AS escaped FROM customer""",
)
register(
    "param_clamps",
    lambda i: i.table("events").select(
        "event_id",
        clamp_column(F.col("event_id") - 50, 1, 8760).alias("hours"),
        clamp_column(F.col("event_id") - 50, 1, 720).alias("hours_short"),
        clamp_column(F.col("event_id") - 50, 1, 50).alias("top_limit"),
        clamp_column(F.col("event_id") - 50, 1, 10).alias("device_limit"),
        clamp_column(F.col("event_id") - 50, 1, 100).alias("page_limit"),
        F.greatest(F.col("event_id") - 50, F.lit(0)).alias("offset_rows"),
    ),
    """SELECT event_id, CAST(CASE WHEN n < 1 THEN 1 WHEN n > 8760 THEN 8760 ELSE n END AS BIGINT) AS hours,
         CAST(CASE WHEN n < 1 THEN 1 WHEN n > 720 THEN 720 ELSE n END AS BIGINT) AS hours_short,
         CAST(CASE WHEN n < 1 THEN 1 WHEN n > 50 THEN 50 ELSE n END AS BIGINT) AS top_limit,
         CAST(CASE WHEN n < 1 THEN 1 WHEN n > 10 THEN 10 ELSE n END AS BIGINT) AS device_limit,
         CAST(CASE WHEN n < 1 THEN 1 WHEN n > 100 THEN 100 ELSE n END AS BIGINT) AS page_limit,
         CAST(CASE WHEN n < 0 THEN 0 ELSE n END AS BIGINT) AS offset_rows
       FROM (SELECT event_id, event_id - 50 AS n FROM events)""",
)
register(
    "retention_params",
    lambda i: i.table("part").select(
        "p_partkey",
        retention.snap_detailed_column(F.col("p_size")).alias("detailed_hours"),
        retention.stats_days_column(F.col("p_partkey")).alias("stats_days"),
    ),
    """SELECT p_partkey, CAST(CASE WHEN p_size <= 2 THEN 1 WHEN p_size <= 4 THEN 3 WHEN p_size <= 9 THEN 6
           WHEN p_size <= 18 THEN 12 ELSE 24 END AS INT) AS detailed_hours,
         CAST(greatest(1, (p_partkey + 23) // 24) AS INT) AS stats_days FROM part""",
)
register(
    "presets",
    lambda i: i.table("part").select(
        "p_partkey", "p_size", periods.presets_column(F.col("p_size")).alias("presets")
    ),
    """SELECT p_partkey, p_size,
         array_to_string(list_filter([1, 3, 6, 12, 24], lambda h: h <= p_size), '/') AS presets FROM part""",
)
register(
    "route_tier",
    lambda i: i.flows.select(
        "seq",
        periods.tier_column(
            F.col("received_at"), F.col("received_at") + F.expr("INTERVAL '30' MINUTE"), i.as_of, 6
        ).alias("tier"),
    ),
    query(
        """SELECT seq, CASE WHEN received_at >= as_of - INTERVAL '6 hours'
             AND received_at + INTERVAL '30 minutes' <= as_of THEN 'detailed' ELSE 'statistics' END AS tier
           FROM flows, clock"""
    ),
)
register(
    "snmp_walk_parse",
    lambda i: dimensions.parse_walk(samples.rows(i, samples.WALK_SQL)),
    query(
        """SELECT exporter, line_no, CAST(c_custkey AS INT) AS if_index,
             CASE k WHEN 0 THEN 'if_name' WHEN 1 THEN 'if_descr' WHEN 2 THEN 'if_alias' WHEN 3 THEN 'high_speed'
                    WHEN 4 THEN 'speed' WHEN 5 THEN 'admin_status' WHEN 6 THEN 'oper_status' END AS attribute,
             CASE k WHEN 0 THEN 'port' || c_custkey WHEN 1 THEN c_mktsegment WHEN 2 THEN 'to ' || c_name
                    WHEN 3 THEN CAST((c_custkey % 3) * 1000 AS VARCHAR)
                    WHEN 4 THEN CAST(100000000 + c_custkey AS VARCHAR) WHEN 5 THEN 'up(1)'
                    WHEN 6 THEN CASE WHEN c_custkey % 5 = 0 THEN 'down(2)' ELSE '1' END END AS value
           FROM (SELECT *, '192.0.2.' || CAST(1 + c_custkey % 3 AS VARCHAR) AS exporter, c_custkey * 10 + k AS line_no
                 FROM (SELECT *, unnest(range(0, 8)) AS k FROM customer))
           WHERE k < 7 AND NOT (k = 2 AND c_custkey % 2 = 1)"""
    ),
)
