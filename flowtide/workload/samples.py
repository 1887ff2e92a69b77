"""Inputs of the scalar functions, spelled in many ways, derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.workload.adapter import Inputs, _run

# Address text per event: plain, with suffix, padded, empty, all-zero marker,
# long IPv6, a host name, link-local IPv6 with suffix.
ADDRESS_SQL = """
SELECT event_id,
  CASE event_id % 8
    WHEN 0 THEN '10.' || CAST(event_id % 256 AS {S}) || '.' || CAST(event_id % 199 AS {S}) || '.7'
    WHEN 1 THEN '172.16.' || CAST(event_id % 256 AS {S}) || '.9/32'
    WHEN 2 THEN '  192.168.' || CAST(event_id % 256 AS {S}) || '.1 '
    WHEN 3 THEN ''
    WHEN 4 THEN 'AAAAAA=='
    WHEN 5 THEN '2001:DB8:0:0:0:00:0:' || hex(event_id % 65536)
    WHEN 6 THEN 'host-' || CAST(event_id AS {S})
    ELSE 'FE80:0::' || hex(1 + event_id % 60000) || ':0:0/64' END AS v
FROM events
"""

PROTO_SQL = """
SELECT event_id,
  CASE event_id % 12
    WHEN 0 THEN 'TCP' WHEN 1 THEN ' udp ' WHEN 2 THEN 'IPv6_ICMP' WHEN 3 THEN 'ipv6-route'
    WHEN 4 THEN CAST(event_id % 256 AS {S}) WHEN 5 THEN '' WHEN 6 THEN 'HOPOPT'
    WHEN 7 THEN 'Sctp' WHEN 8 THEN 'ICMPv6' WHEN 9 THEN '6.9' WHEN 10 THEN 'IPv6-Frag'
    ELSE 'gre' END AS v,
  CAST(event_id % 256 AS INT) AS number
FROM events
"""

# JSON records whose number comes as every kind of token.
NUMBER_SQL = """
SELECT event_id,
  CASE event_id % 8
    WHEN 0 THEN '{"f": ' || CAST(event_id AS {S}) || '}'
    WHEN 1 THEN '{"f": ' || CAST(event_id AS {S}) || '.9}'
    WHEN 2 THEN '{"f": "' || CAST(event_id AS {S}) || '"}'
    WHEN 3 THEN '{"f": "' || CAST(event_id AS {S}) || '.9"}'
    WHEN 4 THEN '{"f": true}'
    WHEN 5 THEN '{"f": null}'
    WHEN 6 THEN '{"g": ' || CAST(event_id AS {S}) || '}'
    ELSE '{"f": " ' || CAST(event_id AS {S}) || ' "}' END AS line
FROM events
"""

TIME_SQL = """
SELECT event_id,
  CASE event_id % 6
    WHEN 0 THEN '{"time_flow_start_ns": ' || CAST(1700000000123456789 + event_id AS {S}) || '}'
    WHEN 1 THEN '{"time_flow_start_ns": 0, "time_received_ns": ' || CAST(1700000000000000000 + event_id * 1000 AS {S}) || '}'
    WHEN 2 THEN '{"time_received_ns": "' || CAST(1600000000000000000 + event_id * 1000 AS {S}) || '"}'
    WHEN 3 THEN '{"time_flow_start_ns": -5, "time_received_ns": 1700000000000000000}'
    WHEN 4 THEN '{"time_flow_start_ns": "x", "time_received_ns": 1700000000000000000}'
    ELSE '{"time_flow_start_ns": "", "time_received_ns": ' || CAST(1500000000000000000 + event_id * 1000 AS {S}) || '}' END AS line
FROM events
"""

APP_SQL = """
SELECT event_id,
  CAST(CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 17 WHEN 3 THEN 43 END AS INT) AS proto,
  CAST(CASE WHEN event_id % 31 = 0 THEN NULL ELSE (event_id * 3) % 5100 END AS INT) AS port
FROM events
"""

GLOBAL_SQL = """
SELECT event_id,
  CAST((event_id * 37) % 256 AS {S}) || '.' || CAST((event_id * 101) % 256 AS {S}) || '.' ||
  CAST((event_id * 7) % 256 AS {S}) || '.' || CAST(event_id % 256 AS {S}) AS ip
FROM events
"""

DEVICE_SQL = """
SELECT s_suppkey, '10.1.' || CAST(floor(s_suppkey / 250) % 250 AS INT) || '.' || CAST(s_suppkey % 250 AS {S}) AS ip,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS hostname,
  CASE WHEN s_suppkey % 4 = 0 THEN 'custom-' || CAST(s_suppkey AS {S}) WHEN s_suppkey % 4 = 1 THEN '' END AS custom_name
FROM supplier
"""

PORT_TABLE_SQL = """
SELECT c_custkey,
  CAST(CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey END AS INT) AS if_index,
  CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN NULL ELSE 'ether' || CAST(c_custkey AS {S}) END AS if_name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_name END AS if_descr,
  CASE WHEN c_custkey % 5 = 0 THEN 'uplink' WHEN c_custkey % 5 = 1 THEN '' END AS if_alias,
  CASE WHEN c_custkey % 7 = 0 THEN 'port-' || CAST(c_custkey AS {S}) END AS custom_name
FROM customer
"""

# Walk output of one attribute per line; every supplier is a device.
WALK_SQL = """
SELECT '192.0.2.' || CAST(1 + c_custkey % 3 AS {S}) AS exporter, c_custkey * 10 + k AS line_no,
  CASE k
    WHEN 0 THEN '.1.3.6.1.2.1.31.1.1.1.1.' || i || ' = STRING: "port' || i || '"'
    WHEN 1 THEN '.1.3.6.1.2.1.2.2.1.2.' || i || ' = STRING: ' || c_mktsegment
    WHEN 2 THEN CASE WHEN c_custkey % 2 = 0 THEN '.1.3.6.1.2.1.31.1.1.1.18.' || i || ' = STRING: "to ' || c_name || '"'
                     ELSE 'Timeout: No Response' END
    WHEN 3 THEN '.1.3.6.1.2.1.31.1.1.1.15.' || i || ' = Gauge32: ' || CAST((c_custkey % 3) * 1000 AS {S})
    WHEN 4 THEN '1.3.6.1.2.1.2.2.1.5.' || i || ' = Gauge32: ' || CAST(100000000 + c_custkey AS {S})
    WHEN 5 THEN '.1.3.6.1.2.1.2.2.1.7.' || i || ' = INTEGER: up(1)'
    WHEN 6 THEN '.1.3.6.1.2.1.2.2.1.8.' || i || ' = INTEGER: ' || CASE WHEN c_custkey % 5 = 0 THEN 'down(2)' ELSE '1' END
    ELSE '.1.3.6.1.2.1.1.5.0 = STRING: "sysname"' END AS line
FROM (SELECT *, CAST(c_custkey AS {S}) AS i, {K} AS k FROM customer) c
"""


def rows(inputs: Inputs, sql: str) -> DataFrame:
    for name in ("events", "supplier", "customer"):
        if f"FROM {name}" in sql:
            # Braces of the JSON texts are not parameters of the statement.
            view = inputs.table(name)
            text = sql.replace("{S}", "STRING").replace("{K}", "explode(sequence(0, 7))")
            text = text.replace("{", "{{").replace("}", "}}") if '{"' in text else text
            return _run(inputs.spark, text, **{name: view})
    raise ValueError("unknown table")


def json_lines(flows: DataFrame) -> DataFrame:
    """Flow rows as collector lines in all accepted spellings, plus lines to reject."""
    seq = F.col("seq")

    def either(first: Column, second: Column) -> Column:
        return F.when(seq % 2 == 0, first).otherwise(second)

    def quoted(text: Column) -> Column:
        return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))

    def number(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(either(text, quoted(text)), F.lit("null"))

    proto_text = F.when(F.col("proto") == 6, "TCP").when(F.col("proto") == 17, "udp").otherwise("Icmp")
    proto = F.when(seq % 3 == 0, quoted(proto_text)).otherwise(number("proto"))
    exporter = F.coalesce(
        F.concat("exporter", either(F.lit(""), F.lit("/32"))), either(F.lit(""), F.lit("AAAAAA=="))
    )
    source = F.when(F.col("src_addr") == "2001:db8::1", F.lit("2001:DB8:0:0::1")).otherwise(
        F.col("src_addr")
    )
    nanos = (F.unix_micros("flow_time") * 1000).cast("string")
    fields = {
        "type": quoted(F.col("flow_type")),
        "time_flow_start_ns": either(nanos, F.lit("0")),
        "time_received_ns": nanos,
        "sampler_address": quoted(exporter),
        "src_addr": quoted(source),
        "dst_addr": quoted(F.col("dst_addr")),
        "proto": proto,
        "src_country": quoted(F.col("src_country")),
        "dst_country": quoted(F.col("dst_country")),
        **{
            name: number(name)
            for name in (
                "src_port", "dst_port", "bytes", "packets", "in_if", "out_if", "src_as",
                "dst_as", "sampling_rate", "tcp_flags",
            )
        },
    }
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()]
    good = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    text = seq.cast("string")
    rejected = (
        F.when(seq % 50 == 0, F.concat(F.lit('{"half":'), text))
        .when(seq % 50 == 1, F.concat(F.lit("["), text, F.lit("]")))
        .when(seq % 50 == 2, F.lit("null"))
        .when(seq % 50 == 3, text)
        .when(seq % 50 == 4, F.concat(F.lit('{"src_addr":"host-'), text, F.lit('"}')))
    )
    return flows.select(F.explode(F.array_compact(F.array(good, rejected))).alias("value"))
