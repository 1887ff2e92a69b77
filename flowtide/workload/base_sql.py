"""DuckDB text of the tables every SQL twin starts from."""

from __future__ import annotations

from flowtide.catalogs import PROTOCOL_NAMES, SERVICE_NAMES
from flowtide.workload import adapter

META = ("src_as", "dst_as", "src_country", "dst_country", "sampling_rate", "tcp_flags", "flow_type")

_KNOWN = ", ".join(f"({p}, {port})" for p, port in SERVICE_NAMES)


def _duck(sql: str) -> str:
    return sql.replace("{S}", "VARCHAR").strip()


def known(port: str) -> str:
    return f"coalesce((proto, {port}) IN ({_KNOWN}), false)"


# The ten service rules as a list of (condition, rule number, side).
RULES = (
    ("sp = 0 AND dp = 0", 1, None),
    ("dp = 0", 2, "source"),
    ("sp = 0", 3, "destination"),
    ("ks AND NOT kd", 4, "source"),
    ("kd AND NOT ks", 5, "destination"),
    ("sp <= 1023 AND dp > 1023", 6, "source"),
    ("dp <= 1023 AND sp > 1023", 7, "destination"),
    ("sp < 32768 AND dp >= 32768", 8, "source"),
    ("dp < 32768 AND sp >= 32768", 9, "destination"),
)
_RULE_CASE = "CASE " + " ".join(f"WHEN {c} THEN {n}" for c, n, _ in RULES) + " ELSE 10 END"
_BY_SIDE = {
    side: ", ".join(str(n) for _, n, s in RULES if s == side) for side in ("source", "destination")
}

FLOWS = f"flows AS ({_duck(adapter.FLOWS_SQL)})"

KEYED = f"""
ruled AS (
  SELECT *, {_RULE_CASE} AS rule FROM (
    SELECT *, {known('sp')} AS ks, {known('dp')} AS kd FROM (
      SELECT *, coalesce(src_port, 0) AS sp, coalesce(dst_port, 0) AS dp FROM flows))),
keyed AS (
  SELECT *,
    CASE WHEN service_side = 'source' THEN sp WHEN service_side = 'destination' THEN dp END AS service_port,
    CASE WHEN rule = 1 OR service_side = 'destination' THEN NULL ELSE sp END AS key_src_port,
    CASE WHEN rule = 1 OR service_side = 'source' THEN NULL ELSE dp END AS key_dst_port,
    date_trunc('minute', received_at) AS minute,
    time_bucket(INTERVAL '5 minutes', received_at) AS bucket_start
  FROM (SELECT *, CASE WHEN rule IN ({_BY_SIDE['source']}) THEN 'source'
                       WHEN rule IN ({_BY_SIDE['destination']}) THEN 'destination' END AS service_side
        FROM ruled))"""

_PARTS = (
    "exporter", "src_addr", "dst_addr", "proto", "service_port", "service_side",
    "key_src_port", "key_dst_port", "in_if", "out_if",
)
CONV_KEY = "sha1(" + " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in _PARTS) + ")"

_LAST = ",\n    ".join(
    f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in META
)
CONV = f"""
conv AS (
  SELECT bucket_start, {CONV_KEY} AS conv_key,
    min(received_at) AS first_seen, max(received_at) AS last_seen, max(received_at) AS received_at,
    max(flow_time) AS flow_time, exporter, src_addr, dst_addr,
    CASE WHEN service_side = 'destination' THEN NULL
         ELSE coalesce(key_src_port, CASE WHEN bool_or(rule = 1) THEN arg_min(sp, seq) END) END AS src_port,
    CASE WHEN service_side = 'source' THEN NULL
         ELSE coalesce(key_dst_port, CASE WHEN bool_or(rule = 1) THEN arg_min(dp, seq) END) END AS dst_port,
    proto, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets,
    count(*) AS flow_count, in_if, out_if,
    {_LAST},
    service_port, service_side
  FROM keyed
  GROUP BY bucket_start, {', '.join(_PARTS)})"""

_SUMS = (
    "CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets"
)
STATS = f"""
stats AS (
  SELECT bucket_start, exporter, src_addr, dst_addr, proto,
    coalesce(service_port, 0) AS service_port, coalesce(service_side, '') AS service_side,
    coalesce(in_if, 0) AS in_if, coalesce(out_if, 0) AS out_if,
    {_SUMS}, count(*) AS flows
  FROM keyed
  WHERE exporter IS NOT NULL AND src_addr IS NOT NULL AND dst_addr IS NOT NULL AND proto IS NOT NULL
  GROUP BY ALL)"""


def _minute(name: str, keys: str, where: str = "true") -> str:
    columns = f"minute AS bucket{', ' + keys if keys else ''}"
    return f"""
{name} AS (SELECT {columns}, {_SUMS}, count(*) AS flows FROM keyed WHERE {where} GROUP BY ALL)"""


TOTAL = _minute("total_1m", "")
SRC = _minute("src_1m", "src_addr", "src_addr IS NOT NULL")
DST = _minute("dst_1m", "dst_addr", "dst_addr IS NOT NULL")
EXPORTER = _minute("exporter_1m", "exporter", "exporter IS NOT NULL")
APP = _minute(
    "app_1m", "proto, service_port AS port", "proto IS NOT NULL AND service_port IS NOT NULL"
)
INTERFACE = f"""
interface_1m AS (
  SELECT bucket, exporter, if_index, {_SUMS}, count(*) AS flows FROM (
    SELECT minute AS bucket, exporter, in_if AS if_index, bytes, packets FROM keyed
    WHERE exporter IS NOT NULL AND in_if IS NOT NULL
    UNION ALL
    SELECT minute, exporter, out_if, bytes, packets FROM keyed
    WHERE exporter IS NOT NULL AND out_if IS NOT NULL AND (in_if IS NULL OR in_if <> out_if))
  GROUP BY ALL)"""

AS_OF = """
clock AS (SELECT max(received_at) AS as_of FROM flows)"""

DIMS = f"""
exporters AS (
  SELECT x.*, TIMESTAMP '2024-01-01 00:00:00' AS first_seen,
    CASE WHEN ip = '192.0.2.3' THEN as_of - INTERVAL '10 minutes' ELSE as_of END AS last_seen
  FROM ({_duck(adapter.EXPORTERS_SQL)}) x, clock),
interfaces AS ({_duck(adapter.INTERFACES_SQL)}),
ip_names AS ({_duck(adapter.IP_NAMES_SQL)}),
dns_cache AS (
  SELECT ip, hostname, as_of - age_hours * INTERVAL '1 hour' AS resolved_at
  FROM ({_duck(adapter.DNS_CACHE_SQL)}), clock),
port_descriptions AS ({_duck(adapter.PORT_DESCRIPTIONS_SQL)}),
services(proto, port, service) AS (
  VALUES {', '.join(f"({p}, {port}, '{name}')" for (p, port), name in SERVICE_NAMES.items())}),
protocols(number, name) AS (
  VALUES {', '.join(f"({n}, '{name}')" for n, name in PROTOCOL_NAMES.items())})"""

BASE = ",".join(
    [FLOWS, KEYED, CONV, STATS, TOTAL, SRC, DST, EXPORTER, APP, INTERFACE, AS_OF, DIMS]
)


def query(body: str, *more: str) -> str:
    """A statement over all base tables (unused ones cost nothing)."""
    return "WITH " + ",\n".join([BASE, *more]) + "\n" + body.strip()


def protocol_name(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN 'Unknown' ELSE coalesce("
        f"(SELECT name FROM protocols WHERE number = {column}), 'IP/' || {column}) END"
    )


def interface_label(alias: str, fallback: str, bare: str) -> str:
    name = (
        f"coalesce(nullif({alias}.custom_name, ''), nullif({alias}.if_name, ''), "
        f"nullif({alias}.if_descr, '')"
    )
    return (
        f"CASE WHEN nullif({alias}.if_alias, '') IS NOT NULL "
        f"THEN {name}, {fallback}) || ' (' || {alias}.if_alias || ')' ELSE {name}, {bare}) END"
    )


DEVICE = "coalesce(nullif(e.custom_name, ''), nullif(e.hostname, ''))"
INET_KEY = (
    "CASE WHEN {c} LIKE '%:%' THEN '6' || {c} ELSE '4' || array_to_string("
    "list_transform(string_split({c}, '.'), lambda o: lpad(o, 3, '0')), '') END"
)


def inet_key(column: str) -> str:
    return INET_KEY.replace("{c}", column)
