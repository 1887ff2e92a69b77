"""Declared schemas. Nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# One row per received flow. ``seq`` is the arrival number: among rows that are
# aggregated together it rises with ``received_at``.
FLOWS = _schema(
    ("seq", _L), ("received_at", _TS), ("flow_time", _TS), ("exporter", _S), ("flow_type", _S),
    ("src_addr", _S), ("dst_addr", _S), ("src_port", _I), ("dst_port", _I), ("proto", _I),
    ("bytes", _L), ("packets", _L), ("in_if", _I), ("out_if", _I), ("src_as", _L), ("dst_as", _L),
    ("src_country", _S), ("dst_country", _S), ("sampling_rate", _I), ("tcp_flags", _I),
)

CONVERSATIONS = _schema(
    ("bucket_start", _TS), ("conv_key", _S), ("first_seen", _TS), ("last_seen", _TS),
    ("received_at", _TS), ("flow_time", _TS), ("exporter", _S), ("flow_type", _S),
    ("src_addr", _S), ("dst_addr", _S), ("src_port", _I), ("dst_port", _I), ("proto", _I),
    ("bytes", _L), ("packets", _L), ("flow_count", _L), ("in_if", _I), ("out_if", _I),
    ("src_as", _L), ("dst_as", _L), ("src_country", _S), ("dst_country", _S),
    ("sampling_rate", _I), ("tcp_flags", _I), ("service_port", _I), ("service_side", _S),
)

META_TYPES = {
    "flow_type": _S, "src_country": _S, "dst_country": _S,
    "src_as": _L, "dst_as": _L, "sampling_rate": _I, "tcp_flags": _I,
}


def _stamped(value: T.DataType) -> T.StructType:
    return _schema(("received_at", _TS), ("seq", _L), ("value", value))


# What the conversation table stores: rows that can still be merged. Every
# "last value wins" column keeps the arrival stamp it was seen at; ``slot`` is
# the finer bucket the row was condensed to.
CONVERSATION_PARTIALS = _schema(
    ("bucket_start", _TS), ("slot", _TS), ("exporter", _S), ("src_addr", _S), ("dst_addr", _S), ("proto", _I),
    ("service_port", _I), ("service_side", _S), ("key_src_port", _I), ("key_dst_port", _I),
    ("in_if", _I), ("out_if", _I), ("first_seen", _TS), ("last_seen", _TS), ("flow_time", _TS),
    ("bytes", _L), ("packets", _L), ("flow_count", _L), ("zero_ports", _stamped(_I)),
    *((f"last_{name}", _stamped(dtype)) for name, dtype in META_TYPES.items()),
)

STATISTICS = _schema(
    ("bucket_start", _TS), ("exporter", _S), ("src_addr", _S), ("dst_addr", _S), ("proto", _I),
    ("service_port", _I), ("service_side", _S), ("in_if", _I), ("out_if", _I),
    ("bytes", _L), ("packets", _L), ("flows", _L),
)

ROLLUP_KEYS = {
    "total_1m": (),
    "src_1m": (("src_addr", _S),),
    "dst_1m": (("dst_addr", _S),),
    "exporter_1m": (("exporter", _S),),
    "app_1m": (("proto", _I), ("port", _I)),
    "interface_1m": (("exporter", _S), ("if_index", _I)),
}
ROLLUPS = {
    name: _schema(("bucket", _TS), *keys, ("bytes", _L), ("packets", _L), ("flows", _L))
    for name, keys in ROLLUP_KEYS.items()
}

# Distinct exporters and hosts of a minute as sketches that can be united.
SKETCHES = _schema(("bucket", _TS), ("exporters", T.BinaryType()), ("sources", T.BinaryType()), ("destinations", T.BinaryType()))
SKETCHED = {"exporters": ("exporter_1m", "exporter"), "sources": ("src_1m", "src_addr"), "destinations": ("dst_1m", "dst_addr")}

BATCH_LOG = _schema(("type", _S), ("count", _L), ("ts", _TS))
STREAM_PROGRESS = _schema(("ts", _TS), ("rows", _L), ("rows_per_second", T.DoubleType()), ("batch_ms", _L), ("behind_bytes", _L))
QUARANTINE = _schema(("value", _S), ("reason", _S), ("received_at", _TS))

EXPORTERS = _schema(
    ("ip", _S), ("first_seen", _TS), ("last_seen", _TS), ("hostname", _S), ("custom_name", _S),
    ("sys_descr", _S),
)
INTERFACES = _schema(
    ("exporter", _S), ("if_index", _I), ("if_name", _S), ("if_descr", _S), ("if_alias", _S),
    ("custom_name", _S), ("if_speed", _L), ("admin_status", _I), ("oper_status", _I),
    ("updated_at", _TS),
)
IP_NAMES = _schema(("ip", _S), ("name", _S))
DNS_CACHE = _schema(("ip", _S), ("hostname", _S), ("resolved_at", _TS))
PORT_DESCRIPTIONS = _schema(("proto", _I), ("port", _I), ("description", _S))
