"""Flows -> five-minute service conversations, as mergeable partial rows.

Two steps. ``condense`` groups flows on the conversation key *plus* the text
metadata: with the texts in the key, every aggregation buffer has a fixed
width, so Spark keeps to hash aggregation and combines on the map side before
anything is shuffled; one key holding a third of all flows reaches the shuffle
as a handful of rows per task. ``merge`` folds these far fewer rows (or rows
stored by earlier batches) into one per conversation; "last value wins" is a
``max`` over (arrival stamp, value) there, so any grouping of the input into
batches gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions import buckets, service
from flowtide.schemas import CONVERSATION_PARTIALS, CONVERSATIONS, META_TYPES

# The two key ports imply the service port and side, so these need no grouping.
DIMS = [
    "exporter", "src_addr", "dst_addr", "proto", "key_src_port", "key_dst_port", "in_if", "out_if",
]
KEY = ["bucket_start", *DIMS]
TEXT_META = [name for name, dtype in META_TYPES.items() if dtype.typeName() == "string"]
NUMBER_META = [name for name in META_TYPES if name not in TEXT_META]


def with_service(flows: DataFrame) -> DataFrame:
    """Flows plus service_port, service_side and the two key ports."""
    return flows.withColumn("service_side", service.service_side()).withColumns(
        {name: F.expr(text) for name, text in service.FROM_SIDE.items()}
    )


# The service columns regained from the key ports: one port is the service,
# two are an ambiguous pair.
_IMPLIED = {
    "service_port": """CASE WHEN key_dst_port IS NULL THEN key_src_port
                            WHEN key_src_port IS NULL THEN key_dst_port END""",
    "service_side": """CASE WHEN key_src_port IS NOT NULL AND key_dst_port IS NULL THEN 'source'
                            WHEN key_dst_port IS NOT NULL AND key_src_port IS NULL THEN 'destination' END""",
}

# 0 and NULL ports share a key; the code tells which the first flow carried.
_ZERO_CODE = """
CASE WHEN key_src_port IS NULL AND key_dst_port IS NULL
     THEN if(src_port IS NOT NULL, 1, 0) + if(dst_port IS NOT NULL, 2, 0) END"""


def _stamp(received_at: str, seq: str, value: str) -> str:
    return (
        f"if({value} IS NOT NULL, named_struct("
        f"'received_at', {received_at}, 'seq', {seq}, 'value', {value}), NULL)"
    )


def condense(flows: DataFrame, grain=buckets.five_minutes, arrival_lane: bool = False) -> DataFrame:
    """Partial conversation rows of one batch of flows.

    ``grain`` is the bucket the rows are condensed to; it must divide five
    minutes. ``arrival_lane`` adds ``received_at`` to the grouping, for inputs
    where it names the file a row landed in and ``seq`` only counts within one.
    """
    rows = with_service(flows).withColumns(
        {"slot": grain(F.col("received_at")), "zero_code": F.expr(_ZERO_CODE)}
    )
    lane = ["received_at"] if arrival_lane else []
    numbers = [
        text
        for name in NUMBER_META
        for text in (
            f"max_by({name}, if({name} IS NOT NULL, seq, NULL)) AS {name}",
            f"max(if({name} IS NOT NULL, seq, NULL)) AS {name}_seq",
            f"max(if({name} IS NOT NULL, received_at, NULL)) AS {name}_at",
        )
    ]
    measures = [
        "min(received_at) AS first_seen",
        "max(received_at) AS last_seen",
        "max(flow_time) AS flow_time",
        "sum(bytes) AS bytes",
        "sum(packets) AS packets",
        "count(1) AS flow_count",
        "min(seq) AS first_seq",
        "max(seq) AS last_seq",
        "min_by(zero_code, seq) AS zero_code",
    ]
    grouped = rows.groupBy("slot", *DIMS, *TEXT_META, *lane).agg(
        *(F.expr(text) for text in measures + numbers)
    )
    stamps = {"zero_ports": _stamp("first_seen", "first_seq", "zero_code")}
    for name in TEXT_META:
        stamps[f"last_{name}"] = _stamp("last_seen", "last_seq", name)
    for name in NUMBER_META:
        stamps[f"last_{name}"] = _stamp(f"{name}_at", f"{name}_seq", name)
    stamps |= {"bucket_start": buckets.five_minutes_sql("slot"), **_IMPLIED}
    return grouped.selectExpr(
        *(f"CAST({stamps.get(f.name, f.name)} AS {f.dataType.simpleString()}) AS {f.name}"
          for f in CONVERSATION_PARTIALS),
    )


def merge(partials: DataFrame) -> DataFrame:
    """One partial row per conversation, whatever batches they came from."""
    measures = [
        "min(slot) AS slot",
        "min(first_seen) AS first_seen",
        "max(last_seen) AS last_seen",
        "max(flow_time) AS flow_time",
        "sum(bytes) AS bytes",
        "sum(packets) AS packets",
        "sum(flow_count) AS flow_count",
        "min(zero_ports) AS zero_ports",
        *(f"max(last_{name}) AS last_{name}" for name in META_TYPES),
    ]
    merged = partials.groupBy(*KEY).agg(*(F.expr(text) for text in measures))
    return merged.selectExpr(
        *(f"{_IMPLIED.get(n, n)} AS {n}" for n in CONVERSATION_PARTIALS.names)
    )


_FINISHED = {
    "received_at": "last_seen",
    "src_port": "coalesce(key_src_port, if(zero_ports.value & 1 > 0, 0, NULL))",
    "dst_port": "coalesce(key_dst_port, if(zero_ports.value & 2 > 0, 0, NULL))",
    **{name: f"last_{name}.value" for name in META_TYPES},
}


def finish(merged: DataFrame) -> DataFrame:
    """Merged partial rows -> conversation rows."""
    return merged.withColumn("conv_key", service.conversation_key()).selectExpr(
        *(f"CAST({_FINISHED.get(f.name, f.name)} AS {f.dataType.simpleString()}) AS {f.name}"
          for f in CONVERSATIONS)
    )


def conversations_5m(flows: DataFrame, arrival_lane: bool = False) -> DataFrame:
    return finish(merge(condense(flows, arrival_lane=arrival_lane)))
