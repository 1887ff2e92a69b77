"""Which end of a flow is the service, and the key a conversation merges on.

These are SQL texts over column names: one parsed expression each, shared by
every caller that has the flow columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide.catalogs import EPHEMERAL_MIN, WELL_KNOWN_MAX
from flowtide.functions.proto import PAIR_BASE, SERVICE_CODES

_CODES = ", ".join(f"{code}L" for code in SERVICE_CODES)


def _known(proto: str, port: str) -> str:
    return f"coalesce(bigint({proto}) * {PAIR_BASE}L + {port} IN ({_CODES}), false)"


def service_side(src_port: str = "src_port", dst_port: str = "dst_port", proto: str = "proto") -> Column:
    """``source``, ``destination`` or NULL when no end stands out.

    In order of trust: the only port present, the only catalogued port, the
    only well-known port, the only port below the ephemeral range.
    """
    sp, dp = f"coalesce({src_port}, 0)", f"coalesce({dst_port}, 0)"
    known_s, known_d = _known(proto, sp), _known(proto, dp)
    return F.expr(
        f"""CASE
        WHEN {sp} = 0 AND {dp} = 0 THEN NULL
        WHEN {dp} = 0 THEN 'source'
        WHEN {sp} = 0 THEN 'destination'
        WHEN {known_s} AND NOT {known_d} THEN 'source'
        WHEN {known_d} AND NOT {known_s} THEN 'destination'
        WHEN {sp} <= {WELL_KNOWN_MAX} AND {dp} > {WELL_KNOWN_MAX} THEN 'source'
        WHEN {dp} <= {WELL_KNOWN_MAX} AND {sp} > {WELL_KNOWN_MAX} THEN 'destination'
        WHEN {sp} < {EPHEMERAL_MIN} AND {dp} >= {EPHEMERAL_MIN} THEN 'source'
        WHEN {dp} < {EPHEMERAL_MIN} AND {sp} >= {EPHEMERAL_MIN} THEN 'destination'
        END"""
    )


# Given ``service_side``: the service port, and each port as far as it belongs
# to the key, that is neither a client port nor 0.
FROM_SIDE = {
    "service_port": "CASE service_side WHEN 'source' THEN src_port WHEN 'destination' THEN dst_port END",
    "key_src_port": "CASE WHEN NOT service_side <=> 'destination' THEN nullif(src_port, 0) END",
    "key_dst_port": "CASE WHEN NOT service_side <=> 'source' THEN nullif(dst_port, 0) END",
}

KEY_PARTS = (
    "exporter", "src_addr", "dst_addr", "proto", "service_port", "service_side",
    "key_src_port", "key_dst_port", "in_if", "out_if",
)


def conversation_key() -> Column:
    """SHA-1 of the ten key parts; a missing part keeps its (empty) slot."""
    parts = ", ".join(f"string({name})" for name in KEY_PARTS)
    return F.expr(f"sha1(binary(array_join(array({parts}), '|', '')))")
