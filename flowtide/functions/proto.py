"""Protocol numbers, protocol names and application labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide.catalogs import PROTOCOL_NAMES, PROTOCOL_SPELLINGS, SERVICE_NAMES
from flowtide.functions.ip import strip


def _literal_map(entries: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(entries.items())))


def spelled_protocol(text: Column) -> Column:
    """Number of a known spelling."""
    name = F.translate(F.upper(strip(text)), "_", "-")
    return F.try_element_at(_literal_map(PROTOCOL_SPELLINGS), name)


def protocol_from_text(text: Column) -> Column:
    """Number for decimal text or a known spelling; anything else is NULL."""
    return F.coalesce(spelled_protocol(text), strip(text).try_cast("int"))


def protocol_name(proto: Column) -> Column:
    return (
        F.when(proto.isNull(), F.lit("Unknown"))
        .otherwise(
            F.coalesce(
                F.try_element_at(_literal_map(PROTOCOL_NAMES), proto.cast("int")),
                F.concat(F.lit("IP/"), proto.cast("string")),
            )
        )
    )


# One number per (protocol, port), for set membership and map lookup.
PAIR_BASE = 1 << 32
SERVICE_CODES = [proto * PAIR_BASE + port for proto, port in SERVICE_NAMES]


def service_name(proto: Column, port: Column) -> Column:
    names = _literal_map(dict(zip(SERVICE_CODES, SERVICE_NAMES.values())))
    return F.try_element_at(names, proto.cast("long") * PAIR_BASE + port.cast("long"))


def app_name(proto: Column, port: Column) -> Column:
    """``HTTPS · TCP/443``, ``TCP/9200`` or ``Other · ICMP``."""
    kind = protocol_name(proto)
    short = F.concat(kind, F.lit("/"), port.cast("string"))
    known = service_name(proto, port)
    return (
        F.when(F.coalesce(port, F.lit(0)) == 0, F.concat(F.lit("Other · "), kind))
        .when(known.isNotNull(), F.concat(known, F.lit(" · "), short))
        .otherwise(short)
    )


def custom_label(description: Column, proto: Column, port: Column) -> Column:
    """``Proxmox TCP/8006`` for a described port."""
    return F.concat(
        description, F.lit(" "), protocol_name(proto), F.lit("/"), port.cast("string")
    )


def service_label(description: Column, proto: Column, port: Column) -> Column:
    """A custom description beats the built-in name."""
    return F.when(
        F.nullif(description, F.lit("")).isNotNull(), custom_label(description, proto, port)
    ).otherwise(app_name(proto, port))
