"""Lines of a captured interface walk: ``.1.3.6... = TYPE: value``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide.functions.ip import strip

_LINE = r"^\.?([0-9]+(?:\.[0-9]+)*)\s*=\s*(.*)$"


def scalar(text: Column) -> Column:
    """Value without an ``oid =`` prefix, type tag and surrounding quotes.

    Tags such as ``Gauge32:`` count as tags too; left in place, their digits
    would be read as the value.
    """
    value = F.when(text.contains(" = "), F.regexp_replace(text, r"(?s)^.*? = ", "")).otherwise(text)
    untagged = F.regexp_replace(strip(value), r"^[A-Za-z][A-Za-z0-9-]*:\s*", "")
    return strip(F.regexp_replace(untagged, r'(?s)^"(?:(.*)")?$', "$1"))


def line_parts(line: Column) -> Column:
    """Struct (oid, index, value); NULL when the line is no ``oid = value``."""
    bare = strip(line)
    oid = F.regexp_extract(bare, _LINE, 1)
    return F.when(
        bare.rlike(_LINE),
        F.struct(
            oid.alias("oid"),
            F.substring_index(oid, ".", -1).try_cast("int").alias("index"),
            scalar(F.regexp_extract(bare, _LINE, 2)).alias("value"),
        ),
    )


def first_integer(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(-?[0-9]+)", 1), F.lit("")).try_cast("long")


def speed(high_mbps: Column, plain: Column) -> Column:
    """Bits per second; the high-capacity counter wins when it is positive."""
    high = first_integer(high_mbps)
    return F.when(high > 0, high * 1_000_000).otherwise(first_integer(plain))
