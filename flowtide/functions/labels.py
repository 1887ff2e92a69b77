"""Display labels of devices and interfaces, and substring matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def filled(text: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(text, F.lit(""))


def device_name(custom_name: Column, hostname: Column) -> Column:
    return F.coalesce(filled(custom_name), filled(hostname))


def device_label(custom_name: Column, hostname: Column, ip: Column) -> Column:
    """``name (ip)``, or the address alone."""
    name = device_name(custom_name, hostname)
    return F.coalesce(F.concat(name, F.lit(" ("), ip, F.lit(")")), ip)


def display_name(custom_name: Column, hostname: Column, ip: Column) -> Column:
    return F.coalesce(device_name(custom_name, hostname), ip)


def if_index_text(if_index: Column, missing: str | None = None) -> Column:
    """``ifIndex 7``; for an unknown index NULL, or ``ifIndex <missing>``."""
    text = if_index.cast("string")
    return F.concat(F.lit("ifIndex "), F.coalesce(text, F.lit(missing)) if missing else text)


def interface_label(
    custom_name: Column,
    if_name: Column,
    if_descr: Column,
    if_alias: Column,
    fallback: Column,
    bare_fallback: Column | None = None,
) -> Column:
    """``name (alias)`` with an alias, otherwise the name.

    ``fallback`` names an interface that has an alias only; ``bare_fallback``
    one that has nothing (the same text unless given).
    """
    name = F.coalesce(filled(custom_name), filled(if_name), filled(if_descr))
    bare = fallback if bare_fallback is None else bare_fallback
    alias = filled(if_alias)
    return F.when(
        alias.isNotNull(),
        F.concat(F.coalesce(name, fallback), F.lit(" ("), alias, F.lit(")")),
    ).otherwise(F.coalesce(name, bare))


def contains_pattern(text: str) -> str:
    """LIKE pattern for "contains". ``%`` and ``_`` stay wildcards; a backslash
    before any other character stands for that character."""
    return "%" + re.sub(r"\\([^%_\\])", r"\1", text) + "%"


def contains_text(column: Column, text: str) -> Column:
    return column.ilike(contains_pattern(text))
