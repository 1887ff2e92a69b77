"""Sorts with spelled-out null order, top-k and paging.

An ORDER BY in this library always ends in a limit (or sorts a small report),
so Spark plans it as ``TakeOrderedAndProject``: each task keeps its best rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.ip import inet_sort_key
from flowtide.functions.labels import display_name

FLOW_SORTS = {
    "received_at": lambda: F.col("received_at"),
    "exporter": lambda: display_name(
        F.col("exporter_custom_name"), F.col("exporter_host"), F.col("exporter")
    ),
    "src": lambda: inet_sort_key(F.col("src_addr")),
    "dst": lambda: inet_sort_key(F.col("dst_addr")),
    "proto": lambda: F.col("proto"),
    "in_if": lambda: F.col("in_if"),
    "out_if": lambda: F.col("out_if"),
    "bytes": lambda: F.col("bytes"),
    "packets": lambda: F.col("packets"),
}
STATS_SORTS = {
    **FLOW_SORTS,
    "received_at": lambda: F.col("bucket_start"),
    "exporter": lambda: F.coalesce(F.col("exporter_host"), F.col("exporter")),
}
SUMMARY_SORTS = {
    "src": "src_addr", "dst": "dst_addr", "peer": "peer_addr", "proto": "proto",
    "port": "port", "bytes": "bytes", "packets": "packets", "flows": "flows",
}


def is_ascending(order: str | None) -> bool:
    return str(order).lower() == "asc"


def database_order(column: Column, ascending: bool) -> Column:
    """NULL is the largest value: last when ascending, first when descending."""
    return column.asc_nulls_last() if ascending else column.desc_nulls_first()


def nulls_last(column: Column, ascending: bool) -> Column:
    return column.asc_nulls_last() if ascending else column.desc_nulls_last()


def sort_key(sorts: dict, sort: str | None) -> str:
    """A known sort name; anything else falls back to the arrival time."""
    return sort if sort in sorts else "received_at"


def page(rows: DataFrame, ordering: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of ``limit`` rows, however many; deep pages should seek with ``after``."""
    ordered = rows.orderBy(*ordering)
    if offset and offset > 0:
        ordered = ordered.offset(offset)
    return ordered.limit(max(int(limit), 0))


def top(rows: DataFrame, ordering: list[Column], limit: int) -> DataFrame:
    return rows.orderBy(*ordering).limit(max(int(limit), 0))


def after(rows: DataFrame, order: list[tuple[Column, bool, bool]], last: list) -> DataFrame:
    """Rows following a known row, for deep paging.

    ``order`` lists (column, ascending, nulls last) down to a key that no two
    rows share; ``last`` holds the known row's values. Seeking past a row costs
    a filter, where an offset would make every task keep all rows before it.
    """
    beyond, same = F.lit(False), F.lit(True)
    for (column, ascending, nulls_at_end), value in zip(order, last, strict=True):
        if value is None:
            further = F.lit(False) if nulls_at_end else column.isNotNull()
            equal = column.isNull()
        else:
            value = F.lit(value)
            further = F.coalesce(column > value if ascending else column < value, F.lit(False))
            if nulls_at_end:
                further |= column.isNull()
            equal = F.coalesce(column == value, F.lit(False))
        beyond, same = beyond | (same & further), same & equal
    return rows.filter(beyond)
