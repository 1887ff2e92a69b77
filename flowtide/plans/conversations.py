"""Who talks to whom: by address pair, or by input and output interface."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions import labels
from flowtide.functions.ip import inet_sort_key
from flowtide.operators import enrich, ordering
from flowtide.operators.filters import FlowFilter
from flowtide.plans.flows import count_groups, summable

PAIR = ["src_addr", "dst_addr"]
PATH = ["exporter", "in_if", "out_if"]


def group_keys(group_by: str) -> list[str]:
    return PATH if group_by == "interface" else PAIR


def pair_order() -> list[Column]:
    return [
        F.desc("bytes"),
        inet_sort_key(F.col("src_addr")).asc_nulls_last(),
        inet_sort_key(F.col("dst_addr")).asc_nulls_last(),
    ]


def path_order() -> list[Column]:
    return [F.desc("bytes"), *(F.col(c).asc_nulls_last() for c in PATH)]


def by_ip(
    tables, flt: FlowFilter, as_of: datetime | None = None, limit: int = 10, offset: int = 0
) -> DataFrame:
    sums = summable(tables, flt, as_of).groupBy(*PAIR).agg(
        F.sum("bytes").cast("long").alias("bytes"),
        F.sum("packets").cast("long").alias("packets"),
        F.sum("flow_count").cast("long").alias("flows"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return ordering.page(sums, pair_order(), limit, offset)


def present_paths(page: DataFrame, tables, absent: int | None, missing: str | None) -> DataFrame:
    """Adds device and interface labels to a page of interface paths."""
    named = enrich.with_exporter(page, tables.exporters)
    named = enrich.with_both_interfaces(named, tables.interfaces, absent)

    def index(name: str) -> Column:
        return F.col(name) if absent is None else F.nullif(F.col(name), F.lit(absent))

    return named.select(
        "exporter",
        index("in_if").alias("in_if"),
        index("out_if").alias("out_if"),
        enrich.interface_label("inside", labels.if_index_text(index("in_if"), missing)).alias(
            "in_if_name"
        ),
        enrich.interface_label("outside", labels.if_index_text(index("out_if"), missing)).alias(
            "out_if_name"
        ),
        labels.display_name(
            F.col("exporter_custom_name"), F.col("exporter_host"), F.col("exporter")
        ).alias("device_name"),
        "bytes", "packets", "flows", "last_seen",
    ).orderBy(*path_order())


def by_interface(
    tables, flt: FlowFilter, as_of: datetime | None = None, limit: int = 10, offset: int = 0
) -> DataFrame:
    # The labels depend on the grouping keys alone, so they are joined last.
    sums = summable(tables, flt, as_of).groupBy(*PATH).agg(
        F.sum("bytes").cast("long").alias("bytes"),
        F.sum("packets").cast("long").alias("packets"),
        F.sum("flow_count").cast("long").alias("flows"),
        F.max("last_seen").alias("last_seen"),
    )
    page = ordering.page(sums, path_order(), limit, offset)
    return present_paths(page, tables, None, labels.DASH)


def count(
    tables, flt: FlowFilter, as_of: datetime | None = None, group_by: str = "ip"
) -> DataFrame:
    return count_groups(summable(tables, flt, as_of), group_keys(group_by))
