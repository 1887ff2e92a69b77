"""The same questions asked of the compact five-minute statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.operators import enrich, ordering
from flowtide.operators.filters import BUCKET, FlowFilter, filter_statistics
from flowtide.plans import conversations, flows

LISTING = [
    "received_at", "first_seen", "last_seen", "flow_count", "exporter", "exporter_hostname",
    "flow_type", "src_addr", "dst_addr", "src_port", "dst_port", "proto", "bytes", "packets",
    "in_if", "out_if", "service_port", "service_side", "in_if_name", "out_if_name",
]
KEY_ORDER = ["bucket_start", "exporter", "src_addr", "dst_addr", "proto", "service_port",
             "service_side", "in_if", "out_if"]


def selected(tables, flt: FlowFilter) -> DataFrame:
    high = flt.date_to + BUCKET if flt.date_to else None
    return filter_statistics(tables.statistics(flt.date_from, high), flt)


def summable(tables, flt: FlowFilter) -> DataFrame:
    """``selected`` for readers that sum it: keys need not be merged first."""
    high = flt.date_to + BUCKET if flt.date_to else None
    return filter_statistics(tables.statistics_parts(flt.date_from, high), flt)


def bucket_end() -> Column:
    return F.col("bucket_start") + F.expr("INTERVAL '5' MINUTE")


def listing(
    tables, flt: FlowFilter, sort: str | None = None, order: str | None = None,
    limit: int = 10, offset: int = 0,
) -> DataFrame:
    rows = selected(tables, flt)
    name = ordering.sort_key(ordering.STATS_SORTS, sort)
    if name == "exporter":
        rows = enrich.with_exporter(rows, tables.exporters)
    key = ordering.STATS_SORTS[name]()
    sorting = [
        ordering.database_order(key, ordering.is_ascending(order)),
        F.desc("bytes"),
        *(F.asc(c) for c in KEY_ORDER),
    ]
    page = flows.with_names(ordering.page(rows, sorting, limit, offset), tables, absent=0)
    none = F.lit(None).cast("int")
    return page.orderBy(*sorting).select(
        F.col("bucket_start").alias("received_at"),
        F.col("bucket_start").alias("first_seen"),
        bucket_end().alias("last_seen"),
        F.col("flows").alias("flow_count"),
        "exporter", "exporter_hostname", F.lit("statistics").alias("flow_type"),
        "src_addr", "dst_addr", none.alias("src_port"), none.alias("dst_port"), "proto",
        "bytes", "packets",
        *(F.nullif(c, F.lit(0)).alias(c) for c in ("in_if", "out_if", "service_port")),
        F.nullif("service_side", F.lit("")).alias("service_side"),
        "in_if_name", "out_if_name",
    )


def count(tables, flt: FlowFilter) -> DataFrame:
    return selected(tables, flt).agg(F.count(F.lit(1)).alias("total"))


def _summary_rows(tables, flt: FlowFilter, mode: str) -> tuple[DataFrame, list[str]]:
    return flows.shape(summable(tables, flt), mode, F.nullif("service_port", F.lit(0)))


def _sums(*extra: Column) -> list[Column]:
    return [
        *(F.sum(c).cast("long").alias(c) for c in ("bytes", "packets", "flows")),
        *extra,
        F.max(bucket_end()).alias("last_seen"),
    ]


def summary(
    tables, flt: FlowFilter, sort: str | None = None, order: str | None = None,
    limit: int = 10, offset: int = 0,
) -> DataFrame:
    mode = flows.summary_mode(flt)
    rows, keys = _summary_rows(tables, flt, mode)
    sums = flows.present_summary(rows.groupBy(*keys).agg(*_sums()), mode)
    return flows.order_summary(sums, sort, order, limit, offset)


def summary_count(tables, flt: FlowFilter) -> DataFrame:
    mode = flows.summary_mode(flt)
    rows, keys = _summary_rows(tables, flt, mode)
    return flows.count_groups(rows, keys).select(F.lit(mode).alias("mode"), "total")


def conversations_by_ip(tables, flt: FlowFilter, limit: int = 10, offset: int = 0) -> DataFrame:
    sums = summable(tables, flt).groupBy(*conversations.PAIR).agg(
        *_sums(F.min("bucket_start").alias("first_seen"))
    )
    return ordering.page(sums, conversations.pair_order(), limit, offset)


def conversations_by_interface(
    tables, flt: FlowFilter, limit: int = 10, offset: int = 0
) -> DataFrame:
    sums = summable(tables, flt).groupBy(*conversations.PATH).agg(*_sums())
    page = ordering.page(sums, conversations.path_order(), limit, offset)
    return conversations.present_paths(page, tables, 0, None)


def conversations_count(tables, flt: FlowFilter, group_by: str = "ip") -> DataFrame:
    return flows.count_groups(summable(tables, flt), conversations.group_keys(group_by))
