"""Detailed listings, counts, summaries and series over conversations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions import buckets, labels
from flowtide.operators import enrich, ordering
from flowtide.operators.filters import (
    LATEST_SPAN, FlowFilter, bucket_bounds, filter_conversations, latest_only, window,
)

LISTING = [
    "conv_key", "received_at", "flow_time", "first_seen", "last_seen", "flow_count", "exporter",
    "exporter_hostname", "flow_type", "src_addr", "dst_addr", "src_port", "dst_port", "proto",
    "bytes", "packets", "in_if", "out_if", "service_port", "service_side", "in_if_name",
    "out_if_name", "sampling_rate",
]


def selected(tables, flt: FlowFilter, as_of: datetime | None) -> DataFrame:
    """Conversations passing a filter; the bucket bounds prune the scan."""
    rows = tables.conversations(*bucket_bounds(flt, as_of))
    return filter_conversations(rows, flt, as_of, tables.interfaces)


def summable(tables, flt: FlowFilter, as_of: datetime | None) -> DataFrame:
    """``selected`` for readers that sum it or tell keys apart: conversations need not be whole."""
    rows = tables.conversation_parts(*window(flt, as_of))
    return filter_conversations(rows, flt, as_of, tables.interfaces)


def _candidates(tables, flt: FlowFilter, as_of: datetime | None, sort: str | None) -> DataFrame:
    if flt.is_empty() and sort in (None, "received_at"):
        newest = tables.newest_bucket()
        if newest is not None:
            return latest_only(tables.conversations(newest - LATEST_SPAN), newest)
    return selected(tables, flt, as_of)


def with_names(page: DataFrame, tables, absent: int | None = None) -> DataFrame:
    """Adds exporter_hostname, in_if_name and out_if_name to a page of rows."""
    if "exporter_host" not in page.columns:
        page = enrich.with_exporter(page, tables.exporters)
    page = enrich.with_both_interfaces(page, tables.interfaces, absent)

    def index(name: str) -> Column:
        return F.col(name) if absent is None else F.nullif(F.col(name), F.lit(absent))

    return page.withColumns(
        {
            "exporter_hostname": labels.device_name(
                F.col("exporter_custom_name"), F.col("exporter_host")
            ),
            "in_if_name": enrich.listing_label("inside", index("in_if")),
            "out_if_name": enrich.listing_label("outside", index("out_if")),
        }
    )


def listing(
    tables, flt: FlowFilter, as_of: datetime | None = None, sort: str | None = None,
    order: str | None = None, limit: int = 10, offset: int = 0, seek: tuple | None = None,
) -> DataFrame:
    """One page of conversations with names. Names are joined to the page, not to
    the table, unless the page is ordered by the exporter's name.

    ``seek`` holds the sort value, ``conv_key`` and ``bucket_start`` of the last
    row of the page before; the page then begins behind that row."""
    rows = _candidates(tables, flt, as_of, sort)
    name = ordering.sort_key(ordering.FLOW_SORTS, sort)
    if name == "exporter":
        rows = enrich.with_exporter(rows, tables.exporters)
    key = ordering.FLOW_SORTS[name]()
    ascending = ordering.is_ascending(order)
    sorting = [ordering.database_order(key, ascending), F.desc("conv_key"), F.desc("bucket_start")]
    if seek is not None:
        ties = [(F.col("conv_key"), False, False), (F.col("bucket_start"), False, False)]
        rows = ordering.after(rows, [(key, ascending, ascending), *ties], list(seek))
    page = ordering.page(rows, sorting, limit, offset)
    return with_names(page, tables).orderBy(*sorting).select(*LISTING)


def latest(tables, limit: int = 10) -> DataFrame:
    """The newest conversations."""
    return listing(tables, FlowFilter(), limit=limit)


def count(tables, flt: FlowFilter, as_of: datetime | None = None, latest: bool = False) -> DataFrame:
    """Number of conversations. ``latest`` applies the listing's default window too."""
    rows = _candidates(tables, flt, as_of, None) if latest else selected(tables, flt, as_of)
    return rows.agg(F.count(F.lit(1)).alias("total"))


def summary_mode(flt: FlowFilter) -> str:
    if flt.src and not flt.dst:
        return "source"
    if flt.dst and not flt.src:
        return "destination"
    return "pair"


# mode -> (grouped addresses, order in which ports name the service)
_SHAPES = {
    "source": (("dst_addr",), ("service_port", "dst_port", "src_port")),
    "destination": (("src_addr",), ("service_port", "src_port", "dst_port")),
    "pair": (("src_addr", "dst_addr"), ("service_port", "dst_port", "src_port")),
}


def shape(rows: DataFrame, mode: str, port: Column | None = None) -> tuple[DataFrame, list[str]]:
    """Rows with their ``port`` column, and the keys a summary groups them on."""
    addresses, ports = _SHAPES[mode]
    return rows.withColumn("port", F.coalesce(*ports) if port is None else port), [
        *addresses, "proto", "port",
    ]


def present_summary(sums: DataFrame, mode: str) -> DataFrame:
    """Summary columns in their fixed layout: peer, source, destination."""
    nothing = F.lit(None).cast("string")
    peer = {"source": F.col("dst_addr"), "destination": F.col("src_addr"), "pair": nothing}[mode]
    return sums.select(
        peer.alias("peer_addr"),
        (nothing if mode == "source" else F.col("src_addr")).alias("src_addr"),
        (nothing if mode == "destination" else F.col("dst_addr")).alias("dst_addr"),
        "proto", "port", "bytes", "packets", "flows", "last_seen",
    )


def order_summary(
    rows: DataFrame, sort: str | None, order: str | None, limit: int, offset: int
) -> DataFrame:
    name = ordering.SUMMARY_SORTS.get(sort or "bytes", "bytes")
    first = ordering.nulls_last(F.col(name), ordering.is_ascending(order))
    ties = [
        F.col(c).asc_nulls_last() for c in ("src_addr", "dst_addr", "proto", "port") if c != name
    ]
    return ordering.page(rows, [first, *ties], limit, offset)


def summary(
    tables, flt: FlowFilter, as_of: datetime | None = None, sort: str | None = None,
    order: str | None = None, limit: int = 10, offset: int = 0,
) -> DataFrame:
    """Traffic per peer and service, or per address pair and service."""
    mode = summary_mode(flt)
    rows, keys = shape(summable(tables, flt, as_of), mode)
    sums = rows.groupBy(*keys).agg(
        F.sum("bytes").cast("long").alias("bytes"),
        F.sum("packets").cast("long").alias("packets"),
        F.sum("flow_count").cast("long").alias("flows"),
        F.max("last_seen").alias("last_seen"),
    )
    return order_summary(present_summary(sums, mode), sort, order, limit, offset)


def count_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys).distinct().agg(F.count(F.lit(1)).alias("total"))


def summary_count(tables, flt: FlowFilter, as_of: datetime | None = None) -> DataFrame:
    mode = summary_mode(flt)
    rows, keys = shape(summable(tables, flt, as_of), mode)
    return count_groups(rows, keys).select(F.lit(mode).alias("mode"), "total")


def series(tables, flt: FlowFilter, as_of: datetime | None = None) -> DataFrame:
    """Traffic in ten-minute steps under a filter."""
    return (
        summable(tables, flt, as_of)
        .groupBy(buckets.ten_minutes(F.col("received_at")).alias("bucket"))
        .agg(
            F.sum("bytes").cast("long").alias("bytes"),
            F.sum("packets").cast("long").alias("packets"),
            F.sum("flow_count").cast("long").alias("flows"),
        )
        .orderBy("bucket")
    )
