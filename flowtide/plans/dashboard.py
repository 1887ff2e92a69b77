"""Dashboard figures: summary, top lists and time series over the rollups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions import buckets, labels, proto
from flowtide.operators import enrich, ordering
from flowtide.operators.filters import between


# Lists up to this long go to every task beside what they select.
LISTED = 1_000


def _since(as_of: datetime, hours: int) -> datetime:
    return as_of - timedelta(hours=hours)


def summary(tables, as_of: datetime, hours: int = 24) -> DataFrame:
    """One row: traffic, distinct exporters/sources/destinations, configured interfaces."""
    low = _since(as_of, hours)
    totals = tables.spans("total_1m", low).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("flows", "bytes", "packets"))
    )

    def distinct(name: str, key: str, alias: str) -> DataFrame:
        return tables.spans(name, low).agg(F.count_distinct(key).alias(alias))

    parts = [
        totals,
        distinct("exporter_1m", "exporter", "exporters"),
        tables.interfaces.agg(F.count(F.lit(1)).alias("interfaces")),
        distinct("src_1m", "src_addr", "sources"),
        distinct("dst_1m", "dst_addr", "destinations"),
    ]
    # Six one-row results side by side: stacked, then folded into one row.
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))


def summary_approx(tables, as_of: datetime, hours: int = 24) -> DataFrame:
    """Distinct counts of ``summary`` from stored sketches (standard error 0.8 %); no key is read."""
    rows = tables.sketches(_since(as_of, hours))
    return rows.agg(
        *(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("long").alias(c) for c in ("exporters", "sources", "destinations"))
    )


def _totals(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("bytes").cast("long").alias("bytes"), F.sum("flows").cast("long").alias("flows")
    )


# kind -> (rollup, grouping keys). The label is made after the top rows are known.
TOP_KINDS = {
    "src": ("src_1m", ("src_addr",)),
    "dst": ("dst_1m", ("dst_addr",)),
    "exporter": ("exporter_1m", ("exporter",)),
    "app": ("app_1m", ("proto", "port")),
    "proto": ("app_1m", ("proto",)),
    "port": ("app_1m", ("port",)),
}


def top(tables, kind: str, as_of: datetime, hours: int = 24, limit: int = 10) -> DataFrame:
    """Heaviest keys of one kind by bytes; equal bytes are ordered by key."""
    name, keys = TOP_KINDS[kind]
    sums = _totals(tables.spans(name, _since(as_of, hours)), *keys)
    order = [F.desc("bytes"), *(F.asc(key) for key in keys)]
    best = ordering.top(sums, order, limit)
    if kind == "exporter":
        label = labels.device_label(
            F.col("exporter_custom_name"), F.col("exporter_host"), F.col("exporter")
        )
        return (
            enrich.with_exporter(best, tables.exporters)
            .select("exporter", label.alias("label"), "bytes", "flows")
            .orderBy(F.desc("bytes"), F.asc("exporter"))
        )
    if kind == "app":
        label = proto.service_label(F.col("description"), F.col("proto"), F.col("port"))
        return (
            enrich.with_port_description(best, tables.port_descriptions)
            .select("proto", "port", "bytes", "flows", "description", label.alias("label"))
            .orderBy(*order)
        )
    return best.select(F.col(keys[0]).cast("string").alias("label"), "bytes", "flows")


def _reaching(parts, key: str, limit: int) -> DataFrame:
    """Sums of the keys that may be among the ``limit`` heaviest, found by a uniform threshold.

    The lists of the days give sums that keys have at least, and so a sum that
    ``limit`` keys reach. Whoever reaches it too has an even share of it on
    some day or in the rest. Only such keys are summed. Where the lists know
    too few keys or nothing above zero, every key is.
    """
    total = F.sum("bytes").cast("long").alias("bytes")
    rest = _totals(parts.rest, key)
    # What the rest takes away from a key at most, should it hold negative sums.
    taken = rest.agg(F.least(F.lit(0), F.coalesce(F.min("bytes"), F.lit(0))).cast("long").alias("taken"))
    known = parts.lists.groupBy(key).agg(total).orderBy(F.desc("bytes")).limit(limit)
    bound = known.agg(F.when(F.count("*") >= limit, F.min("bytes")).alias("bound")).select((F.col("bound") + taken.scalar()).alias("bound"))
    shares = parts.days + 1
    share = F.when(F.col("bound") > 0, F.expr(f"(bound + {shares - 1}) div {shares}"))
    # A scalar subquery: its value reaches the Parquet scan, which skips row groups below it.
    least = bound.select(F.coalesce(share, F.lit(-(2**63))).cast("long").alias("least")).scalar()
    whole = parts.whole.select(key, "bytes", "flows")
    able = whole.filter(F.col("bytes") >= least).select(key).unionByName(rest.filter(F.col("bytes") >= least).select(key)).distinct()
    return _totals(whole.unionByName(rest).join(able, key, "left_semi"), key)


def top_listed(tables, kind: str, as_of: datetime, hours: int = 24, limit: int = 10) -> DataFrame:
    """``top`` of sources or destinations over a window of many folded days, without sorting or shuffling all keys.

    Where a day of the window has no list, and for other kinds, this is ``top``.
    """
    name, keys = TOP_KINDS[kind]
    parts = tables.heavy_parts(name, _since(as_of, hours)) if kind in ("src", "dst") and limit > 0 else None
    if parts is None:
        return top(tables, kind, as_of, hours, limit)
    best = ordering.top(_reaching(parts, keys[0], limit), [F.desc("bytes"), F.asc(keys[0])], limit)
    return best.select(F.col(keys[0]).cast("string").alias("label"), "bytes", "flows")


def top_interfaces(tables, as_of: datetime, hours: int = 1, limit: int = 10) -> DataFrame:
    sums = _totals(
        tables.spans("interface_1m", _since(as_of, hours)), "exporter", "if_index"
    )
    best = ordering.top(sums, [F.desc("bytes"), F.asc("exporter"), F.asc("if_index")], limit)
    named = enrich.with_interface(best, tables.interfaces, "if_index", "named")
    named = enrich.with_exporter(named, tables.exporters).withColumns(
        {
            "interface_name": enrich.interface_label(
                "named", labels.if_index_text(F.col("if_index"))
            ),
            "device_name": labels.display_name(
                F.col("exporter_custom_name"), F.col("exporter_host"), F.col("exporter")
            ),
        }
    )
    label = F.concat("interface_name", F.lit(" ("), "device_name", F.lit(")"))
    return named.select(
        "exporter", "if_index", "interface_name", "device_name", label.alias("label"),
        "bytes", "flows",
    ).orderBy(F.desc("bytes"), F.asc("exporter"), F.asc("if_index"))


def device_timeseries(tables, as_of: datetime, hours: int = 24, limit: int = 10) -> DataFrame:
    """Hourly bytes of the heaviest exporters."""
    low = as_of - timedelta(hours=hours)
    rows = tables.conversation_parts(low)
    for predicate in between(F.col("received_at"), low, None):
        rows = rows.filter(predicate)
    # Hour sums first: the ranking and the series both read this small result,
    # so the conversations are scanned once and the join is on sums.
    hourly = (
        rows.filter(F.col("exporter").isNotNull())
        .groupBy(buckets.hour(F.col("received_at")).alias("bucket"), "exporter")
        .agg(F.sum("bytes").cast("long").alias("bytes"))
    )
    heaviest = ordering.top(
        hourly.groupBy("exporter").agg(F.sum("bytes").alias("total")),
        [F.desc("total"), F.asc("exporter")], limit,
    ).select("exporter")
    chosen = F.broadcast(heaviest) if limit <= LISTED else heaviest
    return hourly.join(chosen, "exporter", "left_semi").select(
        "bucket", "exporter", "bytes"
    ).orderBy("bucket", "exporter")


def traffic_timeseries(tables, as_of: datetime, hours: int = 24) -> DataFrame:
    rows = tables.rollup("total_1m", _since(as_of, hours))
    return (
        rows.groupBy(buckets.ten_minutes(F.col("bucket")).alias("bucket"))
        .agg(*(F.sum(c).cast("long").alias(c) for c in ("bytes", "packets", "flows")))
        .orderBy("bucket")
    )
