"""History views: rollups older than the detailed window, within retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.operators import ordering
from flowtide.schemas import ROLLUP_KEYS

VIEWS = {
    "source": "src_1m", "destination": "dst_1m", "exporter": "exporter_1m",
    "interface": "interface_1m", "application": "app_1m", "total": "total_1m",
}
# A filter is offered only where the rollup keeps the column it needs.
VIEW_FILTERS = {
    "source": ("src_addr",), "destination": ("dst_addr",), "exporter": ("exporter",),
    "interface": ("exporter", "if_index"), "application": ("proto", "port"), "total": (),
}


def view(
    tables, kind: str, as_of: datetime, detailed_hours: int, stats_days: int,
    filters: dict | None = None, limit: int = 100, offset: int = 0,
) -> DataFrame:
    """Traffic per key between the two retention limits, with its bucket range."""
    name = VIEWS[kind]
    oldest = as_of - timedelta(days=stats_days)
    newest = as_of - timedelta(hours=detailed_hours)
    # The newest bucket begins before the border.
    rows = tables.spans(name, oldest, newest - timedelta(microseconds=1))
    for column, value in (filters or {}).items():
        if column not in VIEW_FILTERS[kind]:
            raise ValueError(f"{kind} history cannot be filtered by {column}")
        rows = rows.filter(F.col(column) == F.lit(value))
    keys = [key for key, _ in ROLLUP_KEYS[name]]
    sums = rows.groupBy(*keys).agg(
        *(F.sum(c).cast("long").alias(c) for c in ("bytes", "packets", "flows")),
        F.min("first").alias("first_bucket"),
        F.max("last").alias("last_bucket"),
    )
    return ordering.page(sums, [F.desc("bytes"), *(F.asc(k) for k in keys)], limit, offset)
