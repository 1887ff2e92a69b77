"""Figures about the store itself, and the exporter bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.operators import dimensions
from flowtide.sources import files
from flowtide.sources.store import TABLES, TableStore


def storage(conversations: DataFrame) -> DataFrame:
    """Rows, flows they stand for, flows per row, and share with a known service."""
    rows = F.count(F.lit(1))
    flows = F.coalesce(F.sum("flow_count"), F.lit(0)).cast("long")
    return conversations.agg(
        rows.alias("conversation_rows"),
        flows.alias("aggregated_flows"),
        F.try_divide(flows.cast("double"), rows.cast("double")).alias("compression_ratio"),
        F.try_divide(F.count("service_port").cast("double"), rows.cast("double")).alias(
            "service_coverage"
        ),
    )


def table_bytes(store: TableStore) -> dict[str, int]:
    """Stored bytes per table, from the file listing."""
    return {name: files.size(store.spark, store.path(name)) for name in TABLES}


def exporters_in(conversations: DataFrame, known: DataFrame) -> DataFrame:
    """Known exporters joined with those the conversations mention."""
    seen = dimensions.exporters_seen(conversations, "first_seen", "last_seen")
    return dimensions.merge_exporters(known, seen)


def bootstrap_exporters(store: TableStore) -> None:
    store.write_dimension("exporters", exporters_in(store.conversations(), store.exporters))
