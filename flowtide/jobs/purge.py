"""Removal of one exporter and everything recorded from it."""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.ip import as_address
from flowtide.jobs.rebuild import rebuild_rollups
from flowtide.operators.filters import instant
from flowtide.plans.inventory import IDLE_AFTER
from flowtide.session import together
from flowtide.sources import files
from flowtide.sources.store import TableStore

PURGED_TABLES = ("conversations", "statistics", "exporter_1m", "interface_1m")


def is_idle(exporters: DataFrame, exporter: str, as_of: datetime) -> bool:
    row = exporters.filter(F.col("ip") == exporter).select(
        (F.col("last_seen") < instant(as_of - IDLE_AFTER)).alias("idle")
    ).first()
    if row is None:
        raise LookupError(f"unknown exporter {exporter}")
    return bool(row["idle"])


def without(rows: DataFrame, exporter: str, column: str = "exporter") -> DataFrame:
    """All rows but those of the exporter; rows without an exporter stay."""
    return rows.filter(~F.col(column).eqNullSafe(exporter))


def report(store: TableStore, exporter: str) -> DataFrame:
    """What a purge removes: one row of counts."""

    def counted(rows: DataFrame, alias: str, *more: Column) -> DataFrame:
        return rows.filter(F.col("exporter") == exporter).agg(
            F.count(F.lit(1)).alias(alias), *more
        )

    parts = [
        counted(
            store.conversations(), "deleted_conversation_rows",
            F.coalesce(F.sum("flow_count"), F.lit(0)).cast("long").alias("deleted_flows"),
        ),
        counted(store.statistics(), "deleted_statistics_rows"),
        counted(store.interfaces, "deleted_interfaces"),
        counted(store.merged("exporter_1m"), "deleted_exporter_aggregate_rows"),
        counted(store.merged("interface_1m"), "deleted_interface_aggregate_rows"),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))


def _touched_days(store: TableStore, name: str, exporter: str) -> list:
    """Days that hold rows of the exporter: at most as many as are retained."""
    rows = store.partials(name).filter(F.col("exporter") == exporter)
    return [row["d"] for row in rows.select("d").distinct().collect()]


def purge(
    store: TableStore, exporter: str, as_of: datetime, keep_history: bool = True
) -> DataFrame:
    """Delete an idle exporter and return the counts of what was deleted.

    Totals, sources, destinations and applications do not know the exporter
    and are recomputed. With ``keep_history`` only for the days the exporter
    was seen on, from statistics where conversations have expired; the other
    exporters' rollups stay as they are. Without it all six are rebuilt from
    conversations alone.
    """
    exporter = as_address(exporter) or exporter
    if not is_idle(store.exporters, exporter, as_of):
        raise RuntimeError(f"exporter {exporter} is active")
    counts = report(store, exporter).first()
    touched = {name: _touched_days(store, name, exporter) for name in PURGED_TABLES}
    # Written down first: a purge that is run again still knows the days it had struck.
    note = f"{store.root}/_purge/{exporter.replace(':', '_')}"
    noted = [day for found in touched.values() for day in found]
    if files.exists(store.spark, note):
        noted += [row.d for row in store.spark.read.schema("d date").parquet(note).collect()]  # retained days at most
    store.spark.createDataFrame([(day,) for day in sorted(set(noted))], "d date").coalesce(1).write.mode("append").parquet(note)

    def strike(name: str) -> None:
        days = touched[name]
        if days:
            rows = store.day_partials(name, days)
            store.replace_days(name, without(rows, exporter), days)

    together(
        store.spark,
        [
            *(partial(strike, name) for name in PURGED_TABLES),
            lambda: store.write_dimension("interfaces", without(store.interfaces, exporter)),
        ],
    )
    if keep_history:
        rebuild_rollups(store, ["total_1m", "src_1m", "dst_1m", "app_1m"], True, sorted(set(noted)))
    else:
        rebuild_rollups(store)
    # Last: until here a second run finds the exporter and does what is left.
    store.write_dimension("exporters", without(store.exporters, exporter, "ip"))
    files.drop(store.spark, note)
    fields = counts.asDict()
    return store.spark.range(1).select(
        *(F.lit(value).cast("long").alias(name) for name, value in fields.items())
    )
