"""Micro-batches of JSON lines -> all tables of the store.

The streaming query only moves lines; what a batch does is ordinary batch
work. A batch is parsed once and condensed once (to one-minute rows, map-side
combined) into the conversation table; the other tables are made from those
few stored rows, which a lost executor cannot take away. The stored rows can be
merged in any order, so there is no streaming state, and delayed or replayed
files simply fold into their old buckets.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtide.functions import buckets
from flowtide.jobs.upkeep import Upkeep
from flowtide.operators import condense, dimensions, rollups
from flowtide.schemas import FLOWS
from flowtide.session import together
from flowtide.sources import files, jsonl, tail
from flowtide.sources.store import EVENT_TABLES, TableStore

MAX_FILES = 64
TRIGGER = "10 seconds"


def write_derived(store: TableStore, condensed: DataFrame, batch: int) -> None:
    """Statistics, rollups, exporter sightings and log entry of a stored batch."""

    def update_exporters() -> None:
        seen = dimensions.exporters_seen(condensed, "first_seen", "last_seen")
        store.write_dimension("exporters", dimensions.merge_exporters(store.exporters, seen))

    def write_rollup(name: str) -> None:
        store.append(name, rollups.roll_up(condensed, name), batch)

    together(
        store.spark,
        [
            update_exporters,
            lambda: store.append("statistics", rollups.statistics_5m(condensed), batch),
            lambda: store.append("distinct_1m", rollups.sketches_1m(condensed), batch),
            *(partial(write_rollup, name) for name in rollups.ROLLUP_NAMES),
        ],
    )
    event = condensed.agg(
        F.lit("flow").alias("type"),
        F.sum("flow_count").alias("count"),
        F.max("last_seen").alias("ts"),
    )
    # Written last: a batch in the log has all its tables.
    store.append("batch_log", event, batch)


def ingest_flows(store: TableStore, flows: DataFrame, batch: int, arrival_lane: bool = False) -> None:
    """Aggregate a batch of flow rows into the store."""
    store.append("conversations", condense.condense(flows, buckets.minute, arrival_lane), batch)
    condensed = store.batch("conversations", batch)
    if condensed is not None:
        write_derived(store, condensed, batch)
        return
    # A batch that came again empty takes back what it wrote before.
    for name in (*EVENT_TABLES, "batch_log"):
        store.drop_batch(name, batch)


def ingest_lines(store: TableStore, lines: DataFrame, batch: int) -> None:
    """One micro-batch: parse once, stage, split off bad lines, aggregate, write.

    Flows and refused lines are both read from the staged rows, so a bad line
    costs no second parse and a lost executor no more than its files.
    """
    normalized = jsonl.normalize(jsonl.parse(lines))
    kept = F.when(F.col("reason").isNotNull(), F.col("value"))
    staged = f"{store.staging}/lines-{batch}-{uuid.uuid4().hex}"
    normalized.withColumn("value", kept).write.parquet(staged)
    rows = store.spark.read.schema(normalized.schema).parquet(staged)

    def refuse() -> None:
        refused = jsonl.quarantine(rows)
        if refused.isEmpty():
            store.drop_batch("quarantine", batch)
        else:
            store.append("quarantine", refused, batch)

    together(store.spark, [lambda: ingest_flows(store, jsonl.good_flows(rows), batch, arrival_lane=True), refuse])
    files.drop(store.spark, staged)


def _follow(
    rows: DataFrame, sink, store: TableStore, checkpoint: str, drain: bool, upkeep: Upkeep | None = None, pause: str = TRIGGER
) -> StreamingQuery:
    store.recover()

    def batch(batch_rows: DataFrame, number: int) -> None:
        sink(store, batch_rows, number)
        if upkeep is not None:
            upkeep(store)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=pause)
    return writer.start()


def start(
    spark: SparkSession,
    source: str,
    store: TableStore,
    checkpoint: str,
    drain: bool = False,
    max_files: int = MAX_FILES,
    upkeep: Upkeep | None = None,
) -> StreamingQuery:
    """Follow a directory of JSON-lines files. ``drain`` processes what is there
    and then stops.

    A batch whose commit got lost is run again with the same files and batch
    number and overwrites its own partitions: data and position stay in step.
    """
    lines = jsonl.stream_lines(spark, source, max_files)
    return _follow(lines, ingest_lines, store, checkpoint, drain, upkeep)


def start_tail(
    spark: SparkSession, folder: str, store: TableStore, checkpoint: str, max_bytes: int = tail.MAX_BYTES, drain: bool = False,
    upkeep: Upkeep | None = None, **options: str,
) -> StreamingQuery:
    """Follow files that are still being written; a batch takes at most ``max_bytes``.

    ``drain`` works off what is there, batch after batch, and then stops.
    """
    lines = tail.stream_lines(spark, folder, checkpoint, max_bytes, **options)
    # A backlog is worked off without a pause between batches.
    query = _follow(lines, ingest_lines, store, checkpoint, False, upkeep, "0 seconds" if drain else TRIGGER)
    if drain:
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return query


def start_from_flows(
    spark: SparkSession,
    source: str,
    store: TableStore,
    checkpoint: str,
    drain: bool = False,
    max_files: int = MAX_FILES,
    upkeep: Upkeep | None = None,
) -> StreamingQuery:
    """The same for Parquet files of flow rows that carry their arrival time."""
    rows = (
        spark.readStream.schema(FLOWS).option("maxFilesPerTrigger", max_files).parquet(source)
    )
    return _follow(rows, ingest_flows, store, checkpoint, drain, upkeep)
