"""Rollups and statistics recomputed from stored conversations."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions import buckets
from flowtide.operators import condense, rollups
from flowtide.operators.filters import BUCKET, instant, on_days, utc
from flowtide.schemas import ROLLUP_KEYS, ROLLUPS, SKETCHED, STATISTICS
from flowtide.session import together
from flowtide.sources.store import COMPACTED, TableStore


def _sums(flows: str) -> list[Column]:
    return [
        F.sum("bytes").cast("long").alias("bytes"),
        F.sum("packets").cast("long").alias("packets"),
        F.sum(flows).cast("long").alias("flows"),
    ]


def union_of_interfaces(rows: DataFrame, flows: str = "flow_count") -> DataFrame:
    """Sums per interface over both directions; a hairpin row counts on each side."""
    base = rows.filter(F.col("exporter").isNotNull())
    sides = [
        base.withColumn("if_index", F.col(side))
        .filter(F.col("if_index").isNotNull())
        .groupBy("bucket", "exporter", "if_index")
        .agg(*_sums(flows))
        for side in ("in_if", "out_if")
    ]
    return rollups.merge_sums(
        sides[0].unionByName(sides[1]), rollups.rollup_key("interface_1m")
    )


def _rollup_of(rows: DataFrame, name: str, flows: str) -> DataFrame:
    if name == "interface_1m":
        return union_of_interfaces(rows, flows)
    keys = [key for key, _ in ROLLUP_KEYS[name]]
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    return rows.groupBy("bucket", *keys).agg(*_sums(flows)).select(*ROLLUPS[name].names)


def rebuilt(conversations: DataFrame, name: str) -> DataFrame:
    """A rollup from conversations: each counts in the minute it was last seen.

    The application is the service port or, failing that, any port.
    """
    rows = conversations.withColumns(
        {
            "bucket": buckets.minute(F.col("last_seen")),
            "port": F.coalesce("service_port", "dst_port", "src_port"),
        }
    )
    return _rollup_of(rows, name, "flow_count")


def from_statistics(statistics: DataFrame, name: str) -> DataFrame:
    """A rollup in five-minute steps from statistics, for times without conversations.

    Flows that lack an exporter, an address or the protocol are not in there.
    """
    rows = statistics.withColumns(
        {
            "bucket": F.col("bucket_start"),
            "port": F.nullif("service_port", F.lit(0)),
            "in_if": F.nullif("in_if", F.lit(0)),
            "out_if": F.nullif("out_if", F.lit(0)),
        }
    )
    return _rollup_of(rows, name, "flows")


def backfill_statistics(conversations: DataFrame) -> DataFrame:
    kept = conversations
    for column in ("exporter", "src_addr", "dst_addr", "proto"):
        kept = kept.filter(F.col(column).isNotNull())
    return (
        kept.withColumns(
            {
                "service_port": F.coalesce("service_port", F.lit(0)),
                "service_side": F.coalesce("service_side", F.lit("")),
                "in_if": F.coalesce("in_if", F.lit(0)),
                "out_if": F.coalesce("out_if", F.lit(0)),
            }
        )
        .groupBy(*rollups.STATS_KEY)
        .agg(*_sums("flow_count"))
        .select(*STATISTICS.names)
    )


def replayable(store: TableStore) -> int | None:
    """The newest stored batch, which may be written again."""
    return max((b for found in store.partitions("conversations").values() for b in found if b != COMPACTED), default=None)


def parts(store: TableStore, days: list[date] | None = None) -> list[tuple[int, DataFrame]]:
    """Conversations of closed batches, and those of the newest, with the batch number their sums go under.

    Sums of the parts add up. A replay replaces the newest batch's part only.
    """
    newest = replayable(store)
    rows, horizon = store.partials("conversations"), store.horizon("conversations")
    if days is not None:
        rows = rows.filter(on_days(days))
    groups = [(COMPACTED, rows)] if newest is None else [
        (COMPACTED, rows.filter(F.col("batch") < newest)), (newest, rows.filter(F.col("batch") == newest)),
    ]
    visible = F.lit(True) if horizon is None else F.col("last_seen") >= instant(horizon)
    return [(batch, condense.finish(condense.merge(some).filter(visible))) for batch, some in groups]


def rebuild_rollups(
    store: TableStore,
    names: list[str] | None = None,
    keep_history: bool = False,
    days: list[date] | None = None,
) -> None:
    """Replace rollups, or some days of them, by what conversations say.

    Conversations reach back a day at most. ``keep_history`` fills the time
    before them from statistics; without it that history is lost.
    """
    # A conversation is counted in the minute it was last seen, up to a day after the one its bucket lies in.
    near = None if days is None else sorted({day - timedelta(days=back) for day in days for back in (0, 1)})
    found, older = parts(store, near), None
    if keep_history:
        border, older = _border(store), store.partials("statistics")
        if near is not None:
            older = older.filter(on_days(near))
        if border is not None:
            older = older.filter(F.col("bucket_start") < instant(border))
            found = [(batch, rows.filter(F.col("bucket_start") >= instant(border))) for batch, rows in found]
    newest = replayable(store)

    def rewrite(name: str) -> None:
        pieces = [rebuilt(rows, name).withColumn("batch", F.lit(batch).cast("long")) for batch, rows in found]
        if older is not None:
            closed = F.lit(True) if newest is None else F.col("batch") < newest
            for batch, some in ((COMPACTED, older.filter(closed)), (newest, older.filter(~closed))):
                if batch is not None:
                    pieces.append(from_statistics(some, name).withColumn("batch", F.lit(batch).cast("long")))
        rows = pieces[0]
        for piece in pieces[1:]:
            rows = rows.unionByName(piece)
        replaced = store.days(name)
        if days is not None:
            rows = rows.filter(on_days(days, "to_date(bucket)"))
            replaced = sorted({*replaced} & {*days})
        store.replace_days(name, rows, replaced)

    together(store.spark, [partial(rewrite, name) for name in names or rollups.ROLLUP_NAMES])
    rebuild_sketches(store, days)


def rebuild_sketches(store: TableStore, days: list[date] | None = None) -> None:
    """Replace the sketches of distinct keys, or some days of them, by what the rollups say."""
    parts = {name: store.partials(name) for name, _ in SKETCHED.values()}
    replaced = store.days("distinct_1m")
    if days is not None:
        parts = {name: rows.filter(on_days(days)) for name, rows in parts.items()}
        replaced = sorted({*replaced} & {*days})
    store.replace_days("distinct_1m", rollups.sketches_of(parts, "batch"), replaced)


def _border(store: TableStore) -> datetime | None:
    """From this bucket on conversations are complete; before it only statistics are.

    A horizon hides part of the bucket it falls into. None: no conversation is
    left, so statistics say it all.
    """
    days = store.days("conversations")
    if not days:
        return None
    end = datetime(days[0].year, days[0].month, days[0].day) + timedelta(days=1)
    micros = store.partials("conversations", None, end).agg(F.unix_micros(F.min("bucket_start"))).first()[0]
    oldest = None if micros is None else utc(datetime(1970, 1, 1) + timedelta(microseconds=micros))
    horizon = store.horizon("conversations")
    if horizon is None:
        return oldest
    since = utc(horizon) - utc(datetime(1970, 1, 1))
    whole = utc(datetime(1970, 1, 1)) - (-since // BUCKET) * BUCKET
    return whole if oldest is None else max(oldest, whole)


def backfill(store: TableStore) -> None:
    """Fill empty statistics from conversations, the newest batch's under its own number."""
    if store.days("statistics"):
        return
    pieces = [backfill_statistics(rows).withColumn("batch", F.lit(batch).cast("long")) for batch, rows in parts(store)]
    rows = pieces[0]
    for piece in pieces[1:]:
        rows = rows.unionByName(piece)
    store.replace_days("statistics", rows, [])
