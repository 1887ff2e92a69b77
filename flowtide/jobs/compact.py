"""Compaction: finished batches of a day folded into one row per key."""

from __future__ import annotations

from datetime import date
from functools import partial

from pyspark.sql import functions as F

from flowtide.session import together
from flowtide.sources.store import COMPACTED, TABLES, TableStore, merge_table


def newest_batch(store: TableStore) -> int | None:
    stored = store.partitions("batch_log").values()
    return max((batch for found in stored for batch in found), default=None)


def compact_day(store: TableStore, name: str, day: date, below: int | None = None) -> None:
    """Fold batches of one day."""
    compact_days(store, name, [day], below)


def compact_days(store: TableStore, name: str, days: list[date], below: int | None = None) -> None:
    """Fold batches of some days, all in one rewrite: a day is part of every key.

    ``below`` keeps batches from that number on as they are: the newest one may
    still be replayed and must stay replaceable.
    """
    rows = store.day_partials(name, days)
    closed = F.col("batch") < below if below is not None else F.lit(True)
    folded = merge_table(name, rows.filter(closed)).withColumn("batch", F.lit(COMPACTED).cast("long"))
    out = folded
    if below is not None and any(b >= below for found in store.folders(name, days).values() for b in found):
        out = folded.unionByName(rows.filter(~closed).select(*folded.columns))
    store.replace_days(name, out, days)


def compact(store: TableStore, days: list[date] | None = None) -> None:
    """Compact every table, or the given days of it, up to the newest batch.

    Without a finished batch nothing is closed: what is stored may be replayed.
    """
    below = newest_batch(store)
    if below is None:
        return
    jobs = []
    for name in TABLES:
        horizon, due = store.horizon(name), []
        for day, found in store.partitions(name).items():
            if days is not None and day not in days:
                continue
            closed = [b for b in found if b < below]
            hidden = horizon is not None and day <= horizon.date()
            # A folded day is folded again when a horizon hides part of it.
            if closed and (closed != [COMPACTED] or hidden):
                due.append(day)
        if due:
            jobs.append(partial(compact_days, store, name, due, below))
    together(store.spark, jobs)
