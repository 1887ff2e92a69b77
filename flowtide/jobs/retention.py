"""Expiry of conversations, statistics and rollups; retention parameters."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide.catalogs import DETAILED_HOURS, STATS_DAYS_RANGE
from flowtide.operators.filters import BUCKET, utc
from flowtide.sources.store import EVENT_TABLES, LOG_TABLES, TableStore


def snap_detailed_hours(hours: int) -> int:
    """Nearest offered choice, the smaller one half-way."""
    return min(DETAILED_HOURS, key=lambda choice: (abs(choice - hours), choice))


def snap_detailed_column(hours: Column) -> Column:
    """``snap_detailed_hours`` for a column of saved settings."""
    choices = [F.struct(F.abs(hours - c).alias("off"), F.lit(c).alias("choice")) for c in DETAILED_HOURS]
    return F.least(*choices)["choice"]


def stats_days_column(hours: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(hours / 24).cast("int"))


def stats_days_from_hours(hours: int) -> int:
    return max(1, math.ceil(hours / 24))


def checked(raw_hours: int, stats_days: int) -> tuple[int, int]:
    """Retention settings as given, or an error."""
    if raw_hours not in DETAILED_HOURS:
        raise ValueError(f"detailed retention must be one of {DETAILED_HOURS} hours")
    low, high = STATS_DAYS_RANGE
    if not low <= stats_days <= high:
        raise ValueError(f"statistics retention must be {low} to {high} days")
    return raw_hours, stats_days


def _expire(store: TableStore, name: str, cutoff: datetime, slack: timedelta = timedelta(0)) -> None:
    """Hide what is older than the cutoff and drop the days that lie before it."""
    store.set_horizon(name, cutoff)
    first_kept = (cutoff - slack).date()
    store.drop_days(name, [day for day in store.days(name) if day < first_kept])


def expire_conversations(store: TableStore, as_of: datetime, hours: int) -> None:
    """Remove conversations last seen before the cutoff, each as a whole."""
    _expire(store, "conversations", utc(as_of) - timedelta(hours=max(1, hours)), BUCKET)


def expire_statistics(store: TableStore, as_of: datetime, days: int) -> None:
    """Statistics and all six rollups."""
    cutoff = utc(as_of) - timedelta(days=max(1, days))
    for name in EVENT_TABLES:
        if name != "conversations":
            _expire(store, name, cutoff)


def expire_logs(store: TableStore, as_of: datetime, days: int) -> None:
    """Batch log and refused lines, kept as long as statistics."""
    cutoff = utc(as_of) - timedelta(days=max(1, days))
    for name in LOG_TABLES:
        _expire(store, name, cutoff)
