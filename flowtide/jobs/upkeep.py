"""Expiry and compaction while a stream runs."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from flowtide.catalogs import DETAILED_HOURS
from flowtide.jobs import compact, retention
from flowtide.sources.store import TableStore

EVERY = timedelta(hours=1)


def run(store: TableStore, as_of: datetime, detailed_hours: int = DETAILED_HOURS[-1], stats_days: int = 30) -> None:
    """Expire what is out of retention, then fold finished batches."""
    retention.expire_conversations(store, as_of, detailed_hours)
    retention.expire_statistics(store, as_of, stats_days)
    retention.expire_logs(store, as_of, stats_days)
    compact.compact(store)


class Upkeep:
    """Called after every batch; does its work once in ``every``.

    It runs between two batches of the stream, so nothing else writes.
    """

    def __init__(self, every: timedelta = EVERY, clock=None, **settings: int):
        self.every, self.settings = every, settings
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.last: datetime | None = None

    def __call__(self, store: TableStore) -> bool:
        now = self.clock()
        if self.last is not None and now - self.last < self.every:
            return False
        run(store, now, **self.settings)
        self.last = now
        return True
