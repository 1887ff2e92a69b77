"""Stores of many days: as many rewrites, notes and unions as for one day."""

from datetime import timedelta

import pytest
from brute import conversations
from pyspark.sql import functions as F
from test_condense import DAY, check, flow, found, frame

from flowtide.jobs import compact
from flowtide.operators import rollups
from flowtide.sources import files
from flowtide.sources.store import BORDERS, COMPACTED, FEW_DAYS, TableStore
from flowtide.streaming import ingest

DAYS = 9


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "tables"))


def days_of_flows(step, days=DAYS, start=0):
    return [flow(start + n, DAY + timedelta(days=n // 2, minutes=step * (n // 2), seconds=n % 2), exporter=f"192.0.2.{1 + n % 3}") for n in range(2 * days)]


def counted(monkeypatch, owner, name):
    calls, real = [], getattr(owner, name)

    def wrapper(*args, **kwargs):
        calls.append(args)
        return real(*args, **kwargs)

    monkeypatch.setattr(owner, name, wrapper)
    return calls


def sums(store, name):
    return store.merged(name).agg(*(F.sum(c) for c in rollups.MEASURES)).first()


def test_days_of_a_table_are_folded_in_one_rewrite(store, monkeypatch):
    rows, late = days_of_flows(7), days_of_flows(7, start=500)
    ingest.ingest_flows(store, frame(store.spark, rows[::2]), 0)
    ingest.ingest_flows(store, frame(store.spark, rows[1::2]), 1)
    ingest.ingest_flows(store, frame(store.spark, late), 2)
    before = {name: sums(store, name) for name in (*rollups.ROLLUP_NAMES, "statistics")}
    rewrites = counted(monkeypatch, TableStore, "replace_days")
    compact.compact(store)
    names = [args[1] for args in rewrites]
    assert len(names) == len(set(names)) and {"conversations", "statistics", "app_1m"} <= set(names)
    assert len(store.days("app_1m")) == DAYS and {b for x in store.partitions("app_1m").values() for b in x} == {COMPACTED, 2}
    # Hour and day levels and heaviest keys lie with every day.
    assert {len(x) for x in store.folders("app_1m", store.days("app_1m")).values()} == {4}
    assert {len(x) for x in store.folders("src_1m", store.days("src_1m")).values()} == {5}
    ingest.ingest_flows(store, frame(store.spark, late), 2)
    check(found(store.conversations()), conversations(rows + late))
    assert {name: sums(store, name) for name in before} == before


def test_a_write_of_many_days_is_noted_by_one_file(store, monkeypatch):
    marks = counted(monkeypatch, files, "add_mark")
    rows = days_of_flows(60)
    ingest.ingest_flows(store, frame(store.spark, rows), 0)
    assert len(marks) < DAYS
    assert store.written_days("total_1m", 0) == store.days("total_1m") and len(store.days("total_1m")) == DAYS
    third = store.days("total_1m")[3]
    zone = store.zones("total_1m", third)[0]
    assert zone.low.replace(tzinfo=None) == zone.high.replace(tzinfo=None) == DAY + timedelta(days=3, hours=3) and zone.rows == 1
    # A window that the notes rule out opens nothing.
    assert store.partials("total_1m", DAY + timedelta(days=3, hours=5), DAY + timedelta(days=3, hours=6)).inputFiles() == []
    # Of a day that goes only this day's notes go.
    store.drop_days("total_1m", [third])
    assert store.zones("total_1m", third) == {} and len(store.zones("total_1m", store.days("total_1m")[4])) == 1
    # The batch comes again on few days, then on many others.
    for days in (2, FEW_DAYS + 3):
        again = [flow(n, DAY + timedelta(days=40 + n, hours=1)) for n in range(days)]
        ingest.ingest_flows(store, frame(store.spark, again), 0)
        check(found(store.conversations()), conversations(again))
        held = [day for day, batches in store.partitions("total_1m").items() if batches]
        assert store.written_days("total_1m", 0) == held and len(held) == days
        assert sums(store, "total_1m")["sum(flows)"] == days


@pytest.mark.parametrize("step", (5, 15))
def test_late_rows_at_another_time_each_day_leave_what_lies_before_unmerged(store, step):
    days = BORDERS + 3 if step == 5 else DAYS
    rows = [flow(n, DAY + timedelta(days=n // 3, hours=8 * (n % 3))) for n in range(3 * days)]
    late = [flow(900 + n, DAY + timedelta(days=n, hours=9, minutes=step * n)) for n in range(days)]
    ingest.ingest_flows(store, frame(store.spark, rows[::2]), 0)
    ingest.ingest_flows(store, frame(store.spark, rows[1::2]), 1)
    ingest.ingest_flows(store, frame(store.spark, late), 2)
    compact.compact(store)
    check(found(store.conversations()), conversations(rows + late))
    borders = store._borders("conversations", {day: x for day, x in store.partitions("conversations").items() if x == [COMPACTED, 2]})
    assert sum(map(len, borders.values())) == days and len(borders) <= BORDERS
    assert all(21 * 3_600 <= second for second in borders)
