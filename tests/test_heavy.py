"""Heaviest keys found by the lists of folded days: the same rows as a full sort."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_condense import DAY

from flowtide import schemas
from flowtide.jobs import compact
from flowtide.plans import dashboard
from flowtide.sources import store as stores
from flowtide.sources.store import DAYS, HEAVY, TableStore

AS_OF = DAY + timedelta(days=4)
WIDE = 24 * 30


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "tables"))


def append(store, rows, batch):
    """Rollup rows (source, minute, bytes) as one batch."""
    made = [(at, key, size, 1, 1) for key, at, size in rows]
    store.append("src_1m", store.spark.createDataFrame(made, schemas.ROLLUPS["src_1m"]).coalesce(1), batch)


def fold(store, below):
    for day in store.days("src_1m"):
        compact.compact_day(store, "src_1m", day, below)


def fill(store, size, sign=1, late=True):
    """Minutes of 300 sources over three days, ``size`` bytes by source and day; the last batch stays open."""
    rng, rows = random.Random(3), []
    for day in range(3):
        for key in range(300):
            at = DAY + timedelta(days=day, minutes=rng.randrange(60))
            rows.append((f"10.0.{key // 200}.{key % 200}", at, size(key, day, rng)))
    append(store, rows[::2], 0)
    append(store, rows[1::2], 1)
    # Heavy only through what came late, and unknown to every list.
    if late:
        append(store, [("10.9.9.9", DAY + timedelta(hours=2, minutes=n), sign * 40_000) for n in range(3)], 2)
    fold(store, 2)


CASES = {
    "skewed": lambda key, day, rng: 100_000 // (1 + key) + rng.randrange(5),
    "flat": lambda key, day, rng: 500,
    # Each day its own heavy sources: none of the heaviest overall leads on every day.
    "turning": lambda key, day, rng: 5_000 if key % 3 == day else 900 - key,
    "nothing": lambda key, day, rng: 0,
}


@pytest.mark.parametrize("case", CASES)
def test_listed_equals_the_full_sort(store, monkeypatch, case):
    monkeypatch.setattr(stores, "HEAVY_KEYS", 20)
    fill(store, CASES[case])
    assert store.heavy_parts("src_1m", AS_OF - timedelta(hours=WIDE)).days == 3
    for hours, limit in ((WIDE, 200 if case == "flat" else 10), (60, 5)):
        want = dashboard.top(store, "src", AS_OF, hours, limit).collect()
        assert dashboard.top_listed(store, "src", AS_OF, hours, limit).collect() == want, (hours, limit)


def test_negative_sums_have_no_list_and_change_no_answer(store, monkeypatch):
    monkeypatch.setattr(stores, "HEAVY_KEYS", 20)
    fill(store, lambda key, day, rng: 1_000 - key, sign=-1)
    parts = store.heavy_parts("src_1m")
    assert parts.rest.agg(F.min("bytes")).first()[0] < 0
    want = dashboard.top(store, "src", AS_OF, WIDE, 10).collect()
    assert dashboard.top_listed(store, "src", AS_OF, WIDE, 10).collect() == want
    day = store.days("src_1m")[0]
    compact.compact_day(store, "src_1m", day)
    assert store.heavy_parts("src_1m") is None
    want = dashboard.top(store, "src", AS_OF, WIDE, 10).collect()
    assert dashboard.top_listed(store, "src", AS_OF, WIDE, 10).collect() == want


def test_lists_are_heavy_short_and_followed_by_the_order_of_the_day(store, monkeypatch):
    monkeypatch.setattr(stores, "HEAVY_KEYS", 20)
    fill(store, CASES["skewed"], late=False)
    for day in store.days("src_1m"):
        folder = f"{store.path('src_1m')}/d={day}/batch="
        rows = [r.bytes for r in store.spark.read.parquet(f"{folder}{DAYS}").coalesce(1).collect()]
        assert len(rows) == 300 and rows == sorted(rows, reverse=True)
        listed = [r.bytes for r in store.spark.read.parquet(f"{folder}{HEAVY}").collect()]
        assert sorted(listed, reverse=True) == rows[:20]
    # A minute's reader does not see lists, nor does a second folding keep old ones.
    assert store.rollup("src_1m").agg(F.sum("flows")).first()[0] == 900
    append(store, [("10.9.9.9", DAY, 10**9)], 3)
    append(store, [("10.9.9.9", DAY, 1)], 4)
    fold(store, 4)
    top = dashboard.top_listed(store, "src", AS_OF, WIDE, 1).first()
    assert (top.label, top.bytes, top.flows) == ("10.9.9.9", 10**9 + 1, 2)


def test_only_keys_that_reach_the_share_are_summed(store, monkeypatch):
    """The threshold reaches the scan of the days, and few keys pass it."""
    monkeypatch.setattr(stores, "HEAVY_KEYS", 20)
    fill(store, CASES["skewed"], late=False)
    parts = store.heavy_parts("src_1m", AS_OF - timedelta(hours=WIDE))
    sums = dashboard._reaching(parts, "src_addr", 5)
    # Five of 300 sources are asked for; a source at a fifth of the fifth one's sum may still pass.
    assert 5 <= sums.count() <= 5 * (parts.days + 1)
