from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowtide.functions.ip import as_address
from flowtide.jobs import retention
from flowtide.operators import filters, ordering
from flowtide.operators.filters import FlowFilter
from flowtide.plans import flows, history, inventory, periods, statistics

NOON = datetime(2024, 5, 1, 12)


def test_bounds():
    relative = FlowFilter(hours=3)
    assert filters.window(relative, NOON) == (NOON - timedelta(hours=3), None)
    assert filters.bucket_bounds(relative, NOON) == (NOON - timedelta(hours=3, minutes=5), None)
    # An absolute bound switches the relative window off.
    mixed = FlowFilter(hours=3, date_to=NOON)
    assert filters.window(mixed, NOON) == (None, NOON)
    # Windows are taken as given; limits on requests are the caller's (clamp_hours).
    assert filters.window(FlowFilter(hours=17520), NOON)[0] == NOON - timedelta(hours=17520)
    assert [filters.clamp_hours(h) for h in (0, 17520)] == [1, 8760] and filters.clamp_hours(1000, short=True) == 720
    with pytest.raises(ValueError):
        filters.window(relative, None)


def test_emptiness_and_values():
    assert FlowFilter(q="", src="", interface_exporter="192.0.2.1").is_empty()
    assert not FlowFilter(proto=0).is_empty()
    assert as_address("10.0.0.0/24") == "10.0.0.0"
    assert as_address("10.0.") is None
    assert [filters.clamp(v, 1, 50) for v in (None, -3, 7, 99)] == [1, 1, 7, 50]


def test_host_filter_is_exact_or_substring(inputs):
    rows = inputs.tables().conversations()
    exact = filters.keep(rows, [filters.host_matches(F.col("src_addr"), "10.0.1.2")])
    part = filters.keep(rows, [filters.host_matches(F.col("src_addr"), "10.0.1.")])
    wild = filters.keep(rows, [filters.host_matches(F.col("src_addr"), "10.0._.2%")])
    assert {r[0] for r in exact.select("src_addr").distinct().collect()} == {"10.0.1.2"}
    assert part.count() > exact.count() and wild.count() > exact.count()


def test_statistics_bounds_drop_the_straddling_bucket(inputs):
    start = datetime(2024, 1, 1, 0, 12)
    rows = statistics.selected(inputs.tables(), FlowFilter(date_from=start, date_to=start + timedelta(minutes=10)))
    got = sorted({r[0] for r in rows.select("bucket_start").distinct().collect()})
    assert got == [datetime(2024, 1, 1, 0, m) for m in (15, 20, 25)]


def test_listing_default_window_and_count_disagree(inputs):
    tables = inputs.tables()
    listed = flows.listing(tables, FlowFilter(), limit=100).collect()
    newest = tables.newest_bucket()
    assert min(r.first_seen for r in listed) >= newest - timedelta(minutes=10)
    every = flows.count(tables, FlowFilter()).first()[0]
    recent = flows.count(tables, FlowFilter(), latest=True).first()[0]
    assert every == tables.conversations().count() > recent
    # A sort other than the default lifts the window.
    assert min(r.first_seen for r in flows.listing(tables, FlowFilter(), sort="bytes", limit=100).collect()) < newest - timedelta(minutes=10)


@pytest.mark.parametrize("order, first", [("desc", None), ("asc", 1)])
def test_null_order_of_listings(inputs, order, first):
    rows = flows.listing(inputs.tables(), FlowFilter(hours=24), inputs.as_of, sort="out_if", order=order, limit=5)
    assert rows.first().out_if == first


@pytest.mark.parametrize("ascending", [True, False])
def test_seek_paging_equals_offset_paging(spark, ascending):
    rows = spark.createDataFrame(
        [(n % 4 if n % 5 else None, f"k{n % 6:02d}", n) for n in range(40)], "v int, conv_key string, bucket int"
    )
    order = [ordering.database_order(F.col("v"), ascending), F.desc("conv_key"), F.desc("bucket")]
    everything = ordering.page(rows, order, 100).collect()
    seen, last = [], None
    while True:
        keys = [(F.col("v"), ascending, ascending), (F.col("conv_key"), False, False), (F.col("bucket"), False, False)]
        part = rows if last is None else ordering.after(rows, keys, [last.v, last.conv_key, last.bucket])
        page = ordering.page(part, order, 7).collect()
        if not page:
            break
        seen += page
        last = page[-1]
    assert seen == everything


def test_tier_choice():
    def tier(a, b):
        return periods.tier(
            datetime(2024, 5, 1, *a), datetime(2024, 5, 1, *b), datetime(2024, 5, 1, 18), 6
        )

    assert tier((13, 0), (17, 30)) == "detailed"
    assert tier((11, 0), (17, 30)) == tier((13, 0), (18, 30)) == tier((10, 0), (11, 0)) == "statistics"
    assert periods.presets(6) == [1, 3, 6] and periods.presets(24) == [1, 3, 6, 12, 24]


def test_retention_settings():
    assert [retention.snap_detailed_hours(h) for h in (2, 5, 9, 18, 720)] == [1, 6, 6, 12, 24]
    assert [retention.stats_days_from_hours(h) for h in (1, 25, 720)] == [1, 2, 30]
    assert retention.checked(6, 3650) == (6, 3650)
    for bad in ((2, 30), (6, 0), (6, 3651)):
        with pytest.raises(ValueError):
            retention.checked(*bad)


def test_history_filters_need_their_column(inputs):
    with pytest.raises(ValueError):
        history.view(inputs.tables(), "source", inputs.as_of, 1, 30, {"exporter": "192.0.2.1"})
    rows = history.view(inputs.tables(), "interface", inputs.as_of, 1, 30, {"exporter": "192.0.2.1"})
    assert {r.exporter for r in rows.collect()} == {"192.0.2.1"}


def test_requested_labels(spark, inputs):
    asked = " 198.51.100.1, nonsense,198.51.100.1 ,10.0.0.1"
    rows = inventory.ip_labels(spark, inputs.tables(), asked, inputs.as_of, resolution=False).collect()
    assert [(r.ip, r.source) for r in rows] == [("198.51.100.1", "manual")]


def test_active_exporters(inputs):
    rows = {r.exporter: r.active for r in inventory.exporters_list(inputs.tables(), inputs.as_of).collect()}
    assert {ip: rows[ip] for ip in ("192.0.2.2", "192.0.2.3")} == {"192.0.2.2": True, "192.0.2.3": False}
    assert len(rows) == inputs.exporters.count()
