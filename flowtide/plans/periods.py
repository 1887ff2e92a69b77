"""Period choice: which presets exist, and which table answers a custom period."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.catalogs import DETAILED_HOURS
from flowtide.operators.filters import FlowFilter, instant, utc
from flowtide.plans import conversations, flows, statistics

SHARED = statistics.LISTING


def presets(detailed_hours: int) -> list[int]:
    """Preset hours on offer: those the detailed table can answer."""
    return [h for h in DETAILED_HOURS if h <= detailed_hours]


def presets_column(detailed_hours: Column) -> Column:
    """``presets`` for a column of settings, as text."""
    offered = F.filter(F.array(*(F.lit(h) for h in DETAILED_HOURS)), lambda h: h <= detailed_hours)
    return F.array_join(offered.cast("array<string>"), "/")


def tier(date_from: datetime, date_to: datetime, as_of: datetime, detailed_hours: int) -> str:
    """``detailed`` when both ends lie in the detailed window, else ``statistics``."""
    end = utc(as_of)
    start = end - timedelta(hours=detailed_hours)
    inside = all(start <= utc(moment) <= end for moment in (date_from, date_to))
    return "detailed" if inside else "statistics"


def tier_column(
    date_from: Column, date_to: Column, as_of: datetime, detailed_hours: int
) -> Column:
    """``tier`` for many periods at once."""
    low, high = instant(as_of - timedelta(hours=detailed_hours)), instant(as_of)
    inside = date_from.between(low, high) & date_to.between(low, high)
    return F.when(inside, F.lit("detailed")).otherwise(F.lit("statistics"))


def _tier_of(flt: FlowFilter, as_of: datetime, detailed_hours: int) -> str:
    """Without both bounds a period is relative, which is detailed."""
    if flt.date_from is None or flt.date_to is None:
        return "detailed"
    return tier(flt.date_from, flt.date_to, as_of, detailed_hours)


def period_flows(
    tables, flt: FlowFilter, as_of: datetime, detailed_hours: int, **paging
) -> DataFrame:
    if _tier_of(flt, as_of, detailed_hours) == "detailed":
        return flows.listing(tables, flt, as_of, **paging).select(*SHARED)
    return statistics.listing(tables, flt, **paging)


def period_conversations(
    tables, flt: FlowFilter, as_of: datetime, detailed_hours: int, group_by: str = "ip", **paging
) -> DataFrame:
    if _tier_of(flt, as_of, detailed_hours) == "detailed":
        report = conversations.by_interface if group_by == "interface" else conversations.by_ip
        return report(tables, flt, as_of, **paging)
    report = (
        statistics.conversations_by_interface
        if group_by == "interface"
        else statistics.conversations_by_ip
    )
    return report(tables, flt, **paging)
