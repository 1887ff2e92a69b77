"""Filters of flow listings, summaries and history, as one AND-ed predicate set."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.ip import as_address
from flowtide.functions.labels import contains_text

BUCKET = timedelta(minutes=5)
LATEST_SPAN = timedelta(minutes=10)


def utc(moment: datetime) -> datetime:
    """The same instant as an aware UTC datetime; naive input already is UTC."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def on_days(days: list[date], of: str = "d") -> Column:
    """Whether a date, given as an expression, is one of some days; one text, as there may be thousands."""
    listed = ", ".join(f"DATE'{day}'" for day in days)
    return F.expr(f"{of} IN ({listed})") if days else F.lit(False)


def instant(moment: datetime) -> Column:
    """Timestamp literal that does not depend on the machine's time zone."""
    delta = utc(moment) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(delta // timedelta(microseconds=1)))


def clamp(value: int | None, low: int, high: int) -> int:
    return min(max(int(value if value is not None else low), low), high)


def clamp_column(value: Column, low: int, high: int) -> Column:
    """``clamp`` for a column of requested values."""
    return F.least(F.greatest(F.coalesce(value, F.lit(low)), F.lit(low)), F.lit(high))


def clamp_hours(hours: int, short: bool = False) -> int:
    """Hours that a request may ask for: a year, or 30 days in short reports. Reports take any number."""
    return clamp(hours, 1, 720 if short else 8760)


@dataclass(frozen=True)
class FlowFilter:
    hours: int | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None
    exporter: str | None = None
    q: str | None = None
    src: str | None = None
    dst: str | None = None
    src_port: int | None = None
    dst_port: int | None = None
    port: int | None = None
    proto: int | None = None
    interface: str | None = None
    interface_exporter: str | None = None
    interface_index: int | None = None
    in_if: int | None = None
    out_if: int | None = None

    def is_empty(self) -> bool:
        """No condition at all: every field unset, empty text counting as unset."""
        return not any(
            getattr(self, f.name) not in (None, "")
            for f in fields(self)
            if f.name != "interface_exporter"
        )

    def with_range(self, date_from: datetime, date_to: datetime) -> "FlowFilter":
        return replace(self, hours=None, date_from=date_from, date_to=date_to)


def window(flt: FlowFilter, as_of: datetime | None) -> tuple[datetime | None, datetime | None]:
    """Exact bounds on ``received_at``. An absolute bound switches ``hours`` off."""
    if flt.date_from or flt.date_to or flt.hours is None:
        return flt.date_from, flt.date_to
    if as_of is None:
        raise ValueError("a relative window needs as_of")
    return as_of - timedelta(hours=flt.hours), None


def bucket_bounds(
    flt: FlowFilter, as_of: datetime | None
) -> tuple[datetime | None, datetime | None]:
    """Coarse inclusive bounds on ``bucket_start``, wide enough for ``window``."""
    low, high = window(flt, as_of)
    return (low - BUCKET if low else None), high


def between(column: Column, low: datetime | None, high: datetime | None) -> list[Column]:
    out = []
    if low:
        out.append(column >= instant(low))
    if high:
        out.append(column <= instant(high))
    return out


def same_host(column: Column, text: str) -> Column:
    host = as_address(text)
    return column == F.lit(host if host is not None else text.strip().split("/", 1)[0])


def host_matches(column: Column, text: str) -> Column:
    """Equality for an address, otherwise a case-insensitive substring."""
    host = as_address(text)
    return column == F.lit(host) if host is not None else contains_text(column, text)


def _free_text(text: str, names: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for name in names:
        hit = hit | contains_text(F.col(name).cast("string"), text)
    return hit


def _shared(flt: FlowFilter, text_columns: tuple[str, ...]) -> list[Column]:
    """Conditions that read the same in the detailed and the statistics table."""
    out = []
    if flt.q:
        out.append(_free_text(flt.q, text_columns))
    if flt.exporter:
        out.append(same_host(F.col("exporter"), flt.exporter))
    if flt.src:
        out.append(host_matches(F.col("src_addr"), flt.src))
    if flt.dst:
        out.append(host_matches(F.col("dst_addr"), flt.dst))
    if flt.proto is not None:
        out.append(F.col("proto") == flt.proto)
    if flt.interface_index is not None:
        out.append(
            (F.col("in_if") == flt.interface_index) | (F.col("out_if") == flt.interface_index)
        )
        if flt.interface_exporter:
            out.append(same_host(F.col("exporter"), flt.interface_exporter))
    if flt.in_if is not None:
        out.append(F.col("in_if") == flt.in_if)
    if flt.out_if is not None:
        out.append(F.col("out_if") == flt.out_if)
    return out


def conversation_predicates(flt: FlowFilter, as_of: datetime | None) -> list[Column]:
    """All conditions on conversation rows except the interface-name search."""
    out = between(F.col("bucket_start"), *bucket_bounds(flt, as_of))
    out += between(F.col("received_at"), *window(flt, as_of))
    out += _shared(
        flt, ("src_addr", "dst_addr", "exporter", "src_port", "dst_port", "service_port")
    )
    if flt.src_port is not None:
        out.append(F.col("src_port") == flt.src_port)
    if flt.dst_port is not None:
        out.append(F.col("dst_port") == flt.dst_port)
    if flt.port is not None:
        out.append(
            (F.col("service_port") == flt.port)
            | (F.col("src_port") == flt.port)
            | (F.col("dst_port") == flt.port)
        )
    return out


def statistics_predicates(flt: FlowFilter) -> list[Column]:
    """Conditions on statistics rows; only service ports are known there."""
    start = F.col("bucket_start")
    out = []
    if flt.date_from:
        out.append(start >= instant(flt.date_from))
    if flt.date_to:
        out.append(start < instant(flt.date_to + BUCKET))
    out += _shared(flt, ("src_addr", "dst_addr", "exporter", "service_port"))
    for side, port in (("source", flt.src_port), ("destination", flt.dst_port)):
        if port is not None:
            out.append((F.col("service_side") == side) & (F.col("service_port") == port))
    if flt.port is not None:
        out.append(F.col("service_port") == flt.port)
    return out


def keep(rows: DataFrame, predicates: list[Column]) -> DataFrame:
    for predicate in predicates:
        rows = rows.filter(predicate)
    return rows


def searches_interface_names(flt: FlowFilter) -> bool:
    return bool(flt.interface) and flt.interface_index is None


def by_interface_text(rows: DataFrame, interfaces: DataFrame, text: str) -> DataFrame:
    """Rows whose interface has exactly this index or a name containing the text."""
    hits = interfaces.filter(
        contains_text(F.col("if_name"), text) | contains_text(F.col("if_descr"), text)
    )
    found = F.lit(False)
    for side in ("in_if", "out_if"):
        keys = hits.select(
            F.col("exporter"), F.col("if_index").alias(side), F.lit(True).alias(f"{side}_hit")
        )
        rows = rows.join(keys, ["exporter", side], "left")
        found = (
            found
            | (F.col(side).cast("string") == text)
            | F.coalesce(F.col(f"{side}_hit"), F.lit(False))
        )
    return rows.filter(found).drop("in_if_hit", "out_if_hit")


def latest_only(rows: DataFrame, newest: datetime) -> DataFrame:
    """Only buckets within ten minutes of the newest one."""
    return rows.filter(F.col("bucket_start") >= instant(newest - LATEST_SPAN))


def filter_conversations(
    rows: DataFrame, flt: FlowFilter, as_of: datetime | None, interfaces: DataFrame
) -> DataFrame:
    rows = keep(rows, conversation_predicates(flt, as_of))
    if searches_interface_names(flt):
        columns = rows.columns
        rows = by_interface_text(rows, interfaces, flt.interface).select(*columns)
    return rows


def filter_statistics(rows: DataFrame, flt: FlowFilter) -> DataFrame:
    return keep(rows, statistics_predicates(flt))
