"""Time buckets. All are aligned to the epoch, which equals UTC wall time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def floor_to(ts: Column, seconds: int) -> Column:
    """Start of the bucket of that many seconds; plain arithmetic, no time zone."""
    width = seconds * MICROS
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width)))


def five_minutes_sql(ts: str) -> str:
    """``five_minutes`` as text."""
    width = 300 * MICROS
    return f"timestamp_micros(unix_micros({ts}) - pmod(unix_micros({ts}), {width}L))"


def minute(ts: Column) -> Column:
    return floor_to(ts, 60)


def five_minutes(ts: Column) -> Column:
    return floor_to(ts, 300)


def ten_minutes(ts: Column) -> Column:
    return floor_to(ts, 600)


def hour(ts: Column) -> Column:
    return floor_to(ts, 3600)


def nanos_to_timestamp(nanos: Column) -> Column:
    """Nanoseconds since the epoch; zero and below mean unknown."""
    known = F.nullif(F.greatest(nanos, F.lit(0)), F.lit(0))
    return F.timestamp_micros(F.call_function("div", known, F.lit(1000).cast("long")))
