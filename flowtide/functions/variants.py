"""Fields of a parsed JSON record, read the way the record contract wants them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide.functions.buckets import nanos_to_timestamp
from flowtide.functions.proto import spelled_protocol


def _path(field: str) -> str:
    return f"$.{field}"


def is_object(record: Column) -> Column:
    return F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False))


def text_field(record: Column, field: str) -> Column:
    return F.try_variant_get(record, _path(field), "string")


def int_field(record: Column, field: str, dtype: str = "bigint") -> Column:
    """Integer of a JSON number (truncated), boolean or integer text, else NULL."""
    return F.try_variant_get(record, _path(field), dtype)


def flow_type_field(record: Column, field: str = "type") -> Column:
    """Missing reads as empty text, JSON null as the text ``None``."""
    value = F.try_variant_get(record, _path(field), "variant")
    return (
        F.when(value.isNull(), F.lit(""))
        .when(F.is_variant_null(value), F.lit("None"))
        .otherwise(text_field(record, field))
    )


def protocol_field(record: Column, field: str = "proto") -> Column:
    # Names first: they are the usual case, and reading one as a number is a
    # failed cast, which is slow.
    return F.coalesce(
        spelled_protocol(text_field(record, field)), int_field(record, field, "int")
    )


def _counts_as_absent(record: Column, field: str) -> Column:
    """Missing, null, zero, false, empty text, empty array and empty object."""
    kind = F.coalesce(
        F.schema_of_variant(F.try_variant_get(record, _path(field), "variant")), F.lit("VOID")
    )
    return F.when(
        kind == "STRING", text_field(record, field) == ""
    ).otherwise(
        kind.isin("VOID", "ARRAY<VOID>", "OBJECT<>")
        | (F.coalesce(F.try_variant_get(record, _path(field), "double"), F.lit(1.0)) == 0)
    )


def flow_time_field(record: Column, first: str, second: str) -> Column:
    """Timestamp of the first nanosecond field that holds something."""
    nanos = int_field(record, first)
    nanos = F.when(nanos != 0, nanos).when(
        _counts_as_absent(record, first), int_field(record, second)
    )
    return nanos_to_timestamp(nanos)
