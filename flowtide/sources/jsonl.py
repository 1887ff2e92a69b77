"""JSON-lines flow records: scan, malformed-record split, normalisation."""

from __future__ import annotations

from functools import lru_cache

from py4j.java_gateway import JavaGateway
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions import ip, variants
from flowtide.schemas import FLOWS

ADDRESSES = {"exporter": "sampler_address", "src_addr": "src_addr", "dst_addr": "dst_addr"}

# A record arrives when its file does. Unlike the clock at read time this is
# the same again when a batch is replayed or a lost task is run once more.
LANDED_AT = "_metadata.file_modification_time"


def _with_landing_time(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.col(LANDED_AT).alias("received_at"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files under a path, bad ones included, with their landing time."""
    return _with_landing_time(spark.read.text(path))


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _with_landing_time(reader.load(path))


def parse(lines: DataFrame) -> DataFrame:
    """Adds ``record`` (VARIANT) and ``is_record``; keeps the line itself."""
    parsed = lines.withColumn("record", F.try_parse_json("value"))
    return parsed.withColumn("is_record", variants.is_object(F.col("record")))


def _normalized(record: Column) -> dict[str, Column]:
    """The declared flow columns of one JSON object, addresses excepted."""
    def number(field: str) -> Column:
        return variants.int_field(record, field, FLOWS[field].dataType.simpleString())

    return {
        "flow_time": variants.flow_time_field(record, "time_flow_start_ns", "time_received_ns"),
        "flow_type": variants.flow_type_field(record),
        "src_port": number("src_port"),
        "dst_port": number("dst_port"),
        "proto": variants.protocol_field(record),
        "bytes": F.coalesce(number("bytes"), F.lit(0).cast("long")),
        "packets": F.coalesce(number("packets"), F.lit(0).cast("long")),
        "in_if": number("in_if"),
        "out_if": number("out_if"),
        "src_as": number("src_as"),
        "dst_as": number("dst_as"),
        "src_country": variants.text_field(record, "src_country"),
        "dst_country": variants.text_field(record, "dst_country"),
        "sampling_rate": number("sampling_rate"),
        "tcp_flags": number("tcp_flags"),
    }


@lru_cache(maxsize=1)
def _steps(gateway: JavaGateway) -> tuple[dict[str, Column], ...]:
    """The columns ``normalize`` adds, step by step. A stream builds these thousands of calls to the JVM once."""
    record = F.col("record")
    hosts = {
        f"{name}_host": ip.collector_host(variants.text_field(record, field))
        for name, field in ADDRESSES.items()
    }
    addresses = {name: ip.canonical(F.col(f"{name}_host")) for name in ADDRESSES}
    bad = F.lit(False)
    for name in ADDRESSES:
        bad = bad | (F.col(f"{name}_host").isNotNull() & F.col(name).isNull())
    reason = F.when(~F.col("is_record"), "malformed").when(bad, "bad address")
    return hosts, addresses, {"seq": F.monotonically_increasing_id(), "reason": reason, **_normalized(record)}


def normalize(parsed: DataFrame) -> DataFrame:
    """Parsed lines -> flow columns, plus the line and why it is refused, if it is.

    One pass over the lines serves both the flows and the quarantine.
    """
    rows = parsed
    for columns in _steps(parsed.sparkSession.sparkContext._gateway):
        rows = rows.withColumns(columns)
    return rows.select(
        "value", "reason", *(F.col(f.name).cast(f.dataType).alias(f.name) for f in FLOWS)
    )


def good_flows(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reason").isNull()).select(*FLOWS.names)


def quarantine(normalized: DataFrame) -> DataFrame:
    """Lines that are not JSON objects, and records with an impossible address."""
    return normalized.filter(F.col("reason").isNotNull()).select("value", "reason", "received_at")


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flow rows of all valid records under a path."""
    return good_flows(normalize(parse(read_lines(spark, path))))
