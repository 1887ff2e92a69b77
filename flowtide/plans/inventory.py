"""Exporters, interfaces, service names and address names."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.catalogs import SERVICE_NAMES
from flowtide.functions import ip, labels, proto
from flowtide.operators.filters import instant, same_host

IDLE_AFTER = timedelta(minutes=5)
DNS_FRESH = timedelta(hours=24)


def exporters_list(tables, as_of: datetime) -> DataFrame:
    """Every exporter with its traffic over all history and its interface count."""
    traffic = tables.rollup("exporter_1m").groupBy("exporter").agg(
        F.sum("flows").cast("long").alias("flows"), F.sum("bytes").cast("long").alias("bytes")
    )
    configured = tables.interfaces.groupBy("exporter").agg(F.count(F.lit(1)).alias("interfaces"))
    rows = (
        exporter_detail(tables, as_of)
        .join(traffic, "exporter", "left")
        .join(configured, "exporter", "left")
    )
    counters = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("flows", "bytes", "interfaces")}
    return rows.withColumns(counters).orderBy(ip.inet_sort_key(F.col("exporter")))


def exporter_detail(tables, as_of: datetime, exporter: str | None = None) -> DataFrame:
    """Naming and activity of one exporter, or of all of them."""
    rows = tables.exporters.select(
        F.col("ip").alias("exporter"),
        "hostname",
        "custom_name",
        labels.display_name(F.col("custom_name"), F.col("hostname"), F.col("ip")).alias(
            "display_name"
        ),
        "sys_descr",
        "first_seen",
        "last_seen",
        (F.col("last_seen") >= instant(as_of - IDLE_AFTER)).alias("active"),
    )
    return rows.filter(same_host(F.col("exporter"), exporter)) if exporter else rows


INTERFACE_COLUMNS = [
    "if_name", "if_descr", "if_alias", "custom_name", "if_speed", "admin_status",
    "oper_status", "updated_at",
]


def exporter_interfaces(tables, exporter: str) -> DataFrame:
    """Configured interfaces of one exporter."""
    return (
        tables.interfaces.filter(same_host(F.col("exporter"), exporter))
        .select("if_index", *INTERFACE_COLUMNS)
        .orderBy("if_index")
    )


def interface_inventory(tables, exporter: str | None = None) -> DataFrame:
    """Interfaces seen in traffic or configured, with whatever is known of them."""
    keys = ["exporter", "if_index"]
    observed = tables.rollup("interface_1m").select(*keys)
    known = tables.interfaces.select(*keys)
    if exporter:
        observed = observed.filter(same_host(F.col("exporter"), exporter))
        known = known.filter(same_host(F.col("exporter"), exporter))
    # Reduced before the union, so only distinct keys meet in the second step.
    every = observed.distinct().unionByName(known).distinct()
    devices = tables.exporters.select(
        F.col("ip").alias("exporter"), "hostname", F.col("custom_name").alias("exporter_name")
    )
    rows = every.join(tables.interfaces, keys, "left").join(devices, "exporter", "left")
    shown = labels.display_name(F.col("exporter_name"), F.col("hostname"), F.col("exporter"))
    out = rows.withColumn("display_name", shown).select(
        "exporter", "hostname", F.col("exporter_name").alias("exporter_custom_name"),
        "display_name", "if_index", *INTERFACE_COLUMNS,
    )
    return out.orderBy("if_index") if exporter else out.orderBy("display_name", "if_index")


def builtin_services(spark: SparkSession) -> DataFrame:
    rows = [(p, port, name) for (p, port), name in sorted(SERVICE_NAMES.items())]
    return spark.createDataFrame(rows, "proto int, port int, service string")


def service_labels(tables, spark: SparkSession) -> DataFrame:
    """The effective catalogue: built-in names overridden by custom descriptions."""
    custom = tables.port_descriptions.select("proto", "port", "description")
    return (
        builtin_services(spark)
        .join(custom, ["proto", "port"], "full")
        .select("proto", "port", F.coalesce("description", "service").alias("description"))
        .orderBy("proto", "port")
    )


def port_descriptions(tables) -> DataFrame:
    name = proto.protocol_name(F.col("proto"))
    return tables.port_descriptions.select(
        "proto", "port", "description", name.alias("protocol"),
        proto.custom_label(F.col("description"), F.col("proto"), F.col("port")).alias("label"),
    ).orderBy("proto", "port")


def ip_names(tables) -> DataFrame:
    return tables.ip_names.orderBy(ip.inet_sort_key(F.col("ip")))


def label_addresses(
    requested: DataFrame, tables, as_of: datetime, resolution: bool = True
) -> DataFrame:
    """Names of addresses (column ``ip``): a manual name, else a fresh cached
    host name of a global address. Addresses without a name are left out."""
    manual = tables.ip_names.select("ip", "name")
    cached = (
        tables.dns_cache.filter(F.col("resolved_at") > instant(as_of - DNS_FRESH))
        .filter(ip.is_global(F.col("ip")))
        .select("ip", labels.filled(F.col("hostname")).alias("hostname"))
    )
    rows = requested.select("ip").distinct().join(manual, "ip", "left").join(cached, "ip", "left")
    dns = F.col("hostname") if resolution else F.lit(None).cast("string")
    return (
        rows.withColumn("label", F.coalesce("name", dns))
        .filter(F.col("label").isNotNull())
        .select(
            "ip",
            F.col("label").alias("name"),
            F.when(F.col("name").isNotNull(), F.lit("manual")).otherwise(F.lit("dns")).alias(
                "source"
            ),
            F.concat("label", F.lit(" ("), "ip", F.lit(")")).alias("text"),
        )
    )


def ip_labels(
    spark: SparkSession, tables, ips: str, as_of: datetime, resolution: bool = True
) -> DataFrame:
    """Labels for a comma-separated request, all of its parts."""
    wanted = [ip.as_bare_address(part) for part in ips.split(",")]
    rows = [(address,) for address in dict.fromkeys(a for a in wanted if a)]
    return label_addresses(spark.createDataFrame(rows, "ip string"), tables, as_of, resolution)
