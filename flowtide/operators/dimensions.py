"""Upkeep of the naming tables: exporters seen, edits, interface refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.catalogs import WALK_COLUMNS
from flowtide.functions import walk
from flowtide.functions.ip import normalize_host, strip
from flowtide.functions.labels import filled
from flowtide.schemas import EXPORTERS, INTERFACES


def exporters_seen(rows: DataFrame, first: str = "received_at", last: str = "received_at") -> DataFrame:
    """First and last sighting per exporter of a batch or of a whole table."""
    return (
        rows.filter(F.col("exporter").isNotNull())
        .groupBy(F.col("exporter").alias("ip"))
        .agg(F.min(first).alias("first_seen"), F.max(last).alias("last_seen"))
    )


def merge_exporters(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Known exporters with widened sightings, plus the new ones."""
    new = seen.select("ip", F.col("first_seen").alias("f"), F.col("last_seen").alias("l"))
    return (
        known.join(new, "ip", "full")
        .withColumns(
            {
                "first_seen": F.least("first_seen", "f"),
                "last_seen": F.greatest("last_seen", "l"),
            }
        )
        .select(*EXPORTERS.names)
    )


def latest_edits(edits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last edit per key; ``edit_seq`` orders edits, NULL is a value too."""
    return edits.groupBy(*keys).agg(
        F.max(F.struct(F.col("edit_seq"), F.col(value)))[value].alias(f"new_{value}"),
    )


def _overwrite(known: DataFrame, edits: DataFrame, keys: list[str], value: str, how: str) -> DataFrame:
    changed = latest_edits(edits, keys, value).withColumn("edited", F.lit(True))
    return (
        known.join(changed, keys, how)
        .withColumn(
            value,
            F.when(F.col("edited"), F.col(f"new_{value}")).otherwise(F.col(value)),
        )
        .drop("edited", f"new_{value}")
    )


def _in(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def port_edit_fault() -> Column:
    """Why a port edit is refused; null if it is not."""
    return (
        F.when(~_in(F.col("proto").between(0, 255)), "protocol outside 0..255")
        .when(~_in(F.col("port").between(1, 65535)), "port outside 1..65535")
        .when(~_in(F.length(strip(F.col("description"))).between(1, 100)), "description not of 1 to 100 characters")
    )


def valid_port_edits(edits: DataFrame) -> DataFrame:
    """Port descriptions within the accepted ranges, blanks removed, in requests of any size."""
    return edits.filter(port_edit_fault().isNull()).withColumn("description", strip(F.col("description")))


def refused_port_edits(edits: DataFrame) -> DataFrame:
    """The other edits, each with its ``reason``."""
    return edits.withColumn("reason", port_edit_fault()).filter(F.col("reason").isNotNull())


def apply_port_edits(known: DataFrame, edits: DataFrame) -> DataFrame:
    return _overwrite(known, valid_port_edits(edits), ["proto", "port"], "description", "full")


def delete_port_descriptions(known: DataFrame, removed: DataFrame) -> DataFrame:
    return known.join(removed.select("proto", "port").distinct(), ["proto", "port"], "left_anti")


def apply_exporter_names(known: DataFrame, edits: DataFrame) -> DataFrame:
    """Custom names of known exporters; a blank name removes the name."""
    named = edits.select(
        normalize_host(F.col("ip")).alias("ip"), filled(strip(F.col("name"))).alias("custom_name"),
        "edit_seq",
    )
    return _overwrite(known, named, ["ip"], "custom_name", "left").select(*known.columns)


def apply_interface_names(known: DataFrame, edits: DataFrame) -> DataFrame:
    """Custom names of interfaces; an unknown interface gets a row of its own."""
    named = edits.select(
        normalize_host(F.col("exporter")).alias("exporter"), "if_index",
        filled(strip(F.col("name"))).alias("custom_name"), "edit_seq",
    )
    return _overwrite(known, named, ["exporter", "if_index"], "custom_name", "full").select(
        *known.columns
    )


def apply_ip_names(known: DataFrame, edits: DataFrame) -> DataFrame:
    named = edits.filter(ip_name_fault().isNull()).select(
        normalize_host(F.col("ip")).alias("ip"), strip(F.col("name")).alias("name"), "edit_seq"
    )
    return _overwrite(known, named, ["ip"], "name", "full").select(*known.columns)


def ip_name_fault() -> Column:
    """Why an address name is refused; null if it is not."""
    named = _in(F.length(strip(F.col("name"))).between(1, 100))
    return F.when(~named, "name not of 1 to 100 characters")


def refused_ip_names(edits: DataFrame) -> DataFrame:
    """Edits of address names that are refused, each with its ``reason``."""
    return edits.withColumn("reason", ip_name_fault()).filter(F.col("reason").isNotNull())


def delete_ip_names(known: DataFrame, removed: DataFrame) -> DataFrame:
    keys = removed.select(normalize_host(F.col("ip")).alias("ip")).distinct()
    return known.join(keys, "ip", "left_anti")


def _walk_column(oid: Column) -> Column:
    name = F.lit(None).cast("string")
    for base, column in WALK_COLUMNS.items():
        name = F.when(oid.startswith(base + "."), F.lit(column)).otherwise(name)
    return name


def parse_walk(lines: DataFrame) -> DataFrame:
    """Walk lines (exporter, line_no, line) -> exporter, if_index, attribute, value."""
    parts = F.col("parts")
    return (
        lines.withColumn("parts", walk.line_parts(F.col("line")))
        .filter(parts.isNotNull())
        .select(
            "exporter",
            "line_no",
            parts["index"].alias("if_index"),
            _walk_column(parts["oid"]).alias("attribute"),
            parts["value"].alias("value"),
        )
        .filter(F.col("attribute").isNotNull() & F.col("if_index").isNotNull())
    )


def interfaces_from_walk(lines: DataFrame) -> DataFrame:
    """One row per interface that has a name, description, alias or speed."""
    latest = (
        parse_walk(lines)
        .groupBy("exporter", "if_index")
        .pivot("attribute", list(WALK_COLUMNS.values()))
        .agg(F.max(F.struct("line_no", "value"))["value"])
    )
    indexed = F.col("if_name").isNotNull()
    for column in ("if_descr", "if_alias", "high_speed", "speed"):
        indexed = indexed | F.col(column).isNotNull()
    return latest.filter(indexed).select(
        "exporter",
        "if_index",
        "if_name",
        "if_descr",
        "if_alias",
        walk.speed(F.col("high_speed"), F.col("speed")).alias("if_speed"),
        walk.first_integer(F.col("admin_status")).cast("int").alias("admin_status"),
        walk.first_integer(F.col("oper_status")).cast("int").alias("oper_status"),
    )


def refresh_exporters(known: DataFrame, polls: DataFrame) -> DataFrame:
    """Host name and description of known exporters from polls (ip, hostname, sys_descr)."""
    polled = polls.select(
        normalize_host(F.col("ip")).alias("ip"),
        walk.scalar(F.col("hostname")).alias("new_hostname"),
        walk.scalar(F.col("sys_descr")).alias("new_sys_descr"),
        F.lit(True).alias("polled"),
    )
    names = ("hostname", "sys_descr")
    updates = {n: F.when(F.col("polled"), F.col(f"new_{n}")).otherwise(F.col(n)) for n in names}
    return known.join(polled, "ip", "left").withColumns(updates).select(*known.columns)


def refresh_interfaces(known: DataFrame, lines: DataFrame, polled_at: Column) -> DataFrame:
    """Polled columns are overwritten, custom names and unseen interfaces stay."""
    polled = interfaces_from_walk(lines)
    columns = [c for c in polled.columns if c not in ("exporter", "if_index")]
    renamed = polled.select(
        "exporter", "if_index", *(F.col(c).alias(f"new_{c}") for c in columns),
        F.lit(True).alias("polled"),
    )
    joined = known.join(renamed, ["exporter", "if_index"], "full")
    updates = {
        c: F.when(F.col("polled"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns
    }
    updates["updated_at"] = F.when(F.col("polled"), polled_at).otherwise(F.col("updated_at"))
    return joined.withColumns(updates).select(*INTERFACES.names)
