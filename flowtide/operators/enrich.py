"""Left joins of facts or aggregates to the small naming tables.

No broadcast is forced here: the naming tables grow with the network, so Spark
decides from their size (statistics first, measured size under AQE) whether to
broadcast them. Callers aggregate or cut to a page before joining, which keeps
the fact side small when a naming table is too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions import labels

NAME_COLUMNS = ("custom_name", "if_name", "if_descr", "if_alias")


def with_exporter(rows: DataFrame, exporters: DataFrame) -> DataFrame:
    """Adds exporter_host and exporter_custom_name."""
    names = exporters.select(
        F.col("ip").alias("exporter"),
        F.col("hostname").alias("exporter_host"),
        F.col("custom_name").alias("exporter_custom_name"),
    )
    return rows.join(names, "exporter", "left")


def with_interface(
    rows: DataFrame, interfaces: DataFrame, index: str, prefix: str, absent: int | None = None
) -> DataFrame:
    """Adds <prefix>_custom_name, _if_name, _if_descr, _if_alias for one index column.

    ``absent`` is an index value that stands for "unknown" and matches nothing.
    """
    names = interfaces.select(
        F.col("exporter"),
        F.col("if_index").alias(f"{prefix}_key"),
        *(F.col(name).alias(f"{prefix}_{name}") for name in NAME_COLUMNS),
    )
    key = F.col(index) if absent is None else F.nullif(F.col(index), F.lit(absent))
    return rows.withColumn(f"{prefix}_key", key).join(
        names, ["exporter", f"{prefix}_key"], "left"
    ).drop(f"{prefix}_key")


def interface_label(prefix: str, fallback: Column, bare_fallback: Column | None = None) -> Column:
    return labels.interface_label(
        *(F.col(f"{prefix}_{name}") for name in NAME_COLUMNS), fallback, bare_fallback
    )


def with_both_interfaces(
    rows: DataFrame, interfaces: DataFrame, absent: int | None = None
) -> DataFrame:
    rows = with_interface(rows, interfaces, "in_if", "inside", absent)
    return with_interface(rows, interfaces, "out_if", "outside", absent)


def listing_label(prefix: str, index: Column) -> Column:
    """Label in listings: NULL for an interface nothing is known about."""
    return interface_label(prefix, labels.if_index_text(index), F.lit(None).cast("string"))


def with_port_description(rows: DataFrame, descriptions: DataFrame) -> DataFrame:
    return rows.join(descriptions.select("proto", "port", "description"), ["proto", "port"], "left")
