"""Named queries, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.workload.adapter import Inputs, inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}
BUILDERS: dict[str, Callable[[Inputs], DataFrame]] = {}


def plain_times(rows: DataFrame) -> DataFrame:
    """UTC instants as zone-less timestamps, the type the given tables use."""
    return rows.select(
        *(
            F.col(name).cast("timestamp_ntz").alias(name) if dtype == "timestamp" else F.col(name)
            for name, dtype in rows.dtypes
        )
    )


def register(name: str, build: Callable[[Inputs], DataFrame], twin: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain_times(build(inputs(spark, sf_dir)))

    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    QUERIES[name] = run
    BUILDERS[name] = build
    if twin is not None:
        TWINS[name] = twin.strip()
