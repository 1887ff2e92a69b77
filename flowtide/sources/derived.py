"""The same tables derived on the fly from a flow table, nothing stored."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.operators import condense, rollups
from flowtide.operators.filters import BUCKET, between

NAMING = ("exporters", "interfaces", "ip_names", "dns_cache", "port_descriptions")


@dataclass(frozen=True)
class DerivedTables:
    """``inputs`` holds the flows and the naming tables as attributes."""

    inputs: object
    newest: datetime

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMING:
            return getattr(self.inputs, name)
        raise AttributeError(name)

    def conversations(
        self, low: datetime | None = None, high: datetime | None = None
    ) -> DataFrame:
        rows = condense.conversations_5m(self.inputs.flows)
        for predicate in between(F.col("bucket_start"), low, high):
            rows = rows.filter(predicate)
        return rows

    def statistics(self, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
        rows = rollups.statistics_5m(self.inputs.flows)
        for predicate in between(F.col("bucket_start"), low, high):
            rows = rows.filter(predicate)
        return rows

    def rollup(
        self, name: str, low: datetime | None = None, high: datetime | None = None
    ) -> DataFrame:
        rows = rollups.roll_up(self.inputs.flows, name)
        for predicate in between(F.col("bucket"), low, high):
            rows = rows.filter(predicate)
        return rows

    def spans(
        self, name: str, low: datetime | None = None, high: datetime | None = None, grain: int = 86_400
    ) -> DataFrame:
        bucket = F.col("bucket")
        return self.rollup(name, low, high).withColumns({"first": bucket, "last": bucket})

    def sketches(self, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
        rows = rollups.sketches_1m(self.inputs.flows)
        for predicate in between(F.col("bucket"), low, high):
            rows = rows.filter(predicate)
        return rows

    def statistics_parts(self, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
        return self.statistics(low, high)

    def conversation_parts(self, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
        return self.conversations(low and low - BUCKET, high)

    def newest_bucket(self) -> datetime:
        return self.newest
