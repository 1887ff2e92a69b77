"""Raw flows kept in one Parquet partition per UTC day of arrival."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.operators.filters import instant, utc
from flowtide.schemas import FLOWS
from flowtide.sources import files


def write_daily(flows: DataFrame, path: str, mode: str = "append") -> None:
    flows.select(*FLOWS.names, F.to_date("received_at").alias("d")).write.mode(mode).partitionBy(
        "d"
    ).parquet(path)


def read_daily(spark: SparkSession, path: str, since: date | None = None) -> DataFrame:
    schema = T.StructType([*FLOWS.fields, T.StructField("d", T.DateType())])
    rows = spark.read.schema(schema).parquet(path)
    return rows.filter(F.col("d") >= F.lit(since)) if since else rows


def drop_expired(spark: SparkSession, path: str, staging: str, as_of: datetime, hours: int) -> None:
    """Drop days that end at or before the cutoff, then the rest of the cutoff day."""
    cutoff = utc(as_of) - timedelta(hours=max(1, int(hours)))
    days = [date.fromisoformat(n[2:]) for n in files.subdirs(spark, path, "d=")]
    for day in days:
        end = utc(datetime.combine(day + timedelta(days=1), time()))
        if end <= cutoff:
            files.drop(spark, f"{path}/d={day}")
    edge = cutoff.date()
    if edge not in days:
        return
    kept = read_daily(spark, path).filter(
        (F.col("d") == F.lit(edge)) & (F.col("received_at") >= instant(cutoff))
    )
    staged = f"{staging}/raw-{edge}"
    kept.write.mode("overwrite").partitionBy("d").parquet(staged)
    files.swap(spark, staged, path, [f"d={edge}"], files.subdirs(spark, staged, "d="))
