"""One-minute rollups and five-minute statistics.

Each aggregation reads either flows or condensed rows: both carry ``bytes``
and ``packets``; a condensed row stands for ``flow_count`` flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.functions import buckets
from flowtide.operators.condense import with_service
from flowtide.schemas import ROLLUP_KEYS, ROLLUPS, SKETCHED, SKETCHES, STATISTICS

MEASURES = ["bytes", "packets", "flows"]
STATS_KEY = [f.name for f in STATISTICS if f.name not in MEASURES]
ROLLUP_NAMES = list(ROLLUPS)


def _sums(flow_count: Column) -> list[Column]:
    return [
        F.sum("bytes").alias("bytes"),
        F.sum("packets").alias("packets"),
        F.sum(flow_count).cast("long").alias("flows"),
    ]


def _source(rows: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Input with the service columns, its arrival time and its flow count."""
    if "flow_count" in rows.columns:
        return rows, F.col("slot"), F.col("flow_count")
    return with_service(rows), F.col("received_at"), F.lit(1)


def _present(*names: str) -> Column:
    kept = F.lit(True)
    for name in names:
        kept = kept & F.col(name).isNotNull()
    return kept


def roll_up(rows: DataFrame, name: str) -> DataFrame:
    """The rollup ``name`` of flows or minute-condensed rows."""
    source, at, count = _source(rows)
    keys = [key for key, _ in ROLLUP_KEYS[name]]
    if name == "interface_1m":
        return _interface_rollup(source, buckets.minute(at), count)
    if name == "app_1m":
        source = source.withColumn("port", F.col("service_port"))
    out = (
        source.filter(_present(*keys))
        .withColumn("bucket", buckets.minute(at))
        .groupBy("bucket", *keys)
        .agg(*_sums(count))
    )
    return out.select(*ROLLUPS[name].names)


def _interface_rollup(source: DataFrame, bucket: Column, count: Column) -> DataFrame:
    # Sum per interface pair first, so that only sums are spread over the two
    # ends; a flow that enters and leaves by one interface counts once.
    pairs = (
        source.filter(_present("exporter"))
        .withColumn("bucket", bucket)
        .groupBy("bucket", "exporter", "in_if", "out_if")
        .agg(*_sums(count))
    )
    ends = F.array_distinct(F.array_compact(F.array("in_if", "out_if")))
    return (
        pairs.withColumn("if_index", F.explode(ends))
        .groupBy("bucket", "exporter", "if_index")
        .agg(*_sums(F.col("flows")))
        .select(*ROLLUPS["interface_1m"].names)
    )


def statistics_5m(rows: DataFrame) -> DataFrame:
    """Compact history rows; flows lacking an address, exporter or protocol have none."""
    source, at, count = _source(rows)
    out = (
        source.filter(_present("exporter", "src_addr", "dst_addr", "proto"))
        .withColumns(
            {
                "bucket_start": buckets.five_minutes(at),
                "service_port": F.coalesce("service_port", F.lit(0)),
                "service_side": F.coalesce("service_side", F.lit("")),
                "in_if": F.coalesce("in_if", F.lit(0)),
                "out_if": F.coalesce("out_if", F.lit(0)),
            }
        )
        .groupBy(*STATS_KEY)
        .agg(*_sums(count))
    )
    return out.select(*STATISTICS.names)


def merge_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key from rows stored by several batches."""
    return rows.groupBy(*keys).agg(*_sums(F.col("flows"))).select(*keys, *MEASURES)


def rollup_key(name: str) -> list[str]:
    return ["bucket", *(key for key, _ in ROLLUP_KEYS[name])]


# Registers of a sketch as a power of two: standard error 1.04 / 2 ** 7 = 0.8 %.
SKETCH_SIZE = 14


def sketches_1m(rows: DataFrame) -> DataFrame:
    """Sketches of the distinct exporters, sources and destinations of each minute.

    The keys of a minute are told apart first, so that a key is sketched once
    per minute and task and the sketches stay out of the wide aggregation.
    """
    source, at, _ = _source(rows)
    keys = [SKETCHED[name][1] for name in SKETCHES.names[1:]]
    seen = source.select(buckets.minute(at).alias("bucket"), *keys)
    sketches = [F.hll_sketch_agg(key, SKETCH_SIZE).alias(name) for name, key in zip(SKETCHES.names[1:], keys)]
    return seen.distinct().groupBy("bucket").agg(*sketches).select(*SKETCHES.names)


def _united(name: str) -> Column:
    """Union of sketches; none of none, since an empty union would have registers of another number."""
    return F.when(F.count(name) > 0, F.hll_union_agg(name)).alias(name)


def sketches_of(parts: dict[str, DataFrame], *keys: str) -> DataFrame:
    """The same from stored rollups, by their bucket and further keys."""
    out = None
    for name in SKETCHES.names[1:]:
        rollup, key = SKETCHED[name]
        one = parts[rollup].groupBy("bucket", *keys).agg(F.hll_sketch_agg(key, SKETCH_SIZE).alias(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.groupBy("bucket", *keys).agg(*map(_united, SKETCHES.names[1:]))


def merge_sketches(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(*map(_united, SKETCHES.names[1:])).select(*SKETCHES.names)


def coarsened(rows: DataFrame, name: str, seconds: int) -> DataFrame:
    """Rollup or sketch rows in longer buckets, with the first and last bucket of each sum."""
    first, last = (F.col(c) if c in rows.columns else F.col("bucket") for c in ("first", "last"))
    spans = [F.min(first).alias("first"), F.max(last).alias("last")]
    keys = [] if name == "distinct_1m" else [key for key, _ in ROLLUP_KEYS[name]]
    sums = [*map(_united, SKETCHES.names[1:])] if name == "distinct_1m" else _sums(F.col("flows"))
    return rows.groupBy(buckets.floor_to(F.col("bucket"), seconds).alias("bucket"), *keys).agg(*sums, *spans)


def heaviest(rows: DataFrame, name: str, most: int) -> DataFrame:
    """The ``most`` heaviest rows of each day ``d``, ties to smaller keys.

    A day with a negative sum has none: what its list leaves out could lower
    a sum, and readers take a list as a lower bound.
    """
    order = Window.partitionBy("d").orderBy(F.desc("bytes"), *(key for key, _ in ROLLUP_KEYS[name]))
    sound = rows.groupBy("d").agg(F.min("bytes").alias("least")).filter(F.col("least") >= 0).select("d")
    best = rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= most).drop("_place")
    return best.join(sound, "d", "left_semi")
