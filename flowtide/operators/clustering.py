"""Row order of folded days, so that a filter on one host or device meets few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOSTS = ("src_addr", "dst_addr", "exporter")
BITS = 16
# Bloom filters of the size their row group needs, at most this.
BLOOM_BYTES = 262_144


def interleaved(columns: tuple[str, ...] = HOSTS, bits: int = BITS) -> Column:
    """One number from the leading hash bits of all columns in turn.

    Rows of one value of any column lie in few stretches of this order. Hashes
    rather than values: addresses crowd in few ranges, their hashes do not, and
    what is looked up is one value, not a range.
    """
    hashes = [F.xxhash64(F.col(c)) for c in columns]
    out = F.lit(0).cast("bigint")
    for bit in range(bits):
        for k, h in enumerate(hashes):
            place = len(columns) * (bits - 1 - bit) + len(columns) - 1 - k
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(h, 63 - bit).bitwiseAND(F.lit(1).cast("bigint")), place))
    return out


def clustered(rows: DataFrame, *first: str, columns: tuple[str, ...] = HOSTS) -> DataFrame:
    """Rows dealt out by range of ``first`` and the interleaved order, sorted within each part."""
    order = interleaved(columns)
    return rows.withColumn("_z", order).repartitionByRange(*first, "_z").sortWithinPartitions(*first, "_z").drop("_z")


def bloom_options(columns: tuple[str, ...] = HOSTS) -> dict[str, str]:
    """Parquet writer options: a Bloom filter per row group and column."""
    return {
        **{f"parquet.bloom.filter.enabled#{c}": "true" for c in columns},
        "parquet.bloom.filter.adaptive.enabled": "true",
        "parquet.bloom.filter.max.bytes": str(BLOOM_BYTES),
    }
