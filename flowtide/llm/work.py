"""Tables that cut a plan: written once to the shared folder and read again."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.session import scratch_dir

WHITE = "\\x20\\x09-\\x0D"
WHITE_CHARS = " \t\n\x0b\x0c\r"
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table below ``spark.checkpoint.dir``.

    A lost executor costs no more than the read of its files, and what made
    the rows runs once, however often they are used.
    """
    path = scratch_dir(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffled data behind; for tables that are stored and read from there.

    Otherwise such files stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def shards(total_bytes: float, each: float = 24e6, least: int = 1) -> int:
    """So many parts that each holds about ``each`` bytes, whatever the total."""
    return max(least, int(total_bytes // each) + 1)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text of all rows; one aggregate, one number."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first().b


def words(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space characters; null counts as empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WHITE}]+"))


def identity(doc_id: Column, text: Column) -> Column:
    """Content hash of a row: rows that differ in id or text get different order keys."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x01"), F.coalesce(text, F.lit(""))))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(taken: Sequence[str], wanted: str) -> str:
    """A column name that none of ``taken`` clashes with."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted
