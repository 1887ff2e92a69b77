"""Flow records and naming tables derived from the given tables.

One text serves both engines, so the Spark queries and their SQL twins see the
same rows. ``{S}`` is the engine's text type.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import schemas
from flowtide.session import prepare
from flowtide.sources.derived import DerivedTables

FLOWS_SQL = """
SELECT event_id AS seq,
  TIMESTAMP '2024-01-01 00:00:00' + event_id * INTERVAL '5' SECOND AS received_at,
  TIMESTAMP '2024-01-01 00:00:00' + event_id * INTERVAL '5' SECOND - INTERVAL '30' SECOND AS flow_time,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('192.0.2.', CAST(1 + t % 3 AS {S})) END AS exporter,
  CASE WHEN event_id % 2 = 0 THEN 'NETFLOW_V9' ELSE 'IPFIX' END AS flow_type,
  CASE WHEN event_id % 101 = 0 THEN NULL WHEN t = 20 THEN '2001:db8::1'
       ELSE concat('10.0.', CAST(t % 4 AS {S}), '.', CAST(1 + t % 6 AS {S})) END AS src_addr,
  concat('198.51.100.', CAST(1 + t % 8 AS {S})) AS dst_addr,
  CAST(CASE WHEN t = 14 THEN 9200 WHEN t = 15 THEN 179
       WHEN t % 8 = 2 AND event_id % 59 = 0 THEN 0
       WHEN t % 8 = 1 THEN 443 WHEN t % 8 = 3 THEN 0 WHEN t % 8 = 4 THEN 45000
       WHEN t % 8 = 5 THEN 53 WHEN t % 8 = 7 THEN 30000
       ELSE 32768 + (event_id * 131) % 28000 END AS INT) AS src_port,
  CAST(CASE WHEN t = 14 THEN 32768 + (event_id * 131) % 28000 WHEN t = 15 THEN 30000
       WHEN t % 8 = 0 AND event_id % 53 = 0 THEN 0
       WHEN t % 8 = 0 THEN 443 WHEN t % 8 = 1 THEN 32768 + (event_id * 131) % 28000
       WHEN t % 8 = 2 THEN 53 WHEN t % 8 = 3 THEN 0 WHEN t % 8 = 4 THEN 50000 + t
       WHEN t % 8 = 5 THEN 53 WHEN t % 8 = 6 THEN 9200 ELSE 179 END AS INT) AS dst_port,
  CAST(CASE t % 8 WHEN 2 THEN 17 WHEN 3 THEN 1 WHEN 5 THEN 17 ELSE 6 END AS INT) AS proto,
  CAST(round(value * 100) AS BIGINT) AS bytes,
  1 + event_id % 20 AS packets,
  CAST(1 + t % 3 AS INT) AS in_if,
  CAST(CASE WHEN event_id % 13 = 0 THEN NULL ELSE 1 + (t * 5) % 4 END AS INT) AS out_if,
  CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE 64500 + event_id % 7 END AS BIGINT) AS src_as,
  CAST(64600 + event_id % 3 AS BIGINT) AS dst_as,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'LT' ELSE 'DE' END AS src_country,
  CASE WHEN event_id % 3 = 0 THEN 'US' END AS dst_country,
  CAST(1000 AS INT) AS sampling_rate,
  CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 64 END AS INT) AS tcp_flags
FROM (SELECT *, (event_id * 7) % 24 AS t FROM events) e
"""

EXPORTERS_SQL = """
SELECT '192.0.' || CAST(2 + CAST(floor(s_suppkey / 250) AS INT) AS {S}) || '.' || CAST(1 + s_suppkey % 250 AS {S}) AS ip,
       s_name AS hostname, CASE WHEN s_suppkey = 1 THEN 'core-router' END AS custom_name
FROM supplier
"""

INTERFACES_SQL = """
SELECT '192.0.2.' || CAST(1 + n_nationkey % 3 AS {S}) AS exporter,
       CAST(1 + floor(n_nationkey / 3) AS INT) AS if_index,
       CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'ether' || CAST(n_nationkey AS {S}) END AS if_name,
       n_name AS if_descr,
       CASE WHEN n_nationkey % 5 = 0 THEN 'uplink-' || CAST(n_regionkey AS {S}) END AS if_alias,
       CASE WHEN n_nationkey = 5 THEN 'edge-port' END AS custom_name
FROM nation
"""

IP_NAMES_SQL = """
SELECT '198.51.' || CAST(100 + CAST(floor(c_custkey / 250) AS INT) AS {S}) || '.' || CAST(1 + c_custkey % 250 AS {S}) AS ip,
       c_name AS name
FROM customer
"""

DNS_CACHE_SQL = """
SELECT CASE WHEN p_partkey % 3 = 0 THEN '10.0.' || CAST(p_partkey % 4 AS {S}) || '.' || CAST(1 + p_partkey % 6 AS {S})
            ELSE '8.8.' || CAST(floor(p_partkey / 250) AS INT) || '.' || CAST(p_partkey % 250 AS {S}) END AS ip,
       max(CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'host-' || CAST(p_size AS {S}) || '.example' END) AS hostname,
       min(p_partkey % 40) AS age_hours
FROM part GROUP BY 1
"""

PORT_DESCRIPTIONS_SQL = """
SELECT CAST(CASE WHEN p_partkey % 4 = 1 THEN 17 ELSE 6 END AS INT) AS proto,
       CAST(1 + (p_partkey + 65534) % 65535 AS INT) AS port, max(p_brand) AS description
FROM part GROUP BY 1, 2
"""

EPOCH = datetime(2024, 1, 1)


def _run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A statement over named DataFrames, without registering anything."""
    text = sql.replace("{S}", "STRING")
    for name in tables:
        text = text.replace(f"FROM {name}", "FROM {" + name + "}")
    return spark.sql(text, **tables)


def _shaped(rows: DataFrame, schema) -> DataFrame:
    """All declared columns, those the rows lack as NULL."""
    return rows.select(
        *(
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        )
    )


@dataclass(frozen=True)
class Inputs:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        """A given table; its schema is read from the file footers."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def flows(self) -> DataFrame:
        return _shaped(_run(self.spark, FLOWS_SQL, events=self.table("events")), schemas.FLOWS)

    @cached_property
    def exporters(self) -> DataFrame:
        rows = _run(self.spark, EXPORTERS_SQL, supplier=self.table("supplier"))
        stamp = (EPOCH - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        last = (self.as_of - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        idle = F.when(F.col("ip") == "192.0.2.3", F.lit(last - 600_000_000)).otherwise(F.lit(last))
        seen = {
            "first_seen": F.timestamp_micros(F.lit(stamp)),
            "last_seen": F.timestamp_micros(idle),
        }
        return _shaped(rows.withColumns(seen), schemas.EXPORTERS)

    @cached_property
    def interfaces(self) -> DataFrame:
        rows = _run(self.spark, INTERFACES_SQL, nation=self.table("nation"))
        return _shaped(rows, schemas.INTERFACES)

    @cached_property
    def ip_names(self) -> DataFrame:
        rows = _run(self.spark, IP_NAMES_SQL, customer=self.table("customer"))
        return _shaped(rows, schemas.IP_NAMES)

    @cached_property
    def dns_cache(self) -> DataFrame:
        rows = _run(self.spark, DNS_CACHE_SQL, part=self.table("part"))
        last = (self.as_of - datetime(1970, 1, 1)) // timedelta(seconds=1)
        at = F.timestamp_seconds(F.lit(last) - F.col("age_hours") * 3600)
        return _shaped(rows.withColumn("resolved_at", at), schemas.DNS_CACHE)

    @cached_property
    def port_descriptions(self) -> DataFrame:
        rows = _run(self.spark, PORT_DESCRIPTIONS_SQL, part=self.table("part"))
        return _shaped(rows, schemas.PORT_DESCRIPTIONS)

    @cached_property
    def as_of(self) -> datetime:
        """The clock of the workload: arrival of the last flow (one row is fetched)."""
        last = self.table("events").agg(F.max("event_id")).first()[0]
        return EPOCH + timedelta(seconds=5 * last)

    def tables(self) -> DerivedTables:
        as_of = self.as_of
        newest = as_of - timedelta(
            minutes=as_of.minute % 5, seconds=as_of.second, microseconds=as_of.microsecond
        )
        return DerivedTables(self, newest)


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(prepare(spark), sf_dir)
