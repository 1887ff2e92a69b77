"""Session set-up and the few runtime settings the library relies on."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Every timestamp in the tables is UTC; ANSI mode makes overflows visible
# instead of silently wrapping counters.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Folders of many days are listed by few tasks, not by one task each.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller already owns."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "flowtide", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Call-site capture for error messages costs a stack walk per column.
    quiet = {"spark.python.sql.dataFrameDebugging.enabled": "false"}
    for key, value in {**RUNTIME_CONF, **quiet, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory that all executors can reach, on any master.

    It lies in the folder named by ``spark.checkpoint.dir``, else below the
    warehouse, and never in a folder of one machine's own choosing.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/flowtide-{name}-{uuid.uuid4()}"


def together(spark: SparkSession, jobs: Iterable[Callable[[], None]], most: int = 8) -> None:
    """Submit independent jobs at once, so that their short tails share the cluster."""
    with ThreadPoolExecutor(most) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        for job in started:
            job.result()
