"""Time the headline aggregations and reports; prints one JSON line.

Environment: BENCH_SF_DIR (input), BENCH_CPUS (local cores), BENCH_FANOUT
(copies of every flow, for larger runs), BENCH_RUNS (warm runs per query).

Aggregations read flows. Reports read the table store that a timed ingest
fills first, which is how they run in production.
"""

from __future__ import annotations

import json
import os
import statistics as stat
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from flowtide.operators import condense, rollups  # noqa: E402
from flowtide.operators.filters import FlowFilter  # noqa: E402
from flowtide.plans import conversations, dashboard, flows, statistics  # noqa: E402
from flowtide.session import build_session, scratch_dir  # noqa: E402
from flowtide.sources.store import TableStore  # noqa: E402
from flowtide.streaming import ingest  # noqa: E402
from flowtide.workload.adapter import inputs  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FANOUT = int(os.environ.get("BENCH_FANOUT", "1"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def consume(rows) -> None:
    rows.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    source = inputs(spark, SF_DIR)
    scratch = scratch_dir(spark, "bench")
    # The flow table as a table: the adapter's arithmetic is not what is measured.
    rows = source.flows
    if FANOUT > 1:
        copies = F.explode(F.sequence(F.lit(0), F.lit(FANOUT - 1)))
        rows = rows.withColumn("copy", copies).withColumn(
            "seq", F.col("seq") * FANOUT + F.col("copy")
        ).drop("copy")
    rows.repartition(int(CPUS)).write.parquet(f"{scratch}/flows")
    table = spark.read.schema(rows.schema).parquet(f"{scratch}/flows")
    as_of, count = source.as_of, table.count()

    store = TableStore(spark, f"{scratch}/tables")
    # The first ingest compiles everything; replaying the batch replaces its own output.
    ingest.ingest_flows(store, table, 0)
    results = {"ingest_all_tables": timed(lambda: ingest.ingest_flows(store, table, 0))}
    store.write_dimension("exporters", source.exporters)
    store.write_dimension("interfaces", source.interfaces)
    store.write_dimension("port_descriptions", source.port_descriptions)

    day, src = FlowFilter(hours=24), FlowFilter(hours=24, src="10.0.1.2")
    queries = {
        "agg_conversations_5m": lambda: condense.conversations_5m(table),
        "agg_stats_5m": lambda: rollups.statistics_5m(table),
        **{f"agg_{n}": lambda n=n: rollups.roll_up(table, n) for n in rollups.ROLLUP_NAMES},
        "dashboard_summary": lambda: dashboard.summary(store, as_of, 24),
        "top_src": lambda: dashboard.top(store, "src", as_of, 24),
        "top_app": lambda: dashboard.top(store, "app", as_of, 24),
        "top_interfaces": lambda: dashboard.top_interfaces(store, as_of, 24),
        "device_timeseries": lambda: dashboard.device_timeseries(store, as_of, 24),
        "traffic_timeseries": lambda: dashboard.traffic_timeseries(store, as_of, 24),
        "latest_conversations": lambda: flows.latest(store),
        "flows_list": lambda: flows.listing(store, day, as_of, sort="bytes", limit=100),
        "flows_count": lambda: flows.count(store, day, as_of),
        "flows_summary_pair": lambda: flows.summary(store, day, as_of, limit=100),
        "flows_summary_source": lambda: flows.summary(store, src, as_of, limit=100),
        "flows_series": lambda: flows.series(store, day, as_of),
        "conversations_ip": lambda: conversations.by_ip(store, day, as_of, limit=100),
        "conversations_interface": lambda: conversations.by_interface(store, day, as_of, limit=100),
        "stats_flows": lambda: statistics.listing(store, FlowFilter(), limit=100),
        "stats_conversations_ip": lambda: statistics.conversations_by_ip(store, FlowFilter(), limit=100),
    }
    for name, build in queries.items():
        consume(build())
        results[name] = stat.median(timed(lambda: consume(build())) for _ in range(RUNS))

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": {name: round(sec, 3) for name, sec in results.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "flows": count,
                "fanout": FANOUT,
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
