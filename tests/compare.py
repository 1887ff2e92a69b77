"""Run registered queries next to their SQL twins and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _kind(value) -> str:
    return type(value).__name__


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    out = [tuple(_plain(row[n]) for n in order) for row in rows]
    return [columns[n] for n in order], sorted(out, key=repr)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides agree, otherwise what differs."""
    frame = entry.queries()[name](spark, sf_dir)
    mine = table(frame.columns, frame.collect())
    twin = con.execute(entry.oracle_sql()[name])
    theirs = table([c[0] for c in twin.description], twin.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    if not mine[1]:
        return "both sides are empty"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"{mine[0]}\n  spark {a}\n  duck  {b}"
        if [_kind(x) for x in a] != [_kind(x) for x in b]:
            return f"types {[_kind(x) for x in a]} != {[_kind(x) for x in b]}"
    return None


def main() -> None:
    from flowtide.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    names = [n for n in entry.queries() if not wanted or any(w in n for w in wanted)]
    for name in names:
        began = time.time()
        try:
            problem = difference(spark, con, name, sf_dir)
        except Exception as error:  # report and go on
            lines = [line for line in str(error).splitlines() if line.strip()]
            problem = f"{_kind(error)}: " + " ".join(lines[:3])[:700]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
