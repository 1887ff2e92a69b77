"""A backlog of growing files is worked off batch after batch."""

import json
import time

from pyspark.sql import functions as F

from flowtide.sources.store import TableStore
from flowtide.streaming import ingest


def test_a_drained_backlog_does_not_wait_between_batches(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps({"src_addr": f"10.0.0.{n}", "proto": "udp", "bytes": n, "dst_port": 53}) for n in range(1, 10)]
    (folder / "a.jsonl").write_text("".join(f"{line}\n" for line in lines))
    monkeypatch.setattr(ingest, "TRIGGER", "100 seconds")
    store, began = TableStore(spark, str(tmp_path / "tables")), time.time()
    ingest.start_tail(spark, str(folder), store, str(tmp_path / "cp"), max_bytes=250, drain=True)
    assert time.time() - began < 100
    assert len(store.written_days("batch_log", 1)) == 1  # more than one batch
    assert store.conversations().agg(F.sum("flow_count"), F.sum("bytes")).first() == (9, 45)
