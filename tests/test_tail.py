import json
import os

import pytest
from pyspark.errors.exceptions.base import PySparkException

from flowtide.sources import files, tail
from flowtide.sources.store import TableStore
from flowtide.streaming import ingest


def line(n, size=0):
    return json.dumps({"proto": "udp", "bytes": n, "dst_port": 53, "sampler_address": "192.0.2.1", "pad": "x" * size}) + "\n"


class Tailed:
    def __init__(self, spark, tmp_path):
        self.spark, self.folder, self.checkpoint = spark, tmp_path / "in", str(tmp_path / "cp")
        self.folder.mkdir()
        self.store = TableStore(spark, str(tmp_path / "tables"))

    def append(self, text, name="flows.jsonl"):
        with open(self.folder / name, "a") as f:
            f.write(text)

    def run(self, max_bytes=10**6, **options):
        ingest.start_tail(self.spark, str(self.folder), self.store, self.checkpoint, max_bytes, True, **options)
        totals = self.store.conversations().selectExpr("sum(bytes) AS bytes", "sum(flow_count) AS flows").first()
        return totals.bytes or 0, totals.flows or 0

    def batches(self):
        return [r["count"] for r in self.store.partials("batch_log").orderBy("batch").collect()]

    def lose_last_commit(self):
        last = max(int(n) for n in os.listdir(f"{self.checkpoint}/commits") if n.isdigit())
        for name in (f"{last}", f".{last}.crc"):
            files.drop(self.spark, f"{self.checkpoint}/commits/{name}")


@pytest.fixture
def tailed(spark, tmp_path):
    return Tailed(spark, tmp_path)


def test_appended_rows_half_lines_replay_and_truncation(tailed):
    tailed.append(line(1) + line(2)[:20])
    assert tailed.run() == (1, 1)
    tailed.append(line(2)[20:] + line(3))
    assert tailed.run() == (6, 3)
    assert tailed.run() == (6, 3)
    tailed.lose_last_commit()
    assert tailed.run() == (6, 3) and tailed.batches() == [1, 2]
    (tailed.folder / "flows.jsonl").write_text(line(10))  # shorter than what was read
    assert tailed.run() == (16, 4)
    (tailed.folder / "flows.jsonl").write_text(line(20, 50) + line(30) + line(40))  # longer, but another beginning
    assert tailed.run() == (106, 7)


def test_moved_file_goes_on(tailed):
    tailed.append(line(1) + line(2))
    tailed.run()
    tailed.append(line(3))
    os.rename(tailed.folder / "flows.jsonl", tailed.folder / "flows.jsonl.rotated")
    tailed.append(line(4))
    tailed.append(line(5), "other.jsonl")
    assert tailed.run() == (15, 5)
    os.remove(tailed.folder / "flows.jsonl.rotated")
    tailed.append(line(6))
    assert tailed.run() == (21, 6)


def test_backlog_in_bounded_batches(tailed):
    size = len(line(100, 30))
    tailed.append("".join(line(100 + n, 30) for n in range(20)))
    tailed.append("".join(line(200 + n, 30) for n in range(10)), "second.jsonl")
    # Splits that end anywhere within a line lose and repeat nothing.
    assert tailed.run(12 * size + 7, splitbytes="100") == (sum(range(100, 120)) + sum(range(200, 210)), 30)
    assert max(tailed.batches()) <= 12 and sum(tailed.batches()) == 30
    tailed.append(line(7, 5000) + line(8))  # a line longer than a batch comes alone
    assert tailed.run(1000)[1] == 32


def test_planned_bytes_that_are_gone(tailed):
    tailed.append(line(1))
    tailed.run()
    tailed.append(line(2))
    tailed.run()
    tailed.lose_last_commit()
    (tailed.folder / "flows.jsonl").write_text("")
    with pytest.raises(PySparkException, match="are gone"):
        tailed.run()
    assert tailed.run(skiplost="true")[1] in (1, 2)


def test_line_borders(tmp_path):
    (tmp_path / "f").write_bytes(b"ab\n\ncdef\ngh")
    folder = tail.Folder(str(tmp_path))
    with folder.open("f") as f:
        assert [tail.line_start(f, k, 11) for k in range(11)] == [0, 3, 3, 3, 4, 9, 9, 9, 9, 9, 11]
        assert [tail.line_end(f, 0, k, 11) for k in range(1, 12)] == [3, 3, 3, 4, 4, 4, 4, 4, 9, 9, 9]
        assert tail.line_end(f, 9, 11, 11) == 9


def test_progress_tells_what_is_unread(tailed):
    from flowtide.streaming import progress

    tailed.append(line(1) + line(2))
    entry = {"name": "flows.jsonl", "p": len(line(1)), "h": 0, "n": 0, "t": 0}
    noted = progress.Progress(tailed.store, str(tailed.folder))
    assert noted.behind(json.dumps({"files": {"flows.jsonl#0": entry}})) == len(line(2))
    assert noted.behind(json.dumps({"files": {}})) == len(line(1) + line(2))
    assert noted.behind(None) is None and noted.behind("{}") is None
