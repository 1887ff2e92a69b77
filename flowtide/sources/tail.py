"""A stream of the lines appended to growing files.

The position in a file is a generation and a byte offset. Only whole lines are
read; half a line waits for its end. A file that has become shorter, or whose
beginning has changed, is a new generation and is read from its first byte; a
file that was moved to another name within the folder (rotation) goes on where
the old name stopped. A batch takes at most ``maxbytes`` of all files together
(one longer line alone), so a backlog of any size is worked off in batches of
even size, and large ranges are split among tasks. A record arrives when the
batch that holds it is planned; the plan is logged, so a replay says the same.

Positions are planned on the driver, which reads no more than the ends of the
ranges; tasks read the ranges themselves. The engine writes a planned range to
its log before it runs it and plans the same range again after a crash, so
rows and positions stay in step. Where the plan goes on after a restart is
read from that log, hence the option ``checkpoint``: the query's own
checkpoint location.

If planned bytes are gone before they were read, the query fails;
``skiplost=true`` goes on without them.

Options: ``path`` (folder), ``checkpoint``, ``suffix`` (of file names, default
``.jsonl`` and ``.jsonl.rotated``), ``maxbytes``, ``splitbytes``, ``skiplost``.
"""

from __future__ import annotations

import json
import sys
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_lines"
SUFFIXES = ".jsonl,.jsonl.rotated"
MAX_BYTES = 64_000_000
SPLIT_BYTES = 16_000_000
LEAST_SPLIT = 1_000_000
HEAD = 256
CHUNK = 65_536
ROWS = 20_000
READ = 4_000_000
KEPT_LOST = 64
SCHEMA = "value string, received_at timestamp"

# Workers need no copy of this package: the reader goes to them as a value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class LostRange(RuntimeError):
    """Bytes that a batch was planned over are no longer there."""


class Split(InputPartition):
    """A byte range of a file whose first bytes have the given checksum."""

    def __init__(self, name: str, head: int, head_size: int, low: int, high: int, arrival: int):
        self.name, self.head, self.head_size, self.low, self.high, self.arrival = name, head, head_size, low, high, arrival


class Folder:
    """The few file operations this needs, on any file system that Arrow can open."""

    def __init__(self, path: str):
        from pyarrow import fs

        local = "://" not in path and not path.startswith("file:")
        self.fs, self.path = fs.FileSystem.from_uri(f"file://{path}" if local else path)

    def sizes(self, suffixes: tuple[str, ...]) -> dict[str, int]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffixes)}

    def open(self, name: str) -> pa.NativeFile:
        return self.fs.open_input_file(f"{self.path}/{name}")

    def head(self, name: str, size: int) -> int:
        with self.open(name) as f:
            return zlib.crc32(f.read_at(size, 0))

    def names(self) -> list[str]:
        from pyarrow import fs

        return [f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))]

    def text(self, name: str) -> str:
        with self.open(name) as f:
            return f.read().decode()


def line_end(f: pa.NativeFile, low: int, high: int, size: int) -> int:
    """The last line end in (low, high], else the first one up to ``size``, else ``low``."""
    at = high
    while at > low:
        start = max(low, at - CHUNK)
        cut = f.read_at(at - start, start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        at = start
    at = high
    while at < size:
        part = f.read_at(min(CHUNK, size - at), at)
        cut = part.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(part)
    return low


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.checkpoint = options["checkpoint"]
        self.suffixes = tuple(options.get("suffix", SUFFIXES).split(","))
        self.max_bytes = int(options.get("maxbytes", MAX_BYTES))
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.skip_lost = options.get("skiplost", "false").lower() == "true"
        self.reached: dict | None = None

    # An offset is {"files": {key: {"name": its name now, "p": position, "h": checksum of the first bytes,
    # "n": their number, "t": arrival in microseconds}}}; the key (first name and generation) names the content.

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _logged(self) -> dict:
        """The end of the newest batch that was planned, from the engine's log."""
        log = Folder(f"{self.checkpoint.rstrip('/')}/offsets")
        planned = [int(n) for n in log.names() if n.isdigit()]
        if not planned:
            return self.initialOffset()
        return json.loads(log.text(str(max(planned))).splitlines()[2])

    @staticmethod
    def _matched(folder: Folder, sizes: dict[str, int], before: dict[str, dict]) -> dict[str, str]:
        """name -> key of the content a file goes on with: under its old name first, then moved ones."""
        out: dict[str, str] = {}
        for by_name in (True, False):
            for key, entry in before.items():
                if key in out.values():
                    continue
                for name in [entry["name"]] if by_name else sorted(sizes):
                    if name in sizes and name not in out and sizes[name] >= entry["p"] and folder.head(name, entry["n"]) == entry["h"]:
                        out[name] = key
                        break
        return out

    def latestOffset(self) -> dict:
        if self.reached is None:
            self.reached = self._logged()
        folder, before, left = Folder(self.folder), self.reached["files"], self.max_bytes
        sizes = folder.sizes(self.suffixes)
        known = self._matched(folder, sizes, before)
        lost = [key for key in before if key not in known.values()]
        # A file that is just being moved may be missing once: the newest of those not found stay known.
        out = {key: before[key] for key in lost[-KEPT_LOST:]}
        now = time.time_ns() // 1000
        names = {key: name for name, key in known.items()}
        fresh = [n for n in sorted(sizes) if n not in known]
        for key in [*(k for k in before if k in names), *fresh]:
            name = names.get(key, key)
            if name in known:
                entry = {**before[key], "name": name}
            else:
                used = [int(k.rsplit("#", 1)[1]) for k in before if k.rsplit("#", 1)[0] == name]
                key, entry = f"{name}#{max(used, default=-1) + 1}", {"name": name, "p": 0, "h": 0, "n": 0, "t": now}
            if left > 0 and sizes[name] > entry["p"]:
                with folder.open(name) as f:
                    high = min(sizes[name], entry["p"] + left)
                    # A line longer than a whole batch comes alone.
                    end = line_end(f, entry["p"], high, sizes[name] if left == self.max_bytes else high)
                    if end > entry["p"]:
                        left -= end - entry["p"]
                        size = min(end, HEAD)
                        entry = {"name": name, "p": end, "h": zlib.crc32(f.read_at(size, 0)), "n": size, "t": now}
            if entry["p"]:
                out[key] = entry
        return {"files": out}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        self.reached = end
        out = []
        for key, entry in end["files"].items():
            at = start["files"].get(key, {"p": 0})["p"]
            if entry["p"] < at:
                raise ValueError(f"{key}: planned to {entry['p']}, behind {at}; does the option checkpoint name the query's own checkpoint?")
            while at < entry["p"]:
                stop = min(entry["p"], at + self.split_bytes)
                out.append(Split(entry["name"], entry["h"], entry["n"], at, stop, entry["t"]))
                at = stop
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.folder)
        name = self._place(folder, partition)
        if name is None:
            if self.skip_lost:
                return
            raise LostRange(f"{partition.name}: bytes {partition.low} to {partition.high} are gone")
        shape = pa.schema([("value", pa.string()), ("received_at", pa.timestamp("us", "UTC"))])
        with folder.open(name) as f:
            size = f.size()
            # A line belongs to the range it begins in.
            at, stop = line_start(f, partition.low, size), line_start(f, partition.high, size)
            rest = b""
            while at < stop:
                part = f.read_at(min(READ, stop - at), at)
                at += len(part)
                lines = (rest + part).split(b"\n")
                rest = lines.pop()
                for k in range(0, len(lines), ROWS):
                    texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[k : k + ROWS]]
                    arrivals = pa.array([partition.arrival] * len(texts), pa.int64()).cast(shape.field(1).type)
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), arrivals], schema=shape)

    @staticmethod
    def _place(folder: Folder, split: Split) -> str | None:
        """The file that holds the planned bytes now: under its name, or moved since."""
        for name in [split.name, *(n for n in folder.names() if n != split.name)]:
            try:
                with folder.open(name) as f:
                    if f.size() >= split.high and zlib.crc32(f.read_at(split.head_size, 0)) == split.head:
                        return name
            except OSError:
                continue
        return None


def line_start(f: pa.NativeFile, low: int, size: int) -> int:
    """Where the first line begins at ``low`` or later."""
    at = low - 1
    while 0 <= at < size:
        part = f.read_at(min(CHUNK, size - at), at)
        cut = part.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(part)
    return 0 if low <= 0 else size


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:  # noqa: ANN001
        return GrowingLinesReader(dict(self.options))


def stream_lines(spark: SparkSession, folder: str, checkpoint: str, max_bytes: int = MAX_BYTES, **options: str) -> DataFrame:
    """Lines appended to the files of a folder, with their landing time."""
    spark.dataSource.register(GrowingLines)
    # A full batch gives every core a range, as far as ranges do not become too small to be worth a task.
    split = min(SPLIT_BYTES, max(LEAST_SPLIT, -(-max_bytes // spark.sparkContext.defaultParallelism)))
    reader = spark.readStream.format(FORMAT).option("checkpoint", checkpoint).option("maxbytes", str(max_bytes)).option("splitbytes", str(split))
    return reader.options(**options).load(folder)
