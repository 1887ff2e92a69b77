"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing decides which records hold a payload (``response``) and which only
refer to an equal one (``revisit``), then every task writes its records into
archive files of bounded size, one gzip member per record, and returns one
index row per record: file, offset, length, URL, digest. The index is written
through Spark's commit protocol and is what makes a record exist: the files of
a task that failed or ran twice stay unnamed by it and are never read.

Reading starts from the index too: any selection of its rows is sorted by file
and offset, neighbours less than ``GAP`` bytes apart become one range of at
most ``RANGE`` bytes, and a range is one read. Members between selected ones
are skipped, payloads are checked against their digests.

Of equal payloads the row with the largest id (of equal ids the one stored
last) is the response. Payloads are compared by SHA-1, length and a second
hash. Digests that more than a thousandth of all rows share are at most a
thousand, so their winners go to every task and these rows meet no exchange by
digest; their revisits lose the payload before they move.

Archive files are opened through ``pyarrow.fs``, by the scheme of the folder.

Defined results: null html is an empty payload; a null id is the smallest and
stays null; a null URL leaves its header out; control characters and spaces of
a URL are percent-encoded in the archive, the index keeps the URL as it is;
repeated rows are records of their own; an empty table gives no records; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from flowtide.llm.work import stored
from flowtide.session import scratch_dir

DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 1_000_000_000
GAP = 65_536
RANGE = 8_000_000
OUT_ROWS = 2_000
HOT = 1_000  # a digest is hot if more than one row in HOT has it
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "file string, offset bigint, length bigint, url string, digest string, record_id string, record_type string,"
    " page_id bigint, refers_to bigint, refers_to_id string, payload_bytes bigint"
)
RECORD = INDEX + ", payload binary, intact boolean"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: forty bits at a time, from hexadecimal to base 32, then to the other alphabet."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payloads(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Stored (page_id, url, payload, digest, twin, payload_bytes, row): row numbers are fixed once written."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    return stored(
        rows.select(
            "*", digest(F.col("payload")).alias("digest"), F.xxhash64("payload").alias("twin"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "warc-payloads",
    )


def record_id(row: Column) -> Column:
    """urn:uuid of a row of one stored table."""
    h = F.md5(row.cast("string"))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def planned(rows: DataFrame, least: int = 0) -> DataFrame:
    """Rows with their record type and the row they refer to; revisits without payload.

    Payloads of fewer than ``least`` bytes are all responses.
    """
    same = ["digest", "twin", "payload_bytes"]
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "row", F.col("url").alias("of_url"))).alias("best")
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy(*same).agg(F.count("*").alias("copies"), best)
    groups = stored(groups.filter(F.col("copies") > 1).select(*same, "copies", "best"), "warc-copies")
    bar = rows.count() / HOT
    key = [F.col(c) for c in same]
    hot = groups.filter(F.col("copies") > bar).select(*(c.alias(f"h{n}") for n, c in enumerate(key)), F.col("best").alias("hot_best"))
    rest = groups.filter(F.col("copies") <= bar).select(*(c.alias(f"g{n}") for n, c in enumerate(key)), F.col("best").alias("own_best"))
    meets = lambda p: (key[0] == F.col(f"{p}0")) & (key[1] == F.col(f"{p}1")) & (key[2] == F.col(f"{p}2"))
    marked = rows.join(F.broadcast(hot), meets("h"), "left")  # fewer than HOT rows
    settled = F.col("hot_best").isNotNull()
    revisit = settled & (F.col("hot_best.row") != F.col("row"))
    marked = marked.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), *same, "row", "hot_best",
        # Settled rows look for nothing and are dealt out by their own number.
        F.when(settled, F.col("row").cast("string")).otherwise(F.col("digest")).alias("ask"),
    )
    found = (F.col("ask") == F.col("g0")) & (F.col("twin") == F.col("g1")) & (F.col("payload_bytes") == F.col("g2"))
    both = marked.repartition("ask").join(rest, found, "left").withColumn("best", F.coalesce("hot_best", "own_best"))
    refers = F.col("best").isNotNull() & (F.col("best.row") != F.col("row"))
    return both.select(
        "page_id", "url", F.when(~refers, F.col("payload")).alias("payload"), "digest", "payload_bytes", record_id(F.col("row")).alias("record_id"),
        F.when(refers, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(refers, F.col("best.page_id")).alias("refers_to"), F.when(refers, record_id(F.col("best.row"))).alias("refers_to_id"),
        F.when(refers, F.col("best.of_url")).alias("refers_to_url"),
    )


def _uri(url: str) -> str:
    """A URL that fits a header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _headers(pairs: list[tuple[str, object]]) -> bytes:
    return "".join(f"{name}: {value}\r\n" for name, value in pairs if value is not None).encode() + b"\r\n"


def _member(first: bytes, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(first + _headers([*fields, ("Content-Length", len(block))]) + block + b"\r\n\r\n") + squeeze.flush()


def _record(r: dict) -> bytes:
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", r["payload_bytes"])])
    target = None if r["url"] is None else _uri(r["url"])
    fields = [
        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("Page-ID", r["page_id"]), ("Content-Type", "application/http; msgtype=response"),
    ]
    if r["record_type"] == "revisit":
        where = None if r["refers_to_url"] is None else _uri(r["refers_to_url"])
        fields += [
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{r['refers_to_id']}>"), ("WARC-Refers-To-Target-URI", where),
            ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-ID", r["refers_to"]),
        ]
        return _member(b"WARC/1.1\r\n", fields, http)
    return _member(b"WARC/1.1\r\n", fields, http + (r["payload"] or b""))


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in text.split(","))])


def write(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write planned records below ``folder``; returns the stored index."""
    shape = _schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        base, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        base.create_dir(path, recursive=True)
        out, name, at = None, None, 0
        try:
            for batch in batches:
                index = []
                for r in batch.to_pylist():
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        # A name of its own for each attempt: nothing is ever overwritten.
                        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4()}.warc.gz"
                        out, at = base.open_output_stream(f"{path}/{name}", compression=None), 0
                        info = b"software: flowtide\r\nformat: WARC File Format 1.1\r\n"
                        about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                        member = _member(b"WARC/1.1\r\n", about, info)
                        out.write(member)
                        at = len(member)
                    member = _record(r)
                    out.write(member)
                    index.append({"file": name, "offset": at, "length": len(member), **{c: r[c] for c in shape.names[3:]}})
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_pylist(index, shape)
        finally:
            if out is not None:
                out.close()

    return stored(records.mapInArrow(run, INDEX), "warc-index")


def _fields(lines: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines.decode().split("\r\n") if ": " in line)


def _parsed(member: bytes) -> dict:
    """Type, page, reference, digest and payload of one record, from its own bytes."""
    raw = zlib.decompress(member, 31)
    head, block = raw.split(b"\r\n\r\n", 1)
    fields = _fields(head)
    http, payload = block[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    whole = int(_fields(http)["Content-Length"])
    number = lambda name: int(fields[name]) if name in fields else None
    own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    full = fields["WARC-Type"] == "response"
    good = not full or (len(payload) == whole and base64.b32encode(hashlib.sha1(payload).digest()).decode() == own)
    return {
        "record_type": fields["WARC-Type"], "record_id": fields["WARC-Record-ID"].strip("<>"), "digest": own, "page_id": number("Page-ID"),
        "refers_to": number("Refers-To-Page-ID"), "refers_to_id": fields.get("WARC-Refers-To", "").strip("<>") or None,
        "payload_bytes": whole, "payload": payload if full else None, "intact": good,
    }


def read_records(index: DataFrame, folder: str, gap: int = GAP, span: int = RANGE, payload: bool = True) -> DataFrame:
    """The records of the given index rows, from the archives; a revisit's payload is null.

    ``intact`` tells whether the record carries the indexed id and a payload of its digest.
    """
    shape = _schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        base, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        opened: list = [None, None]

        def read(group: list[dict]) -> pa.RecordBatch:
            name, start = group[0]["file"], group[0]["offset"]
            if opened[0] != name:
                if opened[1] is not None:
                    opened[1].close()
                opened[:] = [name, base.open_input_file(f"{path}/{name}")]
            data = memoryview(opened[1].read_at(group[-1]["offset"] + group[-1]["length"] - start, start))
            out = []
            for r in group:
                got = _parsed(data[r["offset"] - start : r["offset"] - start + r["length"]])
                got["intact"] = got["intact"] and got["record_id"] == r["record_id"]
                out.append({**{c: r[c] for c in ("file", "offset", "length", "url")}, **got, **({} if payload else {"payload": None})})
            return pa.RecordBatch.from_pylist(out, shape)

        group: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if group:
                    end = group[-1]["offset"] + group[-1]["length"]
                    far = r["file"] != group[0]["file"] or r["offset"] - end > gap or r["offset"] + r["length"] - group[0]["offset"] > span
                    if far or len(group) >= OUT_ROWS:
                        yield read(group)
                        group = []
                group.append(r)
        if group:
            yield read(group)
        if opened[1] is not None:
            opened[1].close()

    wanted = index.select("file", "offset", "length", "url", "record_id")
    return wanted.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def archive(pages: DataFrame, folder: str | None = None, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """Write all pages; returns the index and the folder of the archives (by default in the shared scratch folder)."""
    folder = folder or scratch_dir(pages.sparkSession, "warc")
    return write(planned(payloads(pages, page_id, url, html), least), folder), folder
