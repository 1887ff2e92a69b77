"""How a stream keeps up: one stored row per batch."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from flowtide.sources import tail
from flowtide.sources.store import TableStore


class Progress(StreamingQueryListener):
    """Appends rows, speed, duration and, for growing files, unread bytes of each batch to ``stream_progress``.

    A batch that is run again replaces its row. With ``query_id`` only that
    query is noted, else every query of the session.
    """

    def __init__(self, store: TableStore, folder: str | None = None, query_id: str | None = None):
        self.store, self.folder, self.query_id = store, folder, query_id

    def behind(self, end_offset: str | None) -> int | None:
        """Bytes that lie beyond the position reached."""
        if self.folder is None or not end_offset:
            return None
        known = json.loads(end_offset).get("files")
        if known is None:
            return None
        read = {entry["name"]: entry["p"] for entry in known.values()}
        sizes = tail.Folder(self.folder).sizes(tuple(tail.SUFFIXES.split(",")))
        return sum(max(0, size - read.get(name, 0)) for name, size in sizes.items())

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        said = event.progress
        if not said.numInputRows or (self.query_id and str(said.id) != self.query_id):
            return
        took = said.durationMs.get("triggerExecution", 0)
        row = (said.timestamp, int(said.numInputRows), said.numInputRows * 1000.0 / max(took, 1), int(took), self.behind(said.sources[0].endOffset))
        rows = self.store.spark.createDataFrame([row], "at string, rows long, rows_per_second double, batch_ms long, behind_bytes long")
        self.store.append("stream_progress", rows.withColumn("ts", F.to_timestamp("at")), int(said.batchId))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        pass


def watch(store: TableStore, folder: str | None = None) -> Progress:
    """Note the progress of all queries of the session from now on."""
    listener = Progress(store, folder)
    store.spark.streams.addListener(listener)
    return listener
