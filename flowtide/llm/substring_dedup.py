"""Exact substring dedup by difference-cover anchors.

A window of words is removed from a document if it also starts in a document
with a smaller id. Hashing every window would send a row per word; instead
only the word grams at difference-cover places modulo a period are hashed. For
any two places there is an offset below the period at which both are cover
places, so two equal windows, wherever they stand in their documents, share an
aligned anchor. Anchors found in two documents make the windows around them
candidates; a candidate is extended to its full window, whose hash (96 bits)
decides.

Both rounds work alike: a block of documents settles what it can by itself and
asks once per distinct hash, so a passage that stands in a third of all
documents sends one entry per block. Shards by hash answer the blocks' entries.

Defined results: null and empty texts have no words; a null id counts as the
largest; documents that share an id do not remove each other's windows, and
rows equal in id and text get equal results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from flowtide.llm.tokens import Words, answer, document_cells, merged_answers, packed, pieces, rising, risen, runs, spread, unpacked
from flowtide.llm.work import shards, stored, text_bytes

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)  # every difference modulo 7 is the difference of two of these
BLOCK = 1_000_000
LAST = np.iinfo(np.int64).max
KEYED = "id bigint, th bigint"
ASKED = "shard int, block bigint, blob binary"


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *more: str) -> DataFrame:
    """(id, th, text) and columns ``more``: th tells apart rows of one id, and null ids are the largest."""
    own = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(int(LAST)))
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(own.alias("id"), F.xxhash64(body).alias("th"), body.alias("text"), *more)


class _Block:
    """Entries of many documents, flushed together: a hash, its document and place."""

    def __init__(self, wide: bool):
        self.wide = wide
        self.ids, self.ths, self.docs = [], [], 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch, hashes: np.ndarray, doc: np.ndarray, at: np.ndarray, more: np.ndarray | None = None) -> None:
        self.parts.append((hashes, (doc + self.docs).astype(np.int32), at.astype(np.int32), more if more is not None else np.zeros(0, np.uint32)))
        self.ids.append(np.asarray(batch["id"]))
        self.ths.append(np.asarray(batch["th"]))
        self.docs += batch.num_rows
        self.size += len(hashes)

    def sorted(self) -> tuple[np.ndarray, ...]:
        h, doc, at, more = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((more, h)) if self.wide else np.argsort(h, kind="stable")
        ids, ths = np.concatenate(self.ids), np.concatenate(self.ths)
        return h[order], (more[order] if self.wide else more), doc[order], at[order], ids, ths


def _flush(block: _Block, count: int, ask: bool, settle, number: int) -> Iterator[pa.RecordBatch]:
    """Either the block's own findings per document, or its entries per shard."""
    if not block.size:
        return
    h, more, doc, at, ids, ths = block.sorted()
    begins = runs(h, more) if block.wide else runs(h)
    local, open_, known = settle(ids[doc], begins, len(h))
    if not ask:
        yield document_cells(ids, ths, doc[local], at[local])
        return
    # One entry stands for a hash that the block has settled (no document waits for it).
    sent = np.flatnonzero(open_ | known)
    shard = ((h[sent] >> np.uint64(32)) % np.uint64(count)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    sent, shard = sent[order], shard[order]
    begins = runs(shard)
    cells = []
    for a, b in zip(begins, np.append(begins[1:], len(sent))):
        take = sent[a:b]
        used, ref = np.unique(doc[take], return_inverse=True)
        ref = np.where(open_[take], ref, -1).astype(np.int32)
        cells.append(packed(rising(h[take]), more[take] if block.wide else more[:0], ref, at[take], ids[used], ths[used]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(shard[begins], pa.int32()), pa.array(np.full(len(begins), number)), pa.array(cells, pa.binary())], names=["shard", "block", "blob"]
    )


def _anchors_settled(own: np.ndarray, begins: np.ndarray, n: int):
    """Repeated within the block if two ids share the hash."""
    low, high = np.minimum.reduceat(own, begins), np.maximum.reduceat(own, begins)
    many = spread(low < high, begins, n)
    first = np.zeros(n, bool)
    first[begins] = True
    return many, ~many, many & first


def _windows_settled(own: np.ndarray, begins: np.ndarray, n: int):
    """Removed within the block if a smaller id has the window; the smallest id asks the others."""
    low = spread(np.minimum.reduceat(own, begins), begins, n)
    return own > low, own == low, np.zeros(n, bool)


def _entries(rows: DataFrame, make, wide: bool, count: int, ask: bool, settle) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = _Block(wide), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch):
                make(block, part)
                if block.size >= BLOCK:
                    yield from _flush(block, count, ask, settle, number)
                    block, number = _Block(wide), number + 1
        yield from _flush(block, count, ask, settle, number)

    return rows.mapInArrow(run, ASKED if ask else f"{KEYED}, cell binary")


def _answers(asked: DataFrame, wide: bool, windows: bool) -> DataFrame:
    """Which entries' hashes other documents hold too (anchors), or smaller ids hold (windows); back per block, then per document."""

    def run(key, table):  # untyped: hints as text are not understood here
        cells, base = [], 0
        for n, blob in enumerate(table["blob"]):
            h, m, ref, at, i, t = unpacked(blob.as_py())
            cells.append((risen(h), m, np.where(ref >= 0, ref + base, -1).astype(np.int64), at, np.full(len(h), n, np.int32), i, t))
            base += len(i)
        h, m, ref, at, source, ids, ths = (np.concatenate(c) for c in zip(*cells))
        cells = None
        order = np.lexsort((m, h)) if wide else np.argsort(h, kind="stable")
        h, ref, at, source = h[order], ref[order], at[order], source[order]
        begins = runs(h, m[order]) if wide else runs(h)
        known = ref < 0
        own = np.where(known, LAST, ids[np.maximum(ref, 0)])
        low = np.minimum.reduceat(own, begins)
        if windows:
            hit = own > spread(low, begins, len(h))
        else:
            high = np.maximum.reduceat(np.where(known, np.iinfo(np.int64).min, own), begins)
            hit = spread((low < high) | np.logical_or.reduceat(known, begins), begins, len(h))
        hit = np.flatnonzero(hit & ~known)
        hit = hit[np.argsort(source[hit], kind="stable")]
        begins = runs(source[hit])
        got = [answer(ids, ths, ref[hit[a:b]], at[hit[a:b]]) for a, b in zip(begins, np.append(begins[1:], len(hit)))]
        return pa.table([table["block"].take(pa.array(source[hit[begins]])), pa.array(got, pa.binary())], names=["block", "blob"])

    found = asked.groupBy("shard").applyInArrow(run, "block bigint, blob binary")
    return per_document(found)


def per_document(found: DataFrame) -> DataFrame:
    """Answers (block, blob) as rows (id, th, cell)."""

    def run(key, table):  # untyped: hints as text are not understood here
        return pa.Table.from_batches([merged_answers(table["blob"].to_pylist())])

    return found.groupBy("block").applyInArrow(run, f"{KEYED}, cell binary")


def gathered(one: DataFrame, other: DataFrame, name: str) -> DataFrame:
    rows = one.unionByName(other).groupBy("id", "th").agg(F.collect_list("cell").alias(name))  # bounded by the document
    return rows.select(F.col("id").alias("_id"), F.col("th").alias("_th"), name)


def _places(cell: pa.Scalar) -> np.ndarray:
    got = [risen(unpacked(b)[0]) for b in cell.as_py() or ()]
    return np.unique(np.concatenate(got)).astype(np.int64) if got else np.zeros(0, np.int64)


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(id, th, places, text) of documents that lose words: the first words of their removed windows."""
    rows = keyed(docs, text, doc_id)
    size = text_bytes(docs, text)
    width = window - PERIOD + 1  # every aligned anchor lies within the window

    def anchors(block: _Block, part: pa.RecordBatch) -> None:
        w = Words(part["text"])
        place = np.flatnonzero(np.isin(w.at % PERIOD, COVER) & (w.at + width <= w.count[w.doc]))
        block.add(part, w.grams(place, width), w.doc[place], w.at[place])

    count = shards(size)
    one = _entries(rows, anchors, False, count, False, _anchors_settled)
    asked = _entries(rows, anchors, False, count, True, _anchors_settled)
    anchored = gathered(one, _answers(asked, False, False), "places")
    near = stored(
        rows.join(anchored, (F.col("id") == F.col("_id")) & (F.col("th") == F.col("_th"))).select("id", "th", "text", "places"),
        "substring-candidates",
    )

    def windows(block: _Block, part: pa.RecordBatch) -> None:
        w = Words(part["text"])
        around = np.zeros(len(w.start) + 1, np.int64)
        for row, cell in enumerate(part["places"]):
            at = _places(cell)
            lo = w.first[row] + np.maximum(0, at - (PERIOD - 1))
            np.add.at(around, lo, 1)
            np.add.at(around, w.first[row] + at + 1, -1)
        place = np.flatnonzero((np.cumsum(around[:-1]) > 0) & (w.at + window <= w.count[w.doc]))
        block.add(part, w.grams(place, window), w.doc[place], w.at[place], w.grams(place, window, 0x5851F42D4C957F2D).astype(np.uint32))

    held = near.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    count = shards(2 * held)
    one = _entries(near, windows, True, count, False, _windows_settled)
    asked = _entries(near, windows, True, count, True, _windows_settled)
    removed = gathered(one, _answers(asked, True, True), "places")
    own = near.select("id", "th", "text")
    return own.join(removed, (F.col("id") == F.col("_id")) & (F.col("th") == F.col("_th"))).select("id", "th", "text", "places")


def _lost(w: Words, cells, window: int) -> np.ndarray:
    cover = np.zeros(len(w.start) + 1, np.int64)
    for row, cell in enumerate(cells):
        at = w.first[row] + _places(cell)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
    return np.cumsum(cover[:-1]) > 0


def cleaned(lossy: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, th, text, n_removed): the text without its removed words and the white space after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = Words(part["text"])
                lost = _lost(w, part["places"], window)
                step = np.zeros(len(w.data) + 1, np.int64)
                last = w.at + 1 == w.count[w.doc]
                until = np.where(last, w.offsets[w.doc + 1], np.append(w.start[1:], len(w.data)))
                np.add.at(step, w.start[lost], 1)
                np.add.at(step, until[lost], -1)
                keep = np.cumsum(step[:-1]) == 0
                texts = [w.data[lo:hi][keep[lo:hi]].tobytes().decode() for lo, hi in zip(w.offsets, w.offsets[1:])]
                gone = np.bincount(w.doc[lost], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part["id"], part["th"], pa.array(texts), pa.array(gone.astype(np.int64))], names=["id", "th", "text", "n_removed"])

    return lossy.mapInArrow(run, f"{KEYED}, text string, n_removed bigint")


def digests(lossy: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, th, n_removed, kept_sha256) of the words that stay, joined by one space."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = Words(part["text"])
                lost = _lost(w, part["places"], window)
                data = w.data.tobytes()
                shas = []
                for row in range(part.num_rows):
                    lo = w.first[row]
                    stay = lo + np.flatnonzero(~lost[lo : lo + w.count[row]])
                    kept = b" ".join([data[a:b] for a, b in zip(w.start[stay].tolist(), w.end[stay].tolist())])
                    shas.append(hashlib.sha256(kept).hexdigest())
                gone = np.bincount(w.doc[lost], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part["id"], part["th"], pa.array(gone.astype(np.int64)), pa.array(shas)], names=["id", "th", "n_removed", "kept_sha256"])

    return lossy.mapInArrow(run, f"{KEYED}, n_removed bigint, kept_sha256 string")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, size: str | None = None) -> DataFrame:
    """``docs``, columns unchanged, the text without its removed words; a column ``size`` gets the length of a changed text."""
    new = stored(cleaned(repeated(docs, text, doc_id, window), window), "substring-cleaned")
    new = new.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("text").alias("_new")).dropDuplicates(["_id", "_th"])
    cells = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*cells).alias("_row"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(int(LAST))).alias("_i"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    rows = rows.join(new, (F.col("_i") == F.col("_id")) & (F.col("_t") == F.col("_th")), "left")

    def cell(name: str):
        had = F.col(f"_row.`{name}`")
        if name == text:
            return F.coalesce("_new", had).alias(name)
        if name == size:
            return F.coalesce(F.length("_new").cast(docs.schema[name].dataType), had).alias(name)
        return had.alias(name)

    return rows.select(*map(cell, docs.columns))
