"""Removal of repeated byte strings by longest-previous-factor arrays.

A suffix array over a whole corpus cannot be split, so text is first divided
such that equal strings of ``length`` bytes always meet. Every such string has
a minimizer: of its short grams, the leftmost with the smallest hash. Strings
that start next to each other share it and form a zone of text, and equal
strings lie in zones of equal minimizers. Zones whose minimizer occurs once
hold nothing repeated and go no further.

Zones of equal minimizers meet in a shard. Zones equal as a whole are settled
by their content hash, in their block already if they meet there. Of the rest,
one zone per content goes into a suffix array, built by prefix doubling to the
depth of ``length`` bytes. In suffix order the previous and the next smaller
text position are the candidates for the longest previous factor; it reaches
``length`` exactly if one of them lies in the same run of equal prefixes. The
mirrored array finds later matches.

``keep_first`` removes later copies and keeps the first, in order of (id,
place); otherwise every copy goes.

Defined results: null and empty texts have no bytes; matches never cross
documents; rows equal in id and text are copies of each other; a null id is
the largest; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from flowtide.llm.substring_dedup import ASKED, KEYED, gathered, keyed, per_document
from flowtide.llm.tokens import Rolling, answer, byte_values, document_cells, packed, pieces, rising, risen, runs, spread, text_bytes, unpacked
from flowtide.llm.work import shards, stored
from flowtide.llm.work import text_bytes as total_bytes

CELLS = f"{KEYED}, cell binary"
LENGTH = 400
GRAM = 48
BLOCK = 400_000  # anchors settled together
BLOCK_BYTES = 6_000_000  # zone text settled together
CHUNK = 1 << 21


class Zones:
    """Zones of a column of texts: doc, lo (first window's start, in the text), windows, anchor; data and offsets."""

    def __init__(self, column: pa.Array, length: int):
        self.data, self.offsets = text_bytes(column)
        self.length = length
        n = len(self.data)
        gram = min(GRAM, length)
        width = length - gram + 1
        lows, counts, anchors = [], [], []
        size = np.diff(self.offsets)
        end = np.repeat(self.offsets[1:], size)  # of the text that a byte belongs to
        with np.errstate(over="ignore"):
            # A long text is cut from its own start on, so that its neighbours do not change its zones.
            long = np.flatnonzero(size > CHUNK)
            cuts = [np.arange(self.offsets[d], self.offsets[d + 1], CHUNK) for d in long]
            cuts = np.unique(np.concatenate([[0], *cuts, self.offsets[long + 1], [max(n - length + 1, 0)]]).astype(np.int64))
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                hi = min(hi, n - length + 1)
                if hi <= lo:
                    continue
                part = self.data[lo : hi + length - 1]
                h = Rolling(byte_values(7)[part]).slices(np.arange(len(part) - gram + 1), np.arange(gram, len(part) + 1))
                key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
                least = _sliding_min(key, width)[: hi - lo]
                start = np.arange(lo, hi)
                valid = start + length <= end[lo:hi]
                start, place = start[valid], (least[valid] & np.uint64(0xFFFFFF)).astype(np.int64)
                begins = runs(place, np.searchsorted(self.offsets, start, "right"))
                lows.append(start[begins])
                counts.append(np.diff(np.append(begins, len(start))))
                anchors.append(h[place[begins]])
        self.start = np.concatenate(lows) if lows else np.zeros(0, np.int64)
        self.windows = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.anchor = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.lo = self.start - self.offsets[self.doc]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: of two running minima within blocks of that width."""
    n = len(x)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    grid = full.reshape(blocks, width)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def suffix_classes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in lexicographic order of their first ``length`` bytes, and where runs of equal ones begin."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    for k in range(min(8, length)):
        key = (key << np.uint64(8)) | padded[k : k + len(data)]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    ranks = {min(8, length): rank}
    depth = min(8, length)
    while depth * 2 <= length:
        after = np.append(rank[depth:], np.zeros(min(depth, len(rank)), np.uint64))[: len(rank)]
        rank = np.unique(rank * np.uint64(len(rank) + 1) + after, return_inverse=True)[1].astype(np.uint64)
        depth *= 2
        ranks = {depth: rank}
    # The rest overlaps: equal prefixes of ``depth`` at the start and at the end mean ``length`` equal bytes.
    final = ranks[depth][starts] * np.uint64(len(data) + 1) + ranks[depth][starts + length - depth]
    order = np.argsort(final, kind="stable")
    return order, runs(final[order])


def smaller_neighbour(position: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Whether a smaller position precedes or follows within the run: the longest previous factor spans the run's prefix."""
    found = np.zeros(len(position), bool)
    for step in (1, -1):
        pos, own = position[::step], run[::step]
        psv = np.arange(-1, len(pos) - 1)
        while True:  # skip from larger neighbours to theirs
            beyond = (psv >= 0) & (pos[psv] >= pos)
            if not beyond.any():
                break
            psv[beyond] = psv[psv[beyond]]
        hit = (psv >= 0) & (own[psv] == own)
        found |= hit[::step]
    return found


def _shard_rows(shard: np.ndarray, number: int, make) -> pa.RecordBatch:
    order = np.argsort(shard, kind="stable")
    begins = runs(shard[order])
    cells = [make(order[a:b]) for a, b in zip(begins, np.append(begins[1:], len(order)))]
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[order[begins]].astype(np.int32)), pa.array(np.full(len(begins), number)), pa.array(cells, pa.binary())], names=["shard", "block", "blob"]
    )


def _by_block(table: pa.Table, source: np.ndarray, ids: np.ndarray, ths: np.ndarray, doc: np.ndarray, *values: np.ndarray) -> pa.Table:
    """Findings for documents, as one answer per block that asked."""
    order = np.argsort(source[doc], kind="stable")
    from_ = source[doc][order]
    begins = runs(from_)
    got = [answer(ids, ths, doc[order[a:b]], *(v[order[a:b]] for v in values)) for a, b in zip(begins, np.append(begins[1:], len(order)))]
    return pa.table([table["block"].take(pa.array(from_[begins])), pa.array(got, pa.binary())], names=["block", "blob"])


def _anchors(rows: DataFrame, length: int, count: int, ask: bool) -> DataFrame:
    """Which zones' anchors occur again: settled within the block, or asked of the shards."""

    def flush(held: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
        base, cells = 0, []
        for ids, ths, z in held:
            cells.append((z.anchor, z.doc + base, z.lo))
            base += len(ids)
        h, doc, lo = (np.concatenate(c) for c in zip(*cells))
        ids, ths = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        order = np.argsort(h, kind="stable")
        h, doc, lo = h[order], doc[order], lo[order]
        begins = runs(h)
        many = spread(np.diff(np.append(begins, len(h))) > 1, begins, len(h))
        if not ask:
            yield document_cells(ids, ths, doc[many], lo[many], np.ones(int(many.sum()), np.int64))
            return
        first = np.zeros(len(h), bool)
        first[begins] = True
        h, doc, lo, known = h[first], doc[first], lo[first], many[first]

        def make(take: np.ndarray) -> bytes:
            used, ref = np.unique(doc[take], return_inverse=True)
            return packed(rising(h[take]), np.where(known[take], -1, ref).astype(np.int32), lo[take].astype(np.uint32), ids[used], ths[used])

        yield _shard_rows((h >> np.uint64(32)) % np.uint64(count), number, make)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch):
                z = Zones(part["text"], length)
                z.data = None
                held.append((np.asarray(part["id"]), np.asarray(part["th"]), z))
                size += len(z.start)
                if size >= BLOCK:
                    yield from flush(held, number)
                    held, size, number = [], 0, number + 1
        if size:
            yield from flush(held, number)

    return rows.mapInArrow(run, ASKED if ask else CELLS)


def _anchor_answers(asked: DataFrame) -> DataFrame:
    def run(key, table):  # untyped: hints as text are not understood here
        cells, base = [], 0
        for n, blob in enumerate(table["blob"]):
            h, ref, lo, ids, ths = unpacked(blob.as_py())
            cells.append((risen(h), np.where(ref >= 0, ref + base, -1).astype(np.int64), lo, ids, ths, np.full(len(ids), n)))
            base += len(ids)
        h, ref, lo, ids, ths, source = (np.concatenate(c) for c in zip(*cells))
        order = np.argsort(h, kind="stable")
        h, ref, lo = h[order], ref[order], lo[order]
        begins = runs(h)
        hit = spread(np.diff(np.append(begins, len(h))) > 1, begins, len(h)) & (ref >= 0)
        return _by_block(table, source, ids, ths, ref[hit], lo[hit], np.ones(int(hit.sum()), np.int64))

    return per_document(asked.groupBy("shard").applyInArrow(run, "block bigint, blob binary"))


def _cells(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    got = [unpacked(b) for b in cell.as_py() or ()]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([risen(a) for a, _ in got]).astype(np.int64), np.concatenate([b for _, b in got]).astype(np.int64)


def _later(content: tuple[np.ndarray, ...], ids: np.ndarray, lo: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by content, then (id, row, place); run starts; which rows are not the first of their run."""
    order = np.lexsort((lo, row, ids, *content))
    begins = runs(*(c[order] for c in content))
    later = np.ones(len(order), bool)
    later[begins] = False
    return order, begins, later


def _zones(near: DataFrame, length: int, count: int, ask: bool, keep_first: bool) -> DataFrame:
    """Zones with repeated anchors: copies within the block are settled, one zone per content is asked of the shards."""

    def flush(held: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
        base, cells, texts = 0, [], []
        for ids, ths, z, at, digest in held:
            cells.append((z.anchor, digest, z.doc + base, z.lo, z.windows))
            texts += at
            base += len(ids)
        anchor, digest, doc, lo, windows = (np.concatenate(c) for c in zip(*cells))
        ids, ths = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        order, begins, later = _later((digest, anchor), ids[doc], lo, doc)
        many = spread(np.diff(np.append(begins, len(order))) > 1, begins, len(order))
        if not ask:
            g = order[later if keep_first else many]
            yield document_cells(ids, ths, doc[g], lo[g], windows[g])
            return
        sent = order[~later]
        known = np.zeros(len(sent), bool) if keep_first else many[~later]

        def make(take: np.ndarray) -> bytes:
            t = sent[take]
            used, ref = np.unique(doc[t], return_inverse=True)
            body = np.frombuffer(b"".join([texts[i] for i in t]), np.uint8)
            return packed(anchor[t], digest[t], ref.astype(np.int32), known[take], lo[t].astype(np.uint32), windows[t].astype(np.uint32), ids[used], ths[used], body)

        yield _shard_rows((anchor[sent] >> np.uint64(32)) % np.uint64(count), number, make)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch):
                z = Zones(part["text"], length)
                wanted = np.zeros(len(z.start), bool)
                begin = np.searchsorted(z.doc, np.arange(part.num_rows + 1))
                for row, cell in enumerate(part["spans"]):
                    a, b = begin[row], begin[row + 1]
                    wanted[a:b] = np.isin(z.lo[a:b], _cells(cell)[0])
                for name in ("start", "windows", "anchor", "doc", "lo"):
                    setattr(z, name, getattr(z, name)[wanted])
                end = z.start + z.windows + length - 1
                with np.errstate(over="ignore"):
                    digest = Rolling(byte_values(11)[z.data]).slices(z.start, end)
                data = z.data.tobytes()
                z.data = None
                held.append((np.asarray(part["id"]), np.asarray(part["th"]), z, [data[a:b] for a, b in zip(z.start.tolist(), end.tolist())], digest))
                size += int((end - z.start).sum())
                if size >= BLOCK_BYTES:
                    yield from flush(held, number)
                    held, size, number = [], 0, number + 1
        if size:
            yield from flush(held, number)

    return near.mapInArrow(run, ASKED if ask else CELLS)


def _laid_out(body: np.ndarray, start: np.ndarray, size: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The zones' bytes end to end, where each begins, and zone and place of every window."""
    data = np.concatenate([body[a : a + n] for a, n in zip(start, size)])
    zone = np.repeat(np.arange(len(start)), windows)
    return data, np.cumsum(size) - size, zone, np.arange(len(zone)) - np.repeat(np.cumsum(windows) - windows, windows)


def _zone_answers(asked: DataFrame, length: int, keep_first: bool) -> DataFrame:
    def run(key, table):  # untyped: hints as text are not understood here
        cells, base = [], 0
        for n, blob in enumerate(table["blob"]):
            anchor, digest, ref, known, lo, windows, ids, ths, body = unpacked(blob.as_py())
            cells.append((anchor, digest, ref + base, known, lo.astype(np.int64), windows.astype(np.int64), ids, ths, np.full(len(ids), n), body))
            base += len(ids)
        anchor, digest, ref, known, lo, windows, ids, ths, source, body = (np.concatenate(c) for c in zip(*cells))
        cells = None
        size = windows + length - 1
        start = np.cumsum(size) - size
        order, begins, later = _later((digest, anchor), ids[ref], lo, ref)
        run_of = np.zeros(len(order), np.int64)
        run_of[begins] = 1
        run_of = np.cumsum(run_of) - 1
        many = (np.diff(np.append(begins, len(order))) > 1)[run_of]
        whole = (later if keep_first else many) & ~known[order]
        g = order[whole]
        found = [(ref[g], lo[g], windows[g])]
        # One zone per content, where its anchor has more than one content.
        heads = order[begins]
        heads = heads[np.argsort(anchor[heads], kind="stable")]
        groups = runs(anchor[heads])
        several = spread(np.diff(np.append(groups, len(heads))) > 1, groups, len(heads))
        heads = heads[several]
        asks = ~known[heads] & (np.ones(len(heads), bool) if keep_first else ~np.isin(heads, order[many]))
        # Anchor groups stay together; so many groups at once as fit into memory.
        edges = runs(anchor[heads])
        sizes = np.add.reduceat(size[heads], edges) if len(edges) else np.zeros(0, np.int64)
        part = np.cumsum(sizes) // 1_500_000
        for p in np.unique(part):
            inside = np.flatnonzero(part == p)
            a = edges[inside[0]]
            b = edges[inside[-1] + 1] if inside[-1] + 1 < len(edges) else len(heads)
            own, wants = heads[a:b], asks[a:b]
            data, at, zone, inner = _laid_out(body, start[own], size[own], windows[own])
            # A window whose hash stands alone has no match: zones of such windows need no order.
            with np.errstate(over="ignore"):
                h = Rolling(byte_values(13)[data]).slices(at[zone] + inner, at[zone] + inner + length)
            by_hash = np.argsort(h, kind="stable")
            twin = np.zeros(len(h), bool)
            same = np.flatnonzero(h[by_hash[1:]] == h[by_hash[:-1]])
            twin[by_hash[same]] = twin[by_hash[same + 1]] = True
            alive = np.bincount(zone[twin], minlength=len(own)) > 0
            if not alive.any():
                continue
            own, wants = own[alive], wants[alive]
            data, at, zone, inner = _laid_out(body, start[own], size[own], windows[own])
            ranked, equal = suffix_classes(data, at[zone] + inner, length)
            cls = np.zeros(len(ranked), np.int64)
            cls[equal] = 1
            cls = np.cumsum(cls)
            # Text order: id, then document, then place.
            position = np.empty(len(zone), np.int64)
            position[np.lexsort((lo[own][zone] + inner, ref[own][zone], ids[ref[own]][zone]))] = np.arange(len(zone))
            earlier = smaller_neighbour(position[ranked], cls)
            if not keep_first:
                earlier |= smaller_neighbour(-position[ranked], cls)  # the mirrored array: later matches
            hit = np.zeros(len(zone), bool)
            hit[ranked] = earlier
            hit &= wants[zone]
            w = np.flatnonzero(hit)
            if len(w):
                first = runs(zone[w], w - np.arange(len(w)))
                found.append((ref[own][zone[w[first]]], lo[own][zone[w[first]]] + inner[w[first]], np.diff(np.append(first, len(w)))))
        doc, low, many_ = (np.concatenate(c) for c in zip(*found))
        return _by_block(table, source, ids, ths, doc, low, many_)

    return per_document(asked.groupBy("shard").applyInArrow(run, "block bigint, blob binary"))


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """(id, th, text, spans) of documents that lose bytes; spans: starts of removed windows and how many follow each."""
    rows = keyed(docs, text, doc_id)
    same = (F.col("id") == F.col("_id")) & (F.col("th") == F.col("_th"))
    count = shards(total_bytes(docs, text) / 8)
    anchored = gathered(_anchors(rows, length, count, False), _anchor_answers(_anchors(rows, length, count, True)), "spans")
    near = stored(rows.join(anchored, same).select("id", "th", "text", "spans"), "suffix-candidates")
    held = near.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    count = shards(2 * held, 16e6)
    gone = gathered(_zones(near, length, count, False, keep_first), _zone_answers(_zones(near, length, count, True, keep_first), length, keep_first), "spans")
    return near.select("id", "th", "text").join(gone, same).select("id", "th", "text", "spans")


def _removed(text: bytes, spans: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, spans[0], 1)
    np.add.at(step, spans[0] + spans[1] + length - 1, -1)
    return np.cumsum(step[:-1]) > 0


def cleaned(lossy: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, th, kept, n_removed, n_spans): the remaining bytes; a cut may fall inside a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                kept, gone, spans = [], [], []
                for text, cell in zip(part["text"], part["spans"]):
                    raw = text.as_py().encode()
                    lost = _removed(raw, _cells(cell), length)
                    kept.append(np.frombuffer(raw, np.uint8)[~lost].tobytes())
                    gone.append(int(lost.sum()))
                    spans.append(int((np.diff(lost.astype(np.int8), prepend=0) == 1).sum()))
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["th"], pa.array(kept, pa.binary()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64())],
                    names=["id", "th", "kept", "n_removed", "n_spans"],
                )

    return lossy.mapInArrow(run, f"{KEYED}, kept binary, n_removed bigint, n_spans bigint")
