"""Vectorised words, rolling hashes and packed arrays inside tasks (numpy only)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 1_000_000  # bytes of text worked on at once; one longer text is taken whole
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: all bits of the result depend on all bits of ``x``."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(salt: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i up to ``n``."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.ones(size, np.uint64)
            done, step = 1, np.uint64(b)
            while done < size:  # doubling: p[i + done] = p[i] * b ** done
                more = min(done, size - done)
                p[done : done + more] = p[:more] * step
                step = step * step
                done += more
            made.append(p)
        have = _POWERS[base] = (made[0], made[1])
    return have


class Rolling:
    """Hash of any slice of ``values`` in constant time."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = powers(len(values))
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as bytes, and where each begins (one more entry than texts); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text", step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``step`` bytes of text."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0)).astype(np.int64)
    group = np.cumsum(lengths) // step
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """White-space separated words of a column of texts.

    start, end: byte places in ``data``; doc: row of each word; at: place of
    the word in its row; count: words per row; hash: 64 bits per word.
    """

    def __init__(self, column: pa.Array, lower: bool = False, salt: int = 0):
        self.data, self.offsets = text_bytes(column)
        if lower:
            self.data = _LOWER[self.data]
        word = ~_WHITE[self.data]
        n = len(word)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        before[edge[:n]] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        after[edge[1:]] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(self.offsets) - 1)
        self.first = np.cumsum(self.count) - self.count
        self.at = np.arange(len(self.start)) - self.first[self.doc]
        with np.errstate(over="ignore"):
            self.hash = Rolling(byte_values(salt)[self.data]).slices(self.start, self.end)

    def grams(self, places: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
        """Hash of the ``width`` words from each place on (all within a row)."""
        with np.errstate(over="ignore"):
            values = self.hash if not salt else mix(self.hash + np.uint64(salt))
        return Rolling(values).slices(places, places + width)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def spread(values: np.ndarray, begins: np.ndarray, total: int) -> np.ndarray:
    """One value per run, repeated for every row of its run."""
    return np.repeat(values, np.diff(np.append(begins, total)))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; equal bytes of neighbouring numbers lie together."""
    import zstandard

    cells = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.copy() if len(a) else a
        cells.append((a.dtype.str, len(a), planes.tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(cells, protocol=5))


def unpacked(value: bytes) -> list[np.ndarray]:
    import zstandard

    out = []
    for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(value)):
        dtype = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n) if n else np.zeros((dtype.itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
    return out


def rising(values: np.ndarray) -> np.ndarray:
    """Differences of a sorted unsigned array; undone by cumsum."""
    with np.errstate(over="ignore"):
        return np.diff(values, prepend=values.dtype.type(0))


def risen(steps: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(steps, dtype=steps.dtype)


def document_cells(ids: np.ndarray, ths: np.ndarray, doc: np.ndarray, at: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """One row (id, th, cell) per document: its places in order, and what goes with each."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order].astype(np.uint32)
    more = tuple(m[order].astype(np.uint32) for m in more)
    begins = runs(doc)
    cells = [packed(rising(at[a:b]), *(m[a:b] for m in more)) for a, b in zip(begins, np.append(begins[1:], len(doc)))]
    head = doc[begins]
    return pa.RecordBatch.from_arrays([pa.array(ids[head], pa.int64()), pa.array(ths[head], pa.int64()), pa.array(cells, pa.binary())], names=["id", "th", "cell"])


def answer(ids: np.ndarray, ths: np.ndarray, doc: np.ndarray, at: np.ndarray, *more: np.ndarray) -> bytes:
    """A shard's findings for the documents of one block."""
    used, ref = np.unique(doc, return_inverse=True)
    return packed(ids[used], ths[used], ref.astype(np.int32), at.astype(np.uint32), *(m.astype(np.uint32) for m in more))


def merged_answers(blobs: list[bytes]) -> pa.RecordBatch:
    """All shards' findings for the documents of one block, one row per document."""
    cells, base = [], 0
    for ids, ths, ref, at, *more in map(unpacked, blobs):
        cells.append((ids, ths, ref.astype(np.int64) + base, at, *more))
        base += len(ids)
    ids, ths, ref, *rest = (np.concatenate(c) for c in zip(*cells))
    order = np.lexsort((ths, ids))
    number = np.zeros(len(order), np.int64)
    number[runs(ids[order], ths[order])] = 1
    same = np.empty(len(order), np.int64)
    same[order] = np.cumsum(number) - 1
    first = order[number == 1]
    return document_cells(ids[first], ths[first], same[ref], *rest)
