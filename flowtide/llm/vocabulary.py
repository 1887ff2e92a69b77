"""Runs of given bytes as dictionary codes, in slices of bounded size (numpy and Arrow inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from flowtide.llm.tokens import text_bytes

SLICE = 4_000_000  # bytes looked at together; only a single longer word is taken whole
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


def slices(data: np.ndarray, inside: np.ndarray, step: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``step`` bytes that end outside words, so that a long text is worked on bit by bit."""
    lo = 0
    while lo < len(data):
        hi = min(lo + step, len(data))
        while hi < len(data):
            outside = np.flatnonzero(~inside[data[hi : hi + 65_536]])
            if len(outside):
                hi += int(outside[0])
                break
            hi = min(hi + 65_536, len(data))
        yield lo, hi
        lo = hi


class Runs:
    """Words of one slice: code of each in ``words``, and the row it stands in; letters A to Z lower-cased.

    With ``breaks``, ``broken`` says whether a break byte or the start of a
    row lies between a word and the one before it in the slice.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, inside: np.ndarray, breaks: np.ndarray | None = None):
        part = data[lo:hi]
        word = inside[part]
        edges = offsets[(offsets >= lo) & (offsets < hi)] - lo
        new = word.copy()
        new[1:] &= ~word[:-1]
        new[edges] = word[edges]
        last = word.copy()
        last[:-1] &= ~word[1:]
        ends = edges[edges > 0] - 1
        last[ends] = word[ends]
        start = np.flatnonzero(new)
        lengths = np.flatnonzero(last) + 1 - start
        self.row = np.searchsorted(offsets, start + lo, "right") - 1
        text = LOWER[part[word]]
        ends = np.zeros(len(start) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        strings = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(text))
        coded = strings.dictionary_encode()
        self.code = np.asarray(coded.indices).astype(np.int64)
        self.words = coded.dictionary
        if breaks is not None:
            stops = np.cumsum(breaks[part], dtype=np.int32)[start]
            self.broken = np.ones(len(start), bool)
            self.broken[1:] = (stops[1:] != stops[:-1]) | (self.row[1:] != self.row[:-1])
            self.lead = bool(stops[0]) if len(start) else False  # a break before the first word
            self.tail = bool(breaks[part[start[-1] :]].any()) if len(start) else bool(breaks[part].any())


def joined(parts: list[tuple[np.ndarray, pa.Array]]) -> tuple[np.ndarray, pa.Array]:
    """Codes of several slices over one common dictionary."""
    every = pa.concat_arrays([words for _, words in parts]).dictionary_encode()
    index = np.asarray(every.indices).astype(np.int64)
    codes, base = [], 0
    for code, words in parts:
        codes.append(index[base : base + len(words)][code])
        base += len(words)
    return np.concatenate(codes), every.dictionary


def column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(texts)


def labels(values: pa.Array, null: str) -> tuple[np.ndarray, list[str]]:
    """Codes of a column of names and the names; null counts as ``null``."""
    coded = values.cast(pa.large_string()).fill_null(null).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
