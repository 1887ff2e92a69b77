"""Best-fit packing of tokenised documents by bin completion.

Tokenising gives one narrow row per piece; texts and ids are not shuffled. How
pieces combine depends on their lengths alone, so the packer works on the
histogram of lengths, which has at most as many rows as a sequence has tokens.
Bin completion takes the largest length left, enumerates the undominated
fillings of the rest of the sequence, and uses a filling as often as the
histogram allows. The first descent takes the fullest filling each time, which
is the best-fit solution and the first incumbent; branch and bound then tries
other fillings and gives up a branch once its waste proves that it needs as
many sequences as the incumbent. It ends when the incumbent meets the lower
bound, or after a number of steps. A plan above the bound is held against plans
that complete long and short pieces apart (``planned``); what is left to the
bound is reported.

Pieces of one length are interchangeable: their rank within the length says
which filling they go to. Ranks are counted within hashed parts, so a length
that a third of all pieces share is spread over many tasks.

Defined results: null and empty texts give the one closing id; repeated rows
are packed one by one; no rows give no pieces; other columns are not read.
"""

from __future__ import annotations

import hashlib
import logging
import os
import sys
import types
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.work import shards, stored

LOG = logging.getLogger(__name__)

SIZE = 1024
CLOSING_ID = 2
STEPS = 3_000
OTHERS = 12
SPLITS = 24
CACHE_WORDS = 1_000_000
CACHE_BYTES = 32_000_000
ENCODED = 20_000  # new parts encoded as one string
STEP = 8_000_000  # bytes of text encoded at once; one longer text is taken whole
PART_ROWS = 20_000
SPACE = "\u0120"  # what byte-level vocabularies write for a space


# ---- tokens ---------------------------------------------------------------------------------------------

def _encoder(model: str) -> _Encoder:
    """The worker's own encoder of this model, made once and kept from task to task.

    What is sent to tasks by value is made anew for each of them, so the
    encoders live in a module that the worker process keeps.
    """
    kept = sys.modules.setdefault(f"{__name__}.worker", types.ModuleType(f"{__name__}.worker")).__dict__
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in kept:
        kept[key] = _Encoder(model)
    return kept[key]


class _Known:
    """Ids of parts met so far, end to end; a part's place says where its own lie.

    The parts are one Arrow array, which takes a fraction of the memory of as many strings in a dict.
    """

    def __init__(self):
        self.parts = pa.array([], pa.large_string())
        self.ids = np.zeros(0, "<u4")
        self.ends = np.zeros(1, np.int64)  # one more than there are parts

    def __len__(self) -> int:
        return len(self.parts)

    def places(self, parts: pa.Array) -> np.ndarray:
        """Place of each part, -1 for one that was not met."""
        return np.asarray(pa.compute.index_in(parts, value_set=self.parts).fill_null(-1)).astype(np.int64)

    def of(self, place: int) -> bytes:
        return self.ids[self.ends[place] : self.ends[place + 1]].tobytes()

    def add(self, parts: list[str], ids: list[bytes]) -> None:
        self.parts = pa.concat_arrays([self.parts, pa.array(parts, pa.large_string())])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4])

    def halve(self, most: int, most_bytes: int) -> None:
        """Common parts come early; of too many, or too long ones, the later half goes."""
        while len(self) and (len(self) > most or self.parts.nbytes > most_bytes):
            self.parts = self.parts[: min(len(self), most) // 2]
            self.ends = self.ends[: len(self) + 1]
            self.ids = self.ids[: self.ends[-1]]


class _Encoder:
    """Ids of a text, as little-endian 32-bit integers.

    A single space between two characters that are not white space always
    starts a new pre-token, so the parts between such spaces have ids of their
    own and common ones are encoded once. A text with any other space (a part
    that is empty, or begins or ends with white space) is encoded as a whole.
    Arrow finds the distinct parts of many texts; only these are looked up.
    New ones are encoded as one string, each behind its space: the ids whose
    token begins with a space tell where a part begins.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        tokens = self.model.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(tokens.values(), default=0) + 1, bool)
        self.leads[[n for token, n in tokens.items() if token.startswith(SPACE)]] = True
        self.first, self.later = _Known(), _Known()
        self.marks = dict(zip(",.", self.encode([",", "."])))

    def encode(self, texts: list[str]) -> list[bytes]:
        got = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", g.ids).tobytes() for g in got]

    def _spaced(self, parts: list[str]) -> list[bytes]:
        """Ids of the parts, each with a space before it."""
        ids = np.frombuffer(self.encode(["".join([" " + p for p in parts])])[0], "<u4")
        begins = np.flatnonzero(self.leads[ids])
        # A token that begins with a space holds one at least: as many as there are parts hold one each.
        if len(begins) != len(parts) or begins[0]:
            return self.encode([" " + p for p in parts])
        raw, cuts = ids.tobytes(), [*(4 * begins).tolist(), 4 * len(ids)]
        return [raw[lo:hi] for lo, hi in zip(cuts, cuts[1:])]

    def _places(self, known: _Known, parts: pa.Array, encode: Callable[[list[str]], list[bytes]]) -> np.ndarray:
        """Places of the parts, -1 for those that have no ids of their own."""
        known.halve(CACHE_WORDS, CACHE_BYTES)
        # A comma or full stop after a letter is a pre-token of its own; what stands before it may be known.
        ended = pa.compute.or_(*(pa.compute.ends_with(parts, mark) for mark in self.marks))
        ended = np.flatnonzero(ended.to_numpy(zero_copy_only=False))
        stems = pa.compute.utf8_slice_codeunits(parts.take(pa.array(ended)), 0, -1)
        got, of_stems = np.split(known.places(pa.concat_arrays([parts, stems])), [len(parts)])
        used = np.flatnonzero((of_stems >= 0) & (got[ended] < 0))
        place = dict(zip(stems.take(pa.array(used)).to_pylist(), of_stems[used].tolist()))
        unknown = np.flatnonzero(got < 0)
        listed = parts.take(pa.array(unknown)).to_pylist()
        new = [p for p in dict.fromkeys(listed) if p and p == p.strip()]
        marked = [p for p in new if p[-1] in self.marks and p[-2:-1].isalpha()]
        wanted = dict.fromkeys(new)
        for p in marked:
            del wanted[p]
        wanted.update(dict.fromkeys(p[:-1] for p in marked if p[:-1] not in place))
        if wanted:
            wanted = list(wanted)
            place.update(zip(wanted, count(len(known))))
            groups = (wanted[lo : lo + ENCODED] for lo in range(0, len(wanted), ENCODED))
            known.add(wanted, [ids for group in groups for ids in encode(group)])
        if marked:
            ids = [known.of(place[p[:-1]]) + self.marks[p[-1]] for p in marked]
            place.update(zip(marked, count(len(known))))
            known.add(marked, ids)
        got[unknown] = [place.get(p, -1) for p in listed]
        return got

    def _joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each one's begin and end, and which have to be encoded as a whole."""
        cut = pa.compute.split_pattern(texts, " ")
        begin = np.asarray(cut.offsets).astype(np.int64) - cut.offsets[0].as_py()
        parts = cut.flatten()
        coded = parts.dictionary_encode()
        large = pa.large_string()
        of_first = self._places(self.first, parts.take(pa.array(begin[:-1])).cast(large), self.encode)
        of_later = self._places(self.later, coded.dictionary.cast(large), self._spaced)
        # Places of first parts follow those of the others.
        place = of_later[np.asarray(coded.indices)]
        place[begin[:-1]] = np.where(of_first < 0, -1, of_first + len(self.later))
        odd = np.logical_or.reduceat(place < 0, begin[:-1])
        place = np.maximum(place, 0)
        ids = np.concatenate([self.later.ids, self.first.ids])
        lo = np.concatenate([self.later.ends[:-1], self.first.ends[:-1] + self.later.ends[-1]])
        size = np.concatenate([np.diff(self.later.ends), np.diff(self.first.ends)])
        if not len(lo):
            return ids, begin, np.ones_like(odd)
        many = size[place]
        ends = np.cumsum(many)
        own = ids[np.arange(ends[-1]) + np.repeat(lo[place] - ends + many, many)]
        return own, np.append(0, ends)[begin], odd

    def batch(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts).fill_null("")
        if not len(texts):
            return
        own, ends, odd = self._joined(texts)
        # A worker lives on through later jobs; Arrow keeps what it freed until asked.
        pa.default_memory_pool().release_unused()
        for row, whole in enumerate(odd.tolist()):
            yield self.encode([texts[row].as_py()])[0] if whole else own[ends[row] : ends[row + 1]].tobytes()


def tokenised(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of at most ``size`` tokens, shorter one first."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())  # one vocabulary file, a few MB at any data size
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in batches:
            lengths = np.maximum(0, np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0)))
            ends = np.searchsorted(np.cumsum(lengths), np.arange(1, lengths.sum() // STEP + 1) * STEP, "right")
            for part in np.split(np.arange(len(lengths)), ends):
                if not len(part):
                    continue
                some = batch.slice(part[0], len(part))
                at, number, start, length, crc, raw = [], [], [], [], [], []
                for row, got in enumerate(encoder.batch(some["text"])):
                    got += closing
                    n = len(got) // 4
                    first = (n - 1) % size + 1
                    for k, lo in enumerate([0, *range(first, n, size)]):
                        hi = first if k == 0 else lo + size
                        own = got[4 * lo : 4 * hi]
                        at.append(row), number.append(k), start.append(lo), length.append(hi - lo)
                        crc.append(zlib.crc32(own))
                        if ids:
                            raw.append(own)
                columns = [
                    some["doc_id"].take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    columns.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(pieces, schema)


# ---- bin completion -------------------------------------------------------------------------------------


def fillings(room: int, counts: dict[int, int], sizes: list[int], most: int, steps: int = 400) -> list[tuple[int, ...]]:
    """Undominated sets of lengths that fit into ``room``, fullest first; ``sizes`` falling.

    The search takes long pieces first and ends with ``most`` full ones, or
    after ``steps``.
    """
    fits = [s for s in sizes if s <= room]
    rising = fits[::-1]
    found: list[tuple[int, tuple[int, ...]]] = []
    full = 0
    left = steps

    def search(place: int, free: int, chosen: tuple[int, ...]) -> None:
        nonlocal left, full
        left -= 1
        place = max(place, len(rising) - bisect_right(rising, free))  # the longest that still fits
        if place == len(fits):
            if _undominated(free, chosen, counts, fits):
                found.append((free, chosen))
                full += not free
            return
        size = fits[place]
        for times in range(min(counts[size], free // size), -1, -1):
            search(place + 1, free - times * size, chosen + (size,) * times)
            if left < 0 or full >= most:
                return

    search(0, room, ())
    if not found:
        found.append((room, ()))
        for s in fits:
            free, chosen = found[0]
            times = min(counts[s], free // s)
            found[0] = (free - times * s, chosen + (s,) * times)
    found.sort(key=lambda f: (f[0], len(f[1])))
    return [f for _, f in found[:most]]


def _undominated(waste: int, chosen: tuple[int, ...], counts: dict[int, int], fits: list[int]) -> bool:
    """False if a longer unused piece could take the place of one chosen piece, or of two together."""
    if waste == 0:
        return True
    rising = fits[::-1]

    def longer(size: int, at_least: int) -> bool:
        lo, hi = bisect_left(rising, size + at_least), bisect_right(rising, size + waste)
        return any(counts[s] > chosen.count(s) for s in rising[lo:hi])

    if any(longer(a, 1) for a in set(chosen)):
        return False
    return not any(longer(p, 0) for p in {a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :]})


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Sequences that any packing needs: by tokens, and by pieces too long to share (Martello and Toth)."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // size)
    for k in sorted({s for s in counts if 2 * s <= size} | {0}):
        large = sum(n for s, n in counts.items() if s > size - k)
        middle = sum(n for s, n in counts.items() if size - k >= s and 2 * s > size)
        free = middle * size - sum(s * n for s, n in counts.items() if size - k >= s and 2 * s > size)
        small = sum(s * n for s, n in counts.items() if k <= s and 2 * s <= size)
        best = max(best, large + middle + max(0, -(-(small - free) // size)))
    return best


def complete(counts: dict[int, int], size: int = SIZE, steps: int = STEPS, others: int = OTHERS) -> list[tuple[tuple[int, ...], int]]:
    """(filling, times) that pack ``counts`` pieces by length into as few sequences as found within ``steps`` decisions."""
    counts = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    least = lower_bound(counts, size)
    best: list[tuple[tuple[int, ...], int]] | None = None
    fewest = 0

    # One entry per open decision: lengths left, what was chosen so far, waste so far, fillings still to try.
    def options(left: dict[int, int]) -> Iterator[tuple[int, ...]]:
        top = max(left)
        left[top] -= 1
        sizes = sorted((s for s, n in left.items() if n), reverse=True)
        fullest = fillings(size - top, left, sizes, 1)[0]
        yield (top, *fullest)
        for other in fillings(size - top, left, sizes, others):
            if other != fullest:
                yield (top, *other)

    stack = [(counts, [], 0, options(dict(counts)) if counts else iter([]))]
    if not counts:
        return []
    while stack and steps > 0:
        left, chosen, waste, more = stack[-1]
        filling = next(more, None)
        steps -= 1
        if filling is None:
            stack.pop()
            continue
        need = {s: filling.count(s) for s in set(filling)}
        times = min(left[s] // k for s, k in need.items())
        wasted = waste + times * (size - sum(filling))
        if best is not None and -(-(total + wasted) // size) >= fewest:
            continue
        after = {s: n - times * need.get(s, 0) for s, n in left.items() if n > times * need.get(s, 0)}
        path = [*chosen, (filling, times)]
        if after:
            stack.append((after, path, wasted, options(dict(after))))
            continue
        bins = sum(t for _, t in path)
        if best is None or bins < fewest:
            best, fewest = path, bins
        if fewest <= least:
            break
    while best is None:  # out of steps within the first descent: finish it
        left, chosen, waste, more = stack[-1]
        filling = next(more, None) or next(options(dict(left)))
        need = {s: filling.count(s) for s in set(filling)}
        times = min(left[s] // k for s, k in need.items())
        after = {s: n - times * need.get(s, 0) for s, n in left.items() if n > times * need.get(s, 0)}
        path = [*chosen, (filling, times)]
        if not after:
            best = path
        else:
            stack.append((after, path, waste, options(dict(after))))
    return best


def sequences(plan: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(times for _, times in plan)


def planned(
    counts: dict[int, int], size: int = SIZE, steps: int = STEPS, others: int = OTHERS, splits: int = SPLITS
) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """The best plan found, and how many sequences it is above the lower bound.

    Filling the longest piece best may spend short pieces that fit better among
    themselves. Where a plan stays above the bound, the lengths are therefore
    also cut in two at up to ``splits`` places, each part is completed by
    itself, and the best of all is kept. The work depends on the number of
    lengths, not on the number of pieces.
    """
    counts = {s: n for s, n in counts.items() if n}
    best, least = complete(counts, size, steps, others), lower_bound(counts, size)
    lengths = sorted(counts)
    for k in range(1, splits + 1):
        if sequences(best) <= least:
            break
        border = lengths[0] + (lengths[-1] - lengths[0]) * k // (splits + 1)
        parts = [{s: n for s, n in counts.items() if (s > border) == above} for above in (True, False)]
        # One descent each: decisions are tried again where the whole is at stake.
        plan = [step for part in parts for step in complete(part, size, 1, others)]
        if sequences(plan) < sequences(best):
            best = plan
    return best, sequences(best) - least


# ---- assignment -----------------------------------------------------------------------------------------


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """Per length: (first rank, end, pieces per sequence, first sequence, offset), by rank."""
    used: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for s in sorted(set(filling), reverse=True):
            k = filling.count(s)
            lo = used.get(s, 0)
            used[s] = lo + k * times
            slots.setdefault(s, []).append((lo, lo + k * times, k, sequence, offset))
            offset += k * s
        sequence += times
    return sorted(slots.items())


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, ids: bool = False,
    steps: int = STEPS, others: int = OTHERS, splits: int = SPLITS,
) -> DataFrame:
    """Every piece with its sequence and its place there; ``ids`` adds the ids themselves (binary, 32-bit little-endian).

    ``steps``, ``others`` and ``splits`` bound the search for the plan; what it
    stays above the lower bound by is logged.
    """
    spark = docs.sparkSession
    pieces = stored(tokenised(docs, tokenizer, text, doc_id, size, ids), "pack-pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    plan, above = planned(counts, size, steps, others, splits)
    LOG.info("%d sequences, %d above the lower bound", sequences(plan), above)
    slots = spark.createDataFrame(
        _slots(plan),
        "of bigint, slots array<struct<lo: bigint, hi: bigint, k: bigint, sequence: bigint, at: bigint>>",
    )
    parts = shards(sum(counts.values()), PART_ROWS)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    pieces = pieces.withColumn("_part", part)
    sums = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("length").alias("_length"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_own", F.row_number().over(within) - 1)
    ranked = ranked.join(sums, (F.col("length") == F.col("_length")) & (F.col("_part") == F.col("_p")))
    rank = (F.col("_own") + F.col("_base")).alias("_rank")
    # At most ``size`` rows, whose slots come from the fillings: bounded whatever the data.
    placed = ranked.select(*tokenised_columns(ids), rank).join(F.broadcast(slots), F.col("length") == F.col("of"))
    slot = F.get(F.filter("slots", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"])), F.lit(0))
    placed = placed.withColumn("_slot", slot).withColumn("_j", F.col("_rank") - F.col("_slot.lo"))
    return placed.select(
        *tokenised_columns(ids),
        (F.col("_slot.sequence") + F.floor(F.col("_j") / F.col("_slot.k"))).cast("bigint").alias("sequence_id"),
        (F.col("_slot.at") + F.col("_j") % F.col("_slot.k") * F.col("length")).cast("bigint").alias("offset"),
    )


def tokenised_columns(ids: bool) -> list[str]:
    return ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
