"""Phrases that stand together more often than their parts would, by SETM relational mining.

R1 is the relation of occurrences (piece, position, word), stored sorted by
piece and position. To extend it, the relation of frequent phrases of k words
is merge-joined with itself on the same piece and adjacent positions: two
phrases that overlap in all but one word make one of k + 1. The joined
relation is grouped and counted, groups below the least count go, and a
semi-join with the groups left gives the next sorted relation. A phrase is
named by the numbers of its two overlapping parts, so counts are exact.

The relations are stored as blocks of neighbouring occurrences, sorted arrays
in one value each; a piece never crosses blocks, so the merge-join is one pass
over a block. A block sends each distinct pair of numbers once, with its
count, to a shard by hash; the shard adds the counts up, numbers the frequent
pairs and answers the blocks that asked. A phrase in a third of all documents
is one entry per block. Words are counted alike as plain rows (one per block
and distinct word). Everything is kept apart by language from the start,
because a word's number belongs to its language.

Numbers: a place is a word's place in its block plus one for every break
between pieces before it, so neighbouring places stand for adjacent positions
of one piece.

Defined results: null texts are empty, null languages are ``und``; phrases
within a piece may overlap themselves and every occurrence counts; repeated
rows count once each; of equal cuts the shortest first part counts; ties go to
the larger count, then to the smaller phrase by UTF-8 bytes; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from flowtide.llm.tokens import mix, packed, rising, risen, runs, unpacked
from flowtide.llm.vocabulary import Runs, byte_set, column, joined, labels, slices
from flowtide.llm.work import shards, stored

LONGEST = 5
LEAST = 100
TOP = 2000
SCALE = 1000
SWALLOWED = 100  # a phrase goes if a longer one has at least this share, in percent, of its count
BLOCK = 1_000_000
BREAKS = byte_set((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
INSIDE = ~(BREAKS | byte_set((0x09, 0x09), (0x20, 0x20)))
RELATION = "block bigint, cell binary"


class _Pieces:
    """Occurrences gathered until a block is full."""

    def __init__(self):
        self.parts, self.places, self.langs = [], [], []
        self.next = self.size = 0

    def add(self, part: Runs, lang: np.ndarray, broken: bool) -> None:
        step = part.broken.astype(np.int64)
        step[0] = broken
        place = self.next + np.cumsum(step + 1) - 1
        self.next = int(place[-1]) + 1
        self.parts.append((part.code, part.words))
        self.places.append(place)
        self.langs.append(lang[part.row])
        self.size += len(place)

    def block(self, number: int, names: list[str]) -> pa.RecordBatch:
        code, words = joined(self.parts)
        lang, place = np.concatenate(self.langs), np.concatenate(self.places)
        used, index, n = np.unique(lang * len(words) + code, return_inverse=True, return_counts=True)
        entries = pa.StructArray.from_arrays(
            [pa.array(names, pa.string()).take(pa.array(used // len(words))), words.take(pa.array(used % len(words))).cast(pa.string()), pa.array(n)],
            names=["lang", "word", "n"],
        )
        cell = packed(rising(place.astype(np.uint32)), index.astype(np.uint32))
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([cell], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)],
            names=["block", "cell", "entries"],
        )


def occurrences(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(block, cell, entries): sorted places with the number of each word, and the words behind the numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, seen = TaskContext.get().partitionId() << 32, _Pieces(), {}
        for batch in batches:
            local, names = labels(batch["lang"], "und")
            for name in names:
                seen.setdefault(name, len(seen))
            of = np.array([seen[name] for name in names], np.int64)[local]
            data, offsets = column(batch["text"])
            row, gap = -1, True
            for lo, hi in slices(data, INSIDE):
                part = Runs(data, offsets, lo, hi, INSIDE, BREAKS)
                if not len(part.code):
                    gap |= part.tail
                    continue
                broken = gap or part.lead or int(part.row[0]) != row
                if broken and now.size >= BLOCK:
                    yield now.block(number, list(seen))
                    number, now = number + 1, _Pieces()
                now.add(part, of, broken)
                row, gap = int(part.row[-1]), part.tail
        if now.size:
            yield now.block(number, list(seen))

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.mapInArrow(run, f"{RELATION}, entries array<struct<lang:string,word:string,n:bigint>>")


def frequent_words(first: DataFrame, least: int) -> DataFrame:
    """(block, code, id, f, lang, word): what each block calls a frequent word, its number and count; the word once per number."""
    flat = first.select("block", F.posexplode("entries").alias("code", "e")).select("block", "code", "e.*")
    one = Window.partitionBy("lang", "word")
    rows = flat.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("block", "code", "lang", "word", "row", F.sum("n").over(one).alias("f"), F.min("row").over(one).alias("id"))
    own = F.col("row") == F.col("id")
    return rows.filter(F.col("f") >= least).select(
        "block", "code", "id", "f", F.when(own, F.col("lang")).alias("lang"), F.when(own, F.col("word")).alias("word")
    )


def _cell(block: int, place: np.ndarray, ids: np.ndarray) -> pa.Table:
    """One block of a relation; empty blocks end here."""
    if not len(place):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["block", "cell"])
    known, index = np.unique(ids, return_inverse=True)
    cell = packed(rising(place.astype(np.uint32)), index.astype(np.uint32), rising(known.astype(np.uint64)))
    return pa.table([pa.array([block]), pa.array([cell], pa.binary())], names=["block", "cell"])


def _semi_words(key, left, right):  # untyped: hints as text are not understood here
    """The block's occurrences of frequent words."""
    if not left.num_rows:
        return _cell(0, np.zeros(0), np.zeros(0))
    place, code = unpacked(left["cell"][0].as_py())
    number = np.full(int(code.max()) + 1, -1, np.int64)
    number[np.asarray(right["code"].combine_chunks())] = np.asarray(right["id"].combine_chunks())
    ids = number[code]
    return _cell(key[0].as_py(), risen(place)[ids >= 0], ids[ids >= 0])


def _joined(cell: bytes) -> tuple[np.ndarray, ...]:
    """The merge-join of a block with itself on adjacent places: place and pair of each hit, the distinct pairs and their counts."""
    place, index, known = unpacked(cell)
    place, known = risen(place), risen(known).astype(np.int64)
    at = np.flatnonzero(place[1:] == place[:-1] + np.uint32(1))
    pair = index[at].astype(np.int64) * len(known) + index[at + 1]
    used, ref, n = np.unique(pair, return_inverse=True, return_counts=True)
    return place[at], ref, known[used // len(known)], known[used % len(known)], n


def _shard(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(b.astype(np.uint64))) % np.uint64(count)).astype(np.int64)


def _asked(relation: DataFrame, count: int) -> DataFrame:
    """(shard, block, blob): each block's distinct pairs with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cell in zip(batch["block"], batch["cell"]):
                _, _, a, b, n = _joined(cell.as_py())
                to = _shard(a, b, count)
                order = np.argsort(to, kind="stable")
                begins = runs(to[order])
                blobs = []
                for lo, hi in zip(begins, np.append(begins[1:], len(order))):
                    take = order[lo:hi]
                    blobs.append(packed(rising(a[take].astype(np.uint64)), b[take], n[take].astype(np.uint32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[order][begins], pa.int32()), pa.array([block.as_py()] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "block", "blob"]
                )

    return relation.mapInArrow(run, "shard int, block bigint, blob binary")


def _grouped(asked: DataFrame, least: int, answered: bool) -> DataFrame:
    """Frequent pairs (id, a, b, f), and for each block that asked which of its entries they are."""

    def run(key, table):  # untyped: hints as text are not understood here
        shard = key[0].as_py()
        a, b, n, source = [], [], [], []
        for row, blob in enumerate(table["blob"]):
            x, y, z = unpacked(blob.as_py())
            a.append(risen(x).astype(np.int64))
            b.append(y)
            n.append(z.astype(np.int64))
            source.append(np.full(len(y), row, np.int32))
        place = np.concatenate([np.arange(len(s), dtype=np.uint32) for s in source])
        a, b, n, source = (np.concatenate(c) for c in (a, b, n, source))
        order = np.lexsort((b, a))
        begins = runs(a[order], b[order])
        f = np.add.reduceat(n[order], begins)
        group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
        many = np.flatnonzero(f >= least)
        number = np.full(len(begins), -1, np.int64)
        number[many] = (shard << 40) + np.arange(len(many))
        head = order[begins[many]]
        null = lambda k, kind: pa.nulls(k, kind)
        found = pa.table(
            [null(len(many), pa.int64()), null(len(many), pa.int32()), null(len(many), pa.binary()), *(pa.array(v) for v in (number[many], a[head], b[head], f[many]))],
            names=["block", "shard", "blob", "id", "a", "b", "f"],
        )
        if not answered:
            return found
        hit = order[number[group] >= 0]
        ids = number[group][number[group] >= 0]
        again = np.lexsort((place[hit], source[hit]))
        hit, ids = hit[again], ids[again]
        begins = runs(source[hit])
        blobs = [packed(rising(place[hit[lo:hi]]), ids[lo:hi]) for lo, hi in zip(begins, np.append(begins[1:], len(hit)))]
        k = len(blobs)
        answers = pa.table(
            [table["block"].take(pa.array(source[hit[begins]])), pa.array([shard] * k, pa.int32()), pa.array(blobs, pa.binary()), *(null(k, pa.int64()) for _ in range(4))],
            names=found.column_names,
        )
        return pa.concat_tables([found, answers])

    return asked.groupBy("shard").applyInArrow(run, "block bigint, shard int, blob binary, id bigint, a bigint, b bigint, f bigint")


def _semi_pairs(relation: DataFrame, answers: DataFrame, count: int) -> DataFrame:
    """The joined relation without its infrequent pairs."""

    def run(key, left, right):  # untyped: hints as text are not understood here
        if not left.num_rows or not right.num_rows:
            return _cell(0, np.zeros(0), np.zeros(0))
        place, ref, a, b, _ = _joined(left["cell"][0].as_py())
        to = _shard(a, b, count)
        number = np.full(len(a), -1, np.int64)
        for shard, blob in zip(right["shard"], right["blob"]):
            at, ids = unpacked(blob.as_py())
            number[np.flatnonzero(to == shard.as_py())[risen(at)]] = ids
        ids = number[ref]
        return _cell(key[0].as_py(), place[ids >= 0], ids[ids >= 0])

    return relation.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, RELATION)


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """Stored frequent phrases by length, from one word on, and (lang, n) of all words.

    (id, lang, words, f, firsts, lasts, a, b): counts of the phrase and of its
    first 1, 2, … and last 1, 2, … words; a and b number the phrase without
    its last and without its first word.
    """
    first = stored(occurrences(docs, text, lang), "collocation-words")
    sizes = first.select(F.explode("entries").alias("e")).groupBy("e.lang").agg(F.sum("e.n").alias("n"))
    known = stored(frequent_words(first, least), "collocation-frequent-1")
    none = F.lit(None).cast("bigint")
    no_counts = F.array().cast("array<bigint>")
    levels = [
        known.filter(F.col("word").isNotNull()).select(
            "id", "lang", F.array("word").alias("words"), "f", no_counts.alias("firsts"), no_counts.alias("lasts"), none.alias("a"), none.alias("b")
        )
    ]
    relation = first.select("block", "cell").groupBy("block").cogroup(known.select("block", "code", "id").groupBy("block")).applyInArrow(_semi_words, RELATION)
    for length in range(2, longest + 1):
        relation = stored(relation, f"collocation-relation-{length - 1}")
        count = shards(3 * relation.agg(F.coalesce(F.sum(F.octet_length("cell")), F.lit(0)).alias("b")).first().b)
        found = stored(_grouped(_asked(relation, count), least, length < longest), f"collocation-groups-{length}")
        cut = lambda side: levels[-1].select(*(F.col(c).alias(f"{side}_{c}") for c in ("id", "lang", "words", "f", "firsts", "lasts")))
        pairs = found.filter(F.col("id").isNotNull()).select("id", "a", "b", "f")
        pairs = pairs.join(cut("p"), F.col("a") == F.col("p_id")).join(cut("s"), F.col("b") == F.col("s_id"))
        level = pairs.select(
            "id", F.col("p_lang").alias("lang"), F.concat("p_words", F.slice("s_words", -1, 1)).alias("words"), "f",
            F.concat("p_firsts", F.array("p_f")).alias("firsts"), F.concat("s_lasts", F.array("s_f")).alias("lasts"), "a", "b",
        )
        levels.append(stored(level, f"collocation-frequent-{length}"))
        if length < longest:
            relation = _semi_pairs(relation, found.filter(F.col("block").isNotNull()).select("block", "shard", "blob"), count)
    return levels, sizes


def swallowed(shorter: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """Without phrases inside a longer one of at least ``share`` percent of their count.

    Counts never rise with length, so if any longer phrase reaches the share,
    one that is a single word longer does.
    """
    halves = longer.select(F.explode(F.array("a", "b")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
    rows = shorter.join(halves, "id", "left")
    gone = F.lit(100).cast("decimal(10,0)") * F.col("most").cast("decimal(20,0)") >= F.lit(share).cast("decimal(10,0)") * F.col("f").cast("decimal(20,0)")
    return rows.filter(~F.coalesce(gone, F.lit(False))).drop("most")


def score(f: Column, n: Column, firsts: Column, lasts: Column, scale: int = SCALE) -> Column:
    """The lowest floor(scale * f * n / (l * r)) of all cuts, with its l and r; of equal ones the first cut."""
    big = lambda c: c.cast("decimal(19,0)")
    whole = (big(f) * F.lit(scale).cast("decimal(5,0)")).cast("decimal(24,0)").cast("decimal(38,0)")

    def cut(k: Column) -> Column:
        left, right = F.element_at(firsts, k), F.element_at(lasts, F.size(lasts) + 1 - k)
        value = F.call_function("div", (whole * big(n)).cast("decimal(38,0)"), (big(left) * big(right)).cast("decimal(38,0)"))
        return F.struct(value.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(firsts)), cut))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = SWALLOWED
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    levels, sizes = phrases(docs, text, lang, longest, least)
    rows = None
    for shorter, longer in zip(levels[1:], [*levels[2:], None]):
        kept = shorter if longer is None else swallowed(shorter, longer, share)
        kept = kept.select("lang", "words", "f", "firsts", "lasts")
        rows = kept if rows is None else rows.unionByName(kept)
    best = score(F.col("f"), F.col("n"), F.col("firsts"), F.col("lasts"))
    rows = rows.join(sizes, "lang").select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "n", best.alias("best"))
    rows = rows.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
