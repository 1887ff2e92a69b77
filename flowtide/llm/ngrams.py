"""Bigram models of all words, counted and looked up in shards.

A word is its 64-bit hash, a bigram the hash of its two words; neither the
words nor the bigrams are limited in number. A block of documents sends its
distinct bigrams with counts once: a shard adds them up, answers every block
with the sums of the bigrams it sent, and passes what they say about single
words (how many followers, how many contexts) to the shards of words. These get
the block's distinct words with its own sums and answer in the same way. The
answers meet the block's tokens again; as they come in the block's order, no
hash travels a second time. No table of words or bigrams goes to every task;
numbers over the whole model (counts of counts, sums) do.

What travels would take more disk at once than the blocks themselves. So the
shards, and at the end the blocks, are taken in ``TURNS`` turns, each stored
before the next begins, and what a turn shuffled is removed when it is stored.
Every bigram, word and block has one turn.

Words have ``side`` classes, and the bigrams of each pair of classes a shard of
their own: a common word is spread over ``side`` shards, and a block names a
word to at most twice as many.

A caller may limit the vocabulary to the commonest ``size`` words; the others
are then one word OTHER. Without a limit only words that a model has never
counted are unknown to it.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from flowtide.llm.tokens import Words, mix, packed, pieces, rising, risen, runs, spread, unpacked
from flowtide.llm.work import released, stored, text_bytes

# Keys that stand for no word of a text; both count in a limited vocabulary.
OTHER, BEGIN = 0, 1
FIRST = 2
BLOCK = 2_000_000
ENTRIES = 400_000  # scored at once; one longer document is taken whole
SHARD_BYTES = 24e6
TURNS = 6
# What can be known of a word: tokens after it, distinct bigrams that it begins (all, or seen so often), contexts, tokens.
BY_BLOCK = ("total", "count")
BY_CONTEXT = {"followers": lambda n: n > 0, "one": lambda n: n == 1, "two": lambda n: n == 2, "more": lambda n: n > 2}
INTO = "into"
PARTS = "kind int, shard int, block bigint, blob binary, stats array<bigint>"


@dataclass
class Corpus:
    """rows: (block, blob); size: limit of the vocabulary or none; side: classes of words; turns: in which shards and blocks are taken."""

    rows: DataFrame
    meta: list[tuple[str, str, pa.DataType]]
    size: int | None
    side: int
    turns: int


@dataclass
class Model:
    """bigrams, words: (shard, block, blob), the answers; types: distinct words of all documents; over, into: per model, how
    many bigrams were counted and words followed 0 to 4 and more times; kinds, tokens: distinct and all bigrams per model;
    known: what is known of a word."""

    bigrams: DataFrame
    words: DataFrame
    types: int
    over: np.ndarray
    into: np.ndarray
    kinds: np.ndarray
    tokens: np.ndarray
    known: tuple[str, ...]


@dataclass
class Entries:
    """Distinct bigrams per document: own, the document's count; mask; per model the bigram's count and what is known of its words."""

    own: np.ndarray
    mask: np.ndarray
    other: np.ndarray
    counts: list[np.ndarray]
    words: list[dict[str, np.ndarray]]
    context: np.ndarray
    word: np.ndarray

    def by_context(self, values: np.ndarray) -> np.ndarray:
        """Sum over the entries of the same document and context."""
        return np.bincount(self.context, values)[self.context]

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, values)[self.word]


def vocabulary(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Sorted hashes of the ``size`` commonest words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                word, many = np.unique(Words(part["text"], lower=True).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(many.astype(np.int64))], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, "word bigint, n bigint")
    words = rows.groupBy("word").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.col("n").desc(), "word").limit(size - FIRST).select("word").collect()  # bounded by ``size``
    return np.sort(np.array([r.word for r in top], np.int64).view(np.uint64))


def encoded(docs: DataFrame, meta: list[Column], models: Column, on: tuple[DataFrame, Column] | None, text: str, size: int | None = None) -> Corpus:
    """``docs`` as blocks of word hashes. meta: columns to carry; ``on``: a table to join by its condition first.

    models: bits of the models that count the document.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, text, size)) if size else None
    # Stored first, the table's true size is known, and Spark need not deal the texts to join a small one.
    rows = docs if on is None else docs.join(stored(on[0], "ngram-labels"), on[1], "left")
    rows = rows.select(F.struct(*meta).alias("meta"), models.cast("int").alias("models"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    side = max(1, math.ceil(math.sqrt(text_bytes(docs, text) / SHARD_BYTES)))

    def block(held: list[tuple], number: int) -> pa.RecordBatch:
        meta, models, count, hashes = zip(*held)
        word, token = np.unique(np.concatenate(hashes), return_inverse=True)
        order = np.argsort(_shard(word, side * side), kind="stable")  # by shard, then hash
        place = np.empty(len(word), np.uint32)
        place[order] = np.arange(len(word))
        raw = np.frombuffer(pickle.dumps([m for part in meta for m in part]), np.uint8)
        blob = packed(raw, np.concatenate(models).astype(np.uint8), np.concatenate(count).astype(np.uint32), place[token], rising(word[order]))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary())], names=["block", "blob"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch):
                w = Words(part["text"], lower=True)
                h = w.hash
                if known is not None:
                    h = np.where(np.isin(h, known.value), h, np.uint64(OTHER))
                held.append((part["meta"].to_pylist(), np.asarray(part["models"]), w.count, h))
                n += len(h)
                if n >= BLOCK:
                    yield block(held, number)
                    held, n, number = [], 0, number + 1
        if held:
            yield block(held, number)

    kept = stored(rows.mapInArrow(cut, "block bigint, blob binary"), "ngram-blocks")
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [(f.name, f.dataType.simpleString(), to_arrow_type(f.dataType)) for f in rows.schema["meta"].dataType.fields]
    return Corpus(kept, fields, size, side, min(TURNS, side * side))


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(context) * np.uint64(31) + word)


def _shard(key: np.ndarray, count: int) -> np.ndarray:
    return ((mix(key) >> np.uint64(33)) % np.uint64(count)).astype(np.int32)


class Block:
    """A block's tokens, each by the places of its word and the one before; the place after the last is that of BEGIN."""

    def __init__(self, models: np.ndarray, count: np.ndarray, token: np.ndarray, words: int):
        self.models, self.words = models, words
        self.count = count.astype(np.int64)
        self.token = token.astype(np.int32)  # half the memory; a block has far fewer words and documents
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[(np.cumsum(self.count) - self.count)[self.count > 0]] = words
        self.doc = np.repeat(np.arange(len(count), dtype=np.int32), self.count)

    def sums(self, places: np.ndarray, many: int, models: int) -> list[np.ndarray]:
        """How often each model counts each place."""
        mask = self.models[self.doc]
        return [np.bincount(places, (mask >> m) & 1, many).astype(np.uint32) for m in range(models)]


def _cells(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard's items, in their order."""
    order = np.argsort(shard, kind="stable")
    begins = runs(shard[order])
    for lo, hi in zip(begins, np.append(begins[1:], len(order))):
        yield int(shard[order[lo]]), order[lo:hi]


class Pairs:
    """A block's distinct bigrams and their shards. shard: of the words, with BEGIN; turn: the number of one turn and of all."""

    def __init__(self, block: Block, shard: np.ndarray, side: int, turn: tuple[int, int] = (0, 1)):
        kind = (shard % side).astype(np.int32)
        kept = slice(None)
        if turn[1] > 1:
            kept = np.flatnonzero((kind[block.before] * side + kind[block.token]) % turn[1] == turn[0])
        self.models, self.doc = block.models, block.doc[kept]
        pair = block.before[kept].astype(np.int64)
        pair *= block.words + 1
        pair += block.token[kept]
        pair, back = np.unique(pair, return_inverse=True)
        self.pair = back.astype(np.int32)
        self.context, self.word = (x.astype(np.int32) for x in np.divmod(pair, block.words + 1))
        self.shard = kind[self.context] * side + kind[self.word]

    def own(self, models: int) -> list[np.ndarray]:
        """How often each model counts the bigrams."""
        mask = self.models[self.doc]
        return [np.bincount(self.pair, (mask >> m) & 1, len(self.word)).astype(np.uint32) for m in range(models)]


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32 if not len(values) or values.max() < 1 << 32 else np.uint64)


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["kind", "shard", "block", "blob", "stats"])


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()))], names=["shard", "block", "blob"])


def _parted(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _histogram(values: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(values, 5).astype(int), minlength=6).tolist()


def counts(corpus: Corpus, models: int, known: tuple[str, ...]) -> Model:
    """``known``: what the loss asks of words, of ``BY_BLOCK``, ``BY_CONTEXT`` and ``INTO``."""
    side, turns = corpus.side, corpus.turns
    many = side * side
    by_block = [k for k in BY_BLOCK if k in known or k == BY_BLOCK[0]]
    by_context = [k for k in BY_CONTEXT if k in known]
    into = [INTO] if INTO in known else []
    columns = [*by_block, *by_context, *into]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, np.ndarray]]:
        for batch in batches:
            for ident, blob in zip(batch["block"].to_pylist(), batch["blob"].to_pylist()):
                _, mask, count, token, word = unpacked(blob)
                yield ident, Block(mask, count, token, len(word)), np.append(risen(word), np.uint64(BEGIN))

    def pairs(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        for ident, block, hashes in opened(batches):
            b = Pairs(block, _shard(hashes, many), side, (turn, turns))
            per, rows = b.own(models), []
            for s, take in _cells(b.shard):
                context, word = b.context[take], b.word[take]
                first = runs(context)
                named, back = np.unique(word, return_inverse=True)
                follow = np.diff(np.append(first, len(take)))
                rows.append((s, ident, packed(rising(hashes[context[first]]), follow.astype(np.uint32), rising(hashes[named]), back.astype(np.uint32), *(p[take] for p in per))))
            yield _sent(rows)

    def add(key, table):  # untyped: hints as text are not understood here
        context, word, per, sizes = [], [], [[] for _ in range(models)], []
        for blob in table["blob"]:
            first, follow, named, back, *own = unpacked(blob.as_py())
            context.append(np.repeat(risen(first), follow)), word.append(risen(named)[back]), sizes.append(len(back))
            for p, o in zip(per, own):
                p.append(o)
        context, word = np.concatenate(context), np.concatenate(word)
        pair = _pair(context, word)
        order = np.argsort(pair)
        begins = runs(pair[order])
        del pair  # a shard's arrays are the largest of all: no more of them at once than needed
        per = [np.add.reduceat(np.concatenate(p)[order], begins, dtype=np.uint64) for p in per]
        back = np.empty(len(order), np.int32)
        back[order] = spread(np.arange(len(begins), dtype=np.int32), begins, len(order))
        first = order[begins]
        del order
        answers = zip(*(_parted(_small(p)[back], sizes) for p in per))
        rows = [(0, key[0].as_py(), ident, packed(*a), None) for ident, a in zip(table["block"].to_pylist(), answers)]
        context, word = context[first], word[first]
        rows[0] = (*rows[0][:4], [n for p in per for n in _histogram(p)])
        counted = np.any([p > 0 for p in per], 0)
        for hashes, wanted in ((context, [(m, k) for m in range(models) for k in by_context]), (word, [(m, k) for m in range(models) for k in into])):
            if wanted and counted.any():
                of, back = np.unique(hashes[counted], return_inverse=True)
                got = [np.bincount(back, (BY_CONTEXT[k] if k in BY_CONTEXT else BY_CONTEXT["followers"])(per[m][counted]), len(of)) for m, k in wanted]
                for s, take in _cells(_shard(of, many)):
                    rows.append((1 if hashes is context else 2, s, None, packed(rising(of[take]), *(_small(g[take]) for g in got)), None))
        return _rows(rows)

    def words(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        for ident, b, hashes in opened(batches):
            places = {"total": b.before, "count": b.token}
            sums = [n for by_model in zip(*(b.sums(places[k], len(hashes), models) for k in by_block)) for n in by_model]
            cells = [(s, c) for s, c in _cells(_shard(hashes, many)) if s % turns == turn]  # BEGIN is the last of its shard
            yield _sent([(s, ident, packed(rising(hashes[c]), *(n[c] for n in sums))) for s, c in cells])

    def gather(key, left, right):  # untyped: hints as text are not understood here
        cells = [unpacked(b.as_py()) for b in left["blob"]]
        sizes = [len(c[0]) for c in cells]
        hashes, back = np.unique(np.concatenate([risen(c[0]) for c in cells]), return_inverse=True)
        got = {(m, k): np.bincount(back, np.concatenate([c[1 + m * len(by_block) + n] for c in cells])) for m in range(models) for n, k in enumerate(by_block)}
        for names, kind in ((by_context, 1), (into, 2)):
            told = [unpacked(b.as_py()) for b, k in zip(right["blob"], right["kind"].to_pylist()) if k == kind]
            at = np.searchsorted(hashes, np.concatenate([risen(c[0]) for c in told])) if told else np.zeros(0, np.int64)
            for n, (m, k) in enumerate((m, k) for m in range(models) for k in names):
                got[m, k] = np.bincount(at, np.concatenate([c[1 + n] for c in told]) if told else None, len(hashes))
        got = {k: v.astype(np.uint64) for k, v in got.items()}
        answers = zip(*(_parted(_small(got[m, k])[back], sizes) for m in range(models) for k in columns))
        rows = [(0, key[0].as_py(), ident, packed(*a), None) for ident, a in zip(left["block"].to_pylist(), answers)]
        stats = [int((hashes != np.uint64(BEGIN)).sum())]
        for m in range(models):
            stats += [*(_histogram(got[m, INTO]) if into else [0] * 6), int(got[m, "total"].sum())]
        rows[0] = (*rows[0][:4], stats)
        return _rows(rows)

    def totals(rows: DataFrame, width: int) -> np.ndarray:
        """One row of ``width`` numbers."""
        row = rows.agg(*(F.coalesce(F.sum(F.get("stats", F.lit(k))), F.lit(0)) for k in range(width))).first()
        return np.array(list(row), np.int64)

    def dealt(make: Callable, turn: int) -> GroupedData:
        return corpus.rows.mapInArrow(lambda batches: make(batches, turn), "shard int, block bigint, blob binary").groupBy("shard")

    with released(corpus.rows.sparkSession):
        parts = _all([stored(dealt(pairs, turn).applyInArrow(add, PARTS), "ngram-counts") for turn in range(turns)])
        told = parts.filter("kind > 0").select("shard", "kind", "blob")
        heard = [told.filter(F.col("shard") % turns == turn).groupBy("shard") for turn in range(turns)]
        found = _all([stored(dealt(words, turn).cogroup(heard[turn]).applyInArrow(gather, PARTS), "ngram-words") for turn in range(turns)])
        over = totals(parts.filter("kind = 0"), 6 * models).reshape(models, 6)
        types, *rest = totals(found, 1 + 7 * models)
    rest = np.array(rest).reshape(models, 7)
    answers = [rows.select("shard", "block", "blob") for rows in (parts.filter("kind = 0"), found)]
    return Model(*answers, int(types), over, rest[:, :6], over[:, 1:].sum(1), rest[:, 6], tuple(columns))


def sums(corpus: Corpus, model: Model, models: int, loss: Callable[[Entries], list[np.ndarray]], width: int) -> DataFrame:
    """(meta.*, tokens, s1 .. s``width``): per document the sum of ``loss`` over its tokens.

    loss(entries): ``width`` arrays of values, with the document's own counts
    still inside where the mask has the model's bit.
    """
    side, known = corpus.side, model.known
    of_begin = int(_shard(np.array([BEGIN], np.uint64), side * side)[0])
    of_other = int(_shard(np.array([OTHER], np.uint64), side * side)[0]) if corpus.size else None

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, blob in zip(batch["block"].to_pylist(), batch["blob"].to_pylist()):
                *head, word = unpacked(blob)
                has_other = len(word) and bool((risen(word) == OTHER).any())
                yield _sent([(0, ident, packed(*head, np.array([has_other], np.uint8)))])

    names = [*(n for n, _, _ in corpus.meta), "tokens", *(f"s{k + 1}" for k in range(width))]

    def total(key, table):  # untyped: hints as text are not understood here
        got = {(k, s): x for k, s, x in zip(table["kind"].to_pylist(), table["shard"].to_pylist(), table["blob"].to_pylist())}
        raw, mask, count, token, has_other = unpacked(got.pop((2, 0)))
        meta = pickle.loads(raw.tobytes())
        told = {s: unpacked(got.pop((k, s))) for k, s in sorted(got) if k == 1}
        # The words lie by shard; BEGIN is the last of its own and has the last place here.
        begin = [c[-1:] for c in told[of_begin]]
        told[of_begin] = [c[:-1] for c in told[of_begin]]
        words = [np.concatenate([*c, b]) for c, b in zip(zip(*told.values()), begin)]
        shard = np.append(np.repeat(list(told), [len(c[0]) for c in told.values()]), of_begin)
        del told
        b = Pairs(Block(mask, count, token, len(shard) - 1), shard, side)
        found = [np.zeros(len(b.word)) for _ in range(models)]
        for s, take in _cells(b.shard):
            for f, values in zip(found, unpacked(got.pop((0, s)))):
                f[take] = values
        # OTHER has the smallest hash of its shard.
        other = int(np.searchsorted(shard[:-1], of_other)) if has_other[0] else -1
        kinds = max(len(b.word), 1)
        entry, own = np.unique(b.doc.astype(np.int64) * kinds + b.pair, return_counts=True)
        del token, b.doc, b.pair  # the entries hold them
        out = np.zeros((width, len(meta)))
        begins = np.searchsorted(entry // kinds, np.arange(len(meta) + 1))
        cuts = np.unique(np.append(np.searchsorted(begins, np.arange(0, len(entry), ENTRIES), "left"), len(meta)))
        for first, last in zip(cuts, cuts[1:]):
            part = slice(begins[first], begins[last])
            doc, pair = entry[part] // kinds, entry[part] % kinds
            context, word = b.context[pair], b.word[pair]
            per = [
                {k: words[m * len(known) + n][word if k in (INTO, "count") else context].astype(np.float64) for n, k in enumerate(known)}
                for m in range(models)
            ]
            group = lambda x: np.unique(doc * len(shard) + x, return_inverse=True)[1]  # noqa: B023, E731
            entries = Entries(own[part].astype(np.float64), b.models[doc], word == other, [f[pair] for f in found], per, group(context), group(word))
            for o, values in zip(out, loss(entries) if len(doc) else ()):
                o += np.bincount(doc, values * own[part], len(meta))
        cols = [pa.array([m[n] for m in meta], t) for n, _, t in corpus_meta]
        return pa.table([*cols, pa.array(count, pa.int64()), *(pa.array(o) for o in out)], names=names)

    corpus_meta = corpus.meta
    fields = [*((n, t) for n, t, _ in corpus.meta), ("tokens", "bigint"), *((f"s{k + 1}", "double") for k in range(width))]
    out = []
    with released(corpus.rows.sparkSession):
        for turn in range(corpus.turns):
            place = F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))  # a partition's blocks, the last of them small, go to several turns
            bigrams, words, blocks = (rows.filter(place % corpus.turns == turn) for rows in (model.bigrams, model.words, corpus.rows))
            blocks = blocks.mapInArrow(heads, "shard int, block bigint, blob binary")
            answers = _all([rows.withColumn("kind", F.lit(kind)) for kind, rows in enumerate((bigrams, words, blocks))])
            out.append(stored(answers.groupBy("block").applyInArrow(total, ", ".join(f"{n} {t}" for n, t in fields)), "ngram-sums"))
    return _all(out)
