"""How far apart the sources of a language are in their words, by three-dimensional cube partitioning.

Blocks of documents count their terms and send one row per distinct (language,
source, term); one exchange by (language, term) adds the counts up, finds the
terms that enough documents hold and their count in the whole language.

The comparison of all groups of a language is cut along three axes. A task
owns a cell: one block of groups, another block of groups, one block of terms.
It gets the two slices it needs (slices are copied along the axis they do not
depend on), computes the part of every pair's divergence that its terms give,
and these parts are added along the term axis. Only counts above zero travel:
terms that a cell does not see have the same share in both groups, so what
they add is known from the number of terms alone and is put in at the end.
A cell holds about ``GROUPS`` times ``TERMS`` numbers twice, whatever the
input's size; a source with a third of all rows is no more than one row of it.

The integers are exact: shares are cut by long division, squares stay below
2 ** 63 because a share is at most a billion and one.

Defined results: null text, language and source count as ''; groups without
terms take part; a language of one source has no pairs; without kept terms
every pair has divergence 0; ties go to the smaller item; repeated rows count
once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.tokens import runs
from flowtide.llm.vocabulary import Runs, byte_set, column, joined, labels, slices
from flowtide.llm.work import stored

LEAST_DOCS = 10
UNIT = 1_000_000_000
SMOOTH = 2
TOP = 10
BLOCK = 1_500_000
GROUPS = 64
TERMS = 4096
SMALL_ROWS = 100_000
TERM_BYTES = ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, one row per block of documents and distinct term."""
    inside = byte_set(*TERM_BYTES)

    def flush(parts, group, names) -> pa.RecordBatch:
        code, words = joined([(p.code, p.words) for p in parts])
        row = np.concatenate([p.row for p in parts])
        pair, n = np.unique(row * len(words) + code, return_counts=True)
        key = group[pair // len(words)] * len(words) + pair % len(words)
        order = np.argsort(key, kind="stable")
        begins = runs(key[order])
        total, held = np.add.reduceat(n[order], begins), np.diff(np.append(begins, len(order)))
        key = key[order][begins]
        at = pa.array(key // len(words))
        cells = [pa.array([x[k] for x in names], pa.string()).take(at) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(
            [*cells, words.take(pa.array(key % len(words))).cast(pa.string()), pa.array(total), pa.array(held)], names=["lang", "source", "term", "n", "d"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, group, names, seen, base, size = [], [], [], {}, 0, 0
        for batch in batches:
            (of_lang, langs), (of_source, sources) = labels(batch["lang"], ""), labels(batch["source"], "")
            codes = np.zeros(batch.num_rows, np.int64)
            for pair in set(zip(of_lang.tolist(), of_source.tolist())):
                name = (langs[pair[0]], sources[pair[1]])
                if name not in seen:
                    seen[name] = len(names)
                    names.append(name)
                codes[(of_lang == pair[0]) & (of_source == pair[1])] = seen[name]
            group.append(codes)
            data, offsets = column(batch["text"])
            for lo, hi in slices(data, inside):
                part = Runs(data, offsets, lo, hi, inside)
                part.row = part.row + base
                parts.append(part)
                size += len(part.code)
            base += batch.num_rows
            # Blocks end between batches, so that a document's words are counted in one block.
            if size >= BLOCK:
                yield flush(parts, np.concatenate(group), names)
                parts, group, names, seen, base, size = [], [], [], {}, 0, 0
        if size:
            yield flush(parts, np.concatenate(group), names)

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, d bigint")


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, all_n, tid, first): counts of the terms that enough documents of their language hold.

    ``all_n`` is the term's count in the language, ``tid`` its number, ``first`` marks one row of each term.
    """
    one = Window.partitionBy("lang", "term")
    # Grouping by a finer key keeps the partitioning by language and term: one exchange for all.
    rows = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select(
        "lang", "source", "term", "n", "row", F.sum("d").over(one).alias("docs"), F.sum("n").over(one).alias("all_n"), F.min("row").over(one).alias("tid")
    )
    return rows.filter(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "all_n", "tid", (F.col("row") == F.col("tid")).alias("first"))


def small(rows: DataFrame, limit: int) -> DataFrame:
    """A hint to send ``rows`` to every task if they are at most ``limit``; else they are joined by exchange."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / total), exact for counts of any size."""
    wide = (count + SMOOTH).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, total.cast("decimal(20,0)")).cast("bigint") + 1


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same in numpy: long division in three steps of a thousand."""
    rest = count + SMOOTH
    out = rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _parts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


def _cell(key, table):  # untyped: hints as text are not understood here
    """Partial divergences of the pairs of one cell, and how many terms they cover."""
    lang, i, j, _ = (k.as_py() for k in key)
    gid, block, total, tid, n = (table[c].combine_chunks() for c in ("gid", "gblock", "total", "tid", "n"))
    gid, block, total = np.asarray(gid), np.asarray(block), np.asarray(total)
    known = np.asarray(tid.is_valid())
    head = np.flatnonzero(~known)  # one row per group of the cell
    order = head[np.argsort(gid[head], kind="stable")]
    groups, side, divisor = gid[order], block[order], np.maximum(total[order], 1)
    names = table["source"].combine_chunks().take(pa.array(order)).to_pylist()
    zero = _shares(np.zeros(len(groups), np.int64), divisor)
    terms, col = np.unique(np.asarray(tid.filter(pa.array(known))).astype(np.int64), return_inverse=True)
    row = np.searchsorted(groups, gid[known])
    shares = np.repeat(zero[:, None], len(terms), axis=1)
    shares[row, col] = _shares(np.asarray(n)[known], divisor[row])
    out = {k: [] for k in ("a", "b", "zero_a", "zero_b", "part")}
    for a in np.flatnonzero(side == i):
        others = np.flatnonzero(side == j)
        others = others[others > a] if i == j else others
        part = _parts(shares[a], shares[others]).sum(axis=1) if len(terms) else np.zeros(len(others), np.int64)
        out["a"] += [names[a]] * len(others)
        out["b"] += [names[b] for b in others]
        out["zero_a"] += [int(zero[a])] * len(others)
        out["zero_b"] += zero[others].tolist()
        out["part"] += part.tolist()
    size = len(out["a"])
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array([lang] * size, pa.string()), *(pa.array(v, t) for v, t in zip(out.values(), types)), pa.array([len(terms)] * size, pa.int64())],
                    names=["lang", *out, "terms"])


def groups_of(docs: DataFrame, kept: DataFrame, lang: str, source: str, groups: int, terms: int) -> DataFrame:
    """One row per (lang, source) with its total, its language's total and how the cube of its language is cut."""
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    every = docs.select(name(lang).alias("lang"), name(source).alias("source")).groupBy("lang", "source").agg(F.count("*").alias("rows"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("whole"), F.count_if("first").alias("v"))
    sizes = every.groupBy("lang").agg(F.count("*").alias("g"))
    rows = every.join(own, ["lang", "source"], "left").join(whole.join(sizes, "lang", "right"), "lang")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "lang", "source", zero("v").alias("v"),
        (zero("own") + 2 * zero("v")).alias("total"), (zero("whole") + 2 * zero("v")).alias("lang_total"),
        F.ceil(F.col("g") / groups).cast("int").alias("gblocks"),
        F.greatest(F.ceil(zero("v") / terms), F.lit(1)).cast("int").alias("tblocks"),
        F.monotonically_increasing_id().alias("gid"),
    ).withColumn("gblock", F.pmod(F.xxhash64("source"), F.col("gblocks")).cast("int"))


def pairs(cells: DataFrame, info: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every unordered pair of groups of a language."""
    cut = ["lang", "gblocks", "gblock", "gid", "total"]
    seen = cells.select(*cut, F.pmod(F.xxhash64("tid"), F.col("tblocks")).cast("int").alias("t"), "tid", "n", F.lit(None).cast("string").alias("source"))
    own = info.select(
        *cut, F.explode(F.sequence(F.lit(0), F.col("tblocks") - 1)).alias("t"), F.lit(None).cast("bigint").alias("tid"), F.lit(0).cast("bigint").alias("n"), "source"
    )
    copies = seen.unionByName(own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("gblocks") - 1)))
    cube = copies.select(
        "lang", F.least("gblock", "other").alias("i"), F.greatest("gblock", "other").alias("j"), "t", "gid", "gblock", "total", "tid", "n", "source"
    )
    schema = "lang string, a string, b string, zero_a bigint, zero_b bigint, part bigint, terms bigint"
    parts = cube.groupBy("lang", "i", "j", "t").applyInArrow(_cell, schema)
    summed = parts.groupBy("lang", "a", "b", "zero_a", "zero_b").agg(F.sum("part").alias("part"), F.sum("terms").alias("terms"))
    size = info.groupBy("lang").agg(F.max("v").alias("v"))
    gap = F.col("zero_a") - F.col("zero_b")
    unseen = F.call_function("div", gap * gap, F.col("zero_a") + F.col("zero_b")) * (F.col("v") - F.col("terms"))
    return summed.join(size, "lang").select("lang", "a", "b", (F.col("part") + unseen).alias("value"))


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP,
    groups: int = GROUPS, terms: int = TERMS, small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): distance to each other source, and the terms that set a source apart."""
    kept = stored(kept_terms(term_counts(docs, text, lang, source), least_docs), "divergence-terms")
    info = stored(groups_of(docs, kept, lang, source, groups, terms), "divergence-groups")
    cells = kept.join(small(info, small_rows), ["lang", "source"])
    two = pairs(cells, info)
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    two = two.select("lang", sides.alias("s"), "value").select("lang", "s.*", F.lit("pair").alias("part"), "value")
    p, q = share(F.col("n"), F.col("total")), share(F.col("all_n"), F.col("lang_total"))
    marks = cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter(F.col("p") > F.col("q"))
    gap = F.col("p") - F.col("q")
    marks = marks.select("lang", "source", "item", F.lit("term").alias("part"), F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).alias("rank")
    out = ["lang", "source", "part", "item", "value", "rank"]
    return two.select("*", rank).select(out).unionByName(marks.select("*", rank).filter(F.col("rank") <= top).select(out))
