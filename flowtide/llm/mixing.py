"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target in tokens (words): its share of the whole mix by
weight, at most ``cap`` times what it has; what a source cannot take is shared
again by weight among the others. Documents of a source stand in hashed order.
A document's virtual finish time is the source's tokens up to and with it,
divided by the source's target, so that at time 1 every source has given what
it should. All sources' documents in order of finish time, cut where the total
reaches the budget, are the mix. A source that must give more than it has
starts again with the same order: the second round's times follow the first's.

Scale: order keys are content hashes, so a source falls into ranges of equal
expected size by the key's leading digits, and finish times fall into slices of
equal expected tokens. Running totals add a small table of range totals to
totals within a range; a source with a third of all rows is spread over as many
ranges as its rows need. No text is shuffled: what is taken follows from one
cut per source, which is compared with each row's own key.

Defined results: null text has size 0; a null source is a source, last in
order; rows equal in id and text move together; documents of size 0 are taken
with their neighbours; no rows or no words at all give targets of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.work import fresh, identity, stored, words

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the mix holds 3/2 of all words
CAP = 2
RANGE_ROWS = 20_000


def sizes(docs: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    """One narrow row per document: source, order key, size."""
    return docs.select(
        F.col(source).alias("source"),
        identity(F.col(doc_id), F.col(text)).alias("key"),
        F.size(words(F.col(text))).cast("bigint").alias("size"),
    )


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """source, place, weight, source_size, target: one row per source, in code point order, null last."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*(F.lit(w) for w in weights)), place % len(weights)).cast("bigint")
    per = stored(per.select("source", "source_size", place.alias("place"), weight.alias("weight")), "mix-sources")
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    budget = total * share[0] / share[1]
    # Water level: raise it until no source beyond its cap is still counted by weight.
    level, capped = 0.0, F.lit(False)
    while True:
        now = per.agg(
            F.coalesce(F.sum(F.when(capped, F.lit(cap) * F.col("source_size"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        nearer = (budget - now.full) / now.open if now.open else level
        if nearer <= level:
            break
        level = nearer
        capped = F.lit(level) * F.col("weight") > F.lit(cap) * F.col("source_size")
    limit = F.lit(cap) * F.col("source_size")
    return per.withColumn("target", F.when(capped, limit.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def _digits(count: int) -> int:
    """Leading hex digits of a key that cut ``count`` rows into ranges of about RANGE_ROWS."""
    digits = 1
    while 16**digits * RANGE_ROWS < count and digits < 7:
        digits += 1
    return digits


def queue(rows: DataFrame, plan: DataFrame, cap: int = CAP) -> DataFrame:
    """Rows (source, place, key, size, round, finish): every document once per round."""
    rows = rows.groupBy("source", "key").agg(F.sum("size").alias("size"))
    digits = _digits(rows.count())
    rows = stored(rows.withColumn("part", F.substring("key", 1, digits)), "mix-ranges")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("base", F.coalesce(F.sum("part_size").over(before), F.lit(0))).drop("part_size")
    within = Window.partitionBy("source", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    r, p, s = rows.withColumn("own", F.sum("size").over(within)).alias("r"), parts.alias("p"), plan.alias("s")
    cum = (
        r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part")))
        .join(s, F.col("r.source").eqNullSafe(F.col("s.source")))
        .select("r.source", "s.place", "r.key", "r.size", "s.source_size", "s.target", (F.col("own") + F.col("base")).alias("cum"))
    )
    rounds = cum.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    done = (F.col("cum") + F.col("round") * F.col("source_size")).cast("double")
    finish = F.when(F.col("target") > 0, done / F.col("target")).otherwise(F.lit(0.0))
    return rounds.select("source", "place", "key", "size", "round", finish.alias("finish"))


def cuts(line: DataFrame, budget: float, slices: int) -> DataFrame:
    """source, round, last: the greatest key of the source that the mix takes in that round."""
    at = F.least(F.floor(F.col("finish") * slices), F.lit(4 * slices)).cast("bigint")
    line = stored(line.withColumn("slice", at), "mix-line")
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    sums = line.groupBy("slice").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(upto))
    over = sums.filter(F.col("upto") > budget).agg(F.min("slice").alias("slice"), F.min(F.struct("slice", (F.col("upto") - F.col("n")).alias("before"))).alias("m")).first()
    order = ("finish", "place", "round", "key")
    if over.slice is None:
        taken = line
    else:
        within = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        edge = line.filter(F.col("slice") == over.slice).withColumn("upto", F.sum("size").over(within) + over.m.before)
        last = edge.filter(F.col("upto") <= budget).agg(F.max(F.struct(*order)).alias("last")).first().last
        inside = F.col("slice") < over.slice
        if last is not None:
            key = F.struct(*(F.lit(last[c]).cast(dict(line.dtypes)[c]).alias(c) for c in order))
            inside |= F.struct(*order) <= key
        taken = line.filter(inside)
    return taken.groupBy("source", "round").agg(F.max("key").alias("last"))


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP,
) -> DataFrame:
    """``docs`` and a struct column ``mix``: size, copies (0 to ``cap``), source_size, target. An existing column of that name is replaced."""
    rows = stored(sizes(docs, text, source, doc_id), "mix-sizes")
    plan = stored(targets(rows, weights, share, cap), "mix-targets")
    total = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    budget = total * share[0] / share[1]
    line = queue(rows, plan, cap)
    digits = _digits(rows.count())
    ends = cuts(line, budget, max(64, 16**digits))
    per = plan.join(ends.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
    per = per.groupBy("source", "source_size", "target").agg(F.collect_list("last").alias("lasts"))  # at most cap keys

    kept = [c for c in docs.columns if c != "mix"]
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(source).alias("_source"),
        identity(F.col(doc_id), F.col(text)).alias("_key"), F.size(words(F.col(text))).cast("bigint").alias("_size"),
    )
    both = own.join(per, F.col("_source").eqNullSafe(F.col("source")))
    copies = F.size(F.filter("lasts", lambda last: F.col("_key") <= last))
    return both.select(
        *(F.col("_row").getField(c).alias(c) for c in kept),
        F.struct(F.col("_size").alias("size"), copies.alias("copies"), "source_size", "target").alias("mix"),
    )


def taken(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns of the input."""
    rest = [c for c in mixed.columns if c != "mix"]
    times = fresh(mixed.columns, "_times")
    repeated = mixed.filter(F.col("mix.copies") > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col("mix.copies"))))
    return repeated.select(*(F.col(f"`{c}`") for c in rest))
