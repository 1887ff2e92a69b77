"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document and leaves one bit and its
measurement. Policies are masks over these bits: a new version of a policy, or
an ablation, reads the ledger and never the text again. Everything happens
within the row, so no group or key can become hot and nothing is shuffled.

Defined results: a null text counts as empty (no words, fails ``few_words``);
repeated rows are judged one by one; an empty table gives an empty ledger; a
column that already has the ledger's name is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.work import WHITE, fresh, words

LEDGER = "ledger"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """``fails`` gets the measurements by name; the bit is the rule's place in RULES."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", lambda m: 100 * m("n_symbols") > 10 * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    Rule("upper_case", lambda m: 100 * m("n_upper") > 40 * m("word_chars")),
    Rule("long_words", lambda m: m("word_chars") > 20 * m("n_words")),
)
BIT = {rule.name: 1 << place for place, rule in enumerate(RULES)}

# Versions are never edited: a change of policy is a new number.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_windows"),
    2: tuple(BIT),
}
PRODUCTION = 2
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper",
)


def mask(version: int, policies: Mapping[int, tuple[str, ...]] = POLICIES) -> int:
    return sum(BIT[name] for name in policies[version])


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _repeat_words(rows: DataFrame) -> DataFrame:
    """Words inside 3-word windows that the text has twice or more.

    A window's hash, its low bits replaced by the window's place, is one long
    integer; sorting these brings equal windows together, in order of place.
    """
    low = F.length(F.bin(F.size("_w")))
    item = lambda i: F.get("_w", i)
    keys = F.transform(
        F.sequence(F.lit(0), F.size("_w") - WINDOW),
        lambda i: F.call_function("shiftleft", F.call_function("shiftright", F.xxhash64(item(i), item(i + 1), item(i + 2)), F.col("_low")), F.col("_low"))
        .bitwiseOR(i.cast("bigint")),
    )
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("_low", F.coalesce(low, F.lit(0)))
    rows = rows.withColumn("_keys", F.sort_array(F.when(F.size("_w") >= WINDOW, keys).otherwise(none)))
    head = lambda x: F.call_function("shiftright", x, F.col("_low"))
    again = F.filter(
        "_keys",
        lambda x, i: (head(x) == head(F.get("_keys", i - 1))) | (head(x) == head(F.get("_keys", i + 1))),
    )
    ones = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_low")) - 1
    rows = rows.withColumn("_at", F.sort_array(F.transform(again, lambda x: x.bitwiseAND(ones))))
    gaps = F.transform("_at", lambda p, i: F.least(F.lit(WINDOW).cast("bigint"), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW).cast("bigint"))))
    return rows.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, b: a + b))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and a struct column ``ledger``: all measurements, and the failure bits of RULES."""
    kept = [c for c in docs.columns if c != LEDGER]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.withColumn("_w", words(F.col("_t")))
    rows = rows.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    size = F.length("_t").cast("bigint")
    rows = _repeat_words(
        rows.select(
            "_row", "_w",
            F.size("_w").cast("bigint").alias("n_words"),
            _without(F.col("_t"), f"[{WHITE}]+").cast("bigint").alias("word_chars"),
            (size - _without(F.col("_t"), "[#*$%&|<>]+")).alias("n_symbols"),
            F.size("_lines").cast("bigint").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
            (size - _without(F.col("_t"), "\\p{Lu}+")).alias("n_upper"),
        )
    )
    rows = rows.select("_row", *MEASURES)
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        failed = F.when(rule.fails(F.col), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("bigint")
        bits = bits.bitwiseOR(failed)
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in kept), F.struct(*MEASURES, bits.alias("fail_bits")).alias(LEDGER))


def failed(version: int) -> Column:
    """True for a ledger row that the policy rejects."""
    return F.col(f"{LEDGER}.fail_bits").bitwiseAND(F.lit(mask(version)).cast("bigint")) != 0


def accept(docs: DataFrame, version: int = PRODUCTION, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, columns unchanged."""
    had = docs.columns
    inner = docs.withColumnRenamed(LEDGER, "_had_ledger") if LEDGER in had else docs
    # A filter does not move below a projection that is not deterministic. Moved, it would repeat
    # the expression of every measurement inside the lambdas of the others.
    stay = fresh(had, "_stay")
    rows = ledger(inner, text).withColumn(stay, F.rand(0)).filter(~failed(version) & (F.col(stay) >= 0)).drop(LEDGER, stay)
    return rows.withColumnRenamed("_had_ledger", LEDGER).select(*had) if LEDGER in had else rows


def ablations(ledgers: DataFrame, version: int = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents it fails, and those that only it rejects (they return without it)."""
    bits = F.col(f"{LEDGER}.fail_bits").bitwiseAND(F.lit(mask(version)).cast("bigint"))
    names = POLICIES[version]
    sums = [F.count(F.when(bits.bitwiseAND(F.lit(BIT[n]).cast("bigint")) != 0, 1)).alias(f"f_{n}") for n in names]
    sums += [F.count(F.when(bits == BIT[n], 1)).alias(f"o_{n}") for n in names]
    cells = ", ".join(f"'{n}', f_{n}, o_{n}" for n in names)
    return ledgers.agg(*sums).selectExpr(f"stack({len(names)}, {cells}) AS (rule, n_failed, n_only_this)")
