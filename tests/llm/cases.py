"""Small documents with everything that may go wrong in a column, and plain forms of the rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        *(T.StructField(n, T.StringType()) for n in ("ledger", "mix", "license_scan", "id", "th", "places", "_row", "_id", "key", "size")),
    ]
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \t\n", "word", "two words", "Same line\nSame line\n\nSame line", "tab\tand\x0bfeed\x0c end ",
    "Ünïcode straße naïve Ünïcode straße naïve", "a b c a b c", "LOUD WORDS ONLY HERE " * 20, "sym $$$ *** ||| " * 30,
    "Released under the MIT License. And under the mit license again", "see CC-BY-NC 4.0 and Apache License, Version 2.0",
    "This work is licensed under the GNU General Public License, version 3.", "under the mit K license", "x <|endoftext|> y",
]


def documents(seed: int = 0, copies: int = 12) -> list[tuple]:
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ba", "ko", "ri", "té", "su") for b in ("n", "lo", "mer", "ti", "dak", "x,", "p.")]
    some = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, base = some(60), some(90).split()
    texts = list(TEXTS)
    for _ in range(copies):
        edited = list(base)
        for _ in range(r.randrange(0, 9)):
            edited[r.randrange(len(edited))] = f"e{r.randrange(10**6)}"
        texts += [" ".join(edited), f"{some(r.randrange(1, 40))}\n{shared} {some(r.randrange(1, 70))}", some(r.randrange(1, 160))]
    texts += [texts[-1], texts[-2], some(3000), "go " * 500]
    rows = [(n, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "c", "d", None]), len(t or "")) for n, t in enumerate(texts)]
    r.shuffle(rows)
    rows += [rows[0], rows[5], (None, some(40), None, None, None)]
    return [(*row, *["kept"] * 10) for row in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id") if rows else spark.createDataFrame([], SCHEMA)


def words(text) -> list[str]:
    return WORD.findall(text or "")


def lower(text) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})
