"""Quality by perplexity under a model of trusted text.

An interpolated modified Kneser-Ney bigram model is trained on trusted
documents. Counts of all bigrams and all words stay in shards, which answer
the documents' blocks. What is left for words that no trusted document holds
is shared evenly by all distinct words of the documents and one more; ``size``
limits the vocabulary on request. A trusted document is scored without its own
words and bigrams, so that perplexities of trusted and new documents compare.
Per language, the thresholds come from inner quantiles of the trusted
documents' perplexities, so that a few odd ones among them do not set a limit:
the upper one lies 1.5 interquartile ranges of the
logarithm above the upper quartile, the lower one as far below the lower
quartile or at the hundredth, whichever is less. A document within them is
kept. The quantiles are mergeable sketches of a stated accuracy. Fewer than
``enough`` trusted documents say nothing about how perplexities spread: such a
language takes the limits over all trusted documents. Perplexity tells odd
text from ordinary text, not what it says: fluent toxic documents pass.

Defined results: null and empty texts have no tokens, perplexity null, and are
not kept; a language with too few trusted documents takes the thresholds over
all trusted documents, as does a null language; with too few in all, all
documents with words are kept; repeated rows are judged one by one; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm import ngrams

FLOOR, LOW, HIGH = 0.01, 0.25, 0.75
REACH = 1.5
ACCURACY = 10_000
ENOUGH = 20
KNOWN = ("total", "one", "two", "more", "into")


def _discounts(over: np.ndarray) -> np.ndarray:
    """Discount by count (0, 1, 2, 3 and more) from the numbers of items seen once to four times."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in over[1:5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


def kneser_ney(model: ngrams.Model, size: int | None):
    """Loss of a token; the document's own counts are left out where it was trained on."""
    lower, d = _discounts(model.into[0]), _discounts(model.over[0])
    kinds = int(model.kinds[0])
    spare = (lower[1:] * [model.into[0][1], model.into[0][2], model.into[0][3:].sum()]).sum() / kinds if kinds else 1.0
    every = size or model.types + 1
    others = max(1, model.types - size) if size else 1
    cut = lambda by, n: by[np.minimum(n, 3).astype(int)]

    def loss(e: ngrams.Entries):
        t, counts = e.words[0], e.counts[0]
        mine = np.where(e.mask & 1, e.own, 0)
        c = np.maximum(counts - mine, 0)
        into = np.maximum(t["into"] - e.by_word((mine > 0) & (c == 0)), 0)
        unigram = np.maximum(into - cut(lower, into), 0) / max(kinds, 1) + spare / every
        unigram = np.where(e.other, unigram / others, unigram)
        n = np.maximum(t["total"] - e.by_context(mine), 0)
        freed = d[1] * t["one"] + d[2] * t["two"] + d[3] * t["more"] - e.by_context(cut(d, counts) - cut(d, c))
        hit = np.maximum(c - cut(d, c), 0)
        hit = np.where(e.other, hit / others, hit)
        p = np.where(n > 0, (hit + np.maximum(freed, 0.05) * unigram) / np.maximum(n, 1), unigram)
        return [-np.log(np.maximum(p, 1e-300))]

    return loss


def perplexity(docs: DataFrame, labels: DataFrame, trusted: Column, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", size: int | None = None) -> DataFrame:
    """(doc_id, lang, trusted, tokens, perplexity) per row."""
    good = labels.filter(trusted).select(F.col(doc_id).alias("_good")).filter(F.col("_good").isNotNull()).distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    is_good = F.col("_good").isNotNull()
    corpus = ngrams.encoded(rows, [F.col("doc_id"), F.col("lang"), is_good.alias("trusted")], is_good.cast("int"), (good, F.col("doc_id") == F.col("_good")), "text", size)
    model = ngrams.counts(corpus, 1, KNOWN)
    out = ngrams.sums(corpus, model, 1, kneser_ney(model, size), 1)
    return out.select("doc_id", "lang", "trusted", "tokens", F.when(F.col("tokens") > 0, F.exp(F.col("s1") / F.col("tokens"))).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, trusted: Column, floor: float = FLOOR, low: float = LOW, high: float = HIGH, reach: float = REACH, enough: int = ENOUGH, **columns) -> DataFrame:
    """Perplexities with the language's thresholds and ``kept``."""
    from flowtide.llm.work import stored

    rows = stored(perplexity(docs, labels, trusted, **columns), "perplexity")
    good = rows.filter(F.col("trusted") & F.col("perplexity").isNotNull())
    quantiles = F.percentile_approx("perplexity", F.array(F.lit(floor), F.lit(low), F.lit(high)), F.lit(ACCURACY))
    ends = lambda: F.when(F.count("*") >= enough, quantiles).alias("ends")
    own = good.groupBy("lang").agg(ends()).select(F.col("lang").alias("_lang"), F.col("ends").alias("_own"))
    every = good.agg(ends()).select(F.col("ends").alias("_every"))
    both = rows.join(own, F.col("lang") == F.col("_lang"), "left").join(every, F.lit(True), "left")  # one row beside each
    end = F.coalesce("_own", "_every")
    least, first, third = (F.get(end, F.lit(k)) for k in range(3))
    beyond = F.pow(third / first, F.lit(reach))
    both = both.withColumn("low", F.least(least, first / beyond)).withColumn("high", third * beyond)
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.col("low").isNull() & F.col("perplexity").isNotNull())
    return both.select("doc_id", "lang", "trusted", "tokens", "perplexity", "low", "high", inside.alias("kept"))
