"""Language-model scores: difference of cross-entropies of two matched models.

The target model counts the trusted documents, the background model all of
them. Both are bigram models of all words with Witten-Bell interpolation. What
is left for words that a model has not counted is shared evenly by all distinct
words of the documents and one more; ``size`` limits the vocabulary on request,
the words beyond it then count as one.
A document's score is its mean loss per token under the target model less that
under the background model: below zero, it reads like the target. Each model
leaves the scored document's own bigrams out where it had counted them.

Defined results: null and empty texts have no tokens, losses and scores of
0; documents without a label belong to the background alone; a document with
several labels is trusted if one of them says so; no trusted documents at all
leave an even distribution as the target; repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm import ngrams

TARGET, BACKGROUND = 1, 2
KNOWN = ("total", "followers", "count")


def witten_bell(model: ngrams.Model, size: int):
    """Loss of a token under each model, the document's own counts left out. ``size``: words that share the unknown mass."""
    every = model.tokens

    def loss(e: ngrams.Entries):
        out = []
        for m, t in enumerate(e.words):
            mine = np.where((e.mask >> m) & 1, e.own, 0)
            alone = (e.counts[m] > 0) & (e.counts[m] == mine)  # the follower is the document's alone
            unigram = (np.maximum(t["count"] - mine, 0) + 1) / (max(every[m], 0) + size)
            total = np.maximum(t["total"] - mine, 0)
            kind = np.maximum(t["followers"] - alone, 0)
            weight = total + kind
            p = np.where(weight > 0, (np.maximum(e.counts[m] - mine, 0) + kind * unigram) / np.maximum(weight, 1), unigram)
            out.append(-np.log(np.maximum(p, unigram * 1e-6)))
        return out

    return loss


def score(docs: DataFrame, labels: DataFrame, trusted: Column, text: str = "text", doc_id: str = "doc_id", size: int | None = None) -> DataFrame:
    """(doc_id, tokens, loss_target, loss_background, score) per row; ``trusted`` is a condition on ``labels``."""
    good = labels.filter(trusted).select(F.col(doc_id).alias("_good")).filter(F.col("_good").isNotNull()).distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    models = F.when(F.col("_good").isNotNull(), TARGET | BACKGROUND).otherwise(BACKGROUND)
    corpus = ngrams.encoded(rows, [F.col("doc_id")], models, (good, F.col("doc_id") == F.col("_good")), "text", size)
    model = ngrams.counts(corpus, 2, KNOWN)
    out = ngrams.sums(corpus, model, 2, witten_bell(model, size or model.types + 1), 2)
    mean = lambda c: F.when(F.col("tokens") > 0, F.col(c) / F.col("tokens")).otherwise(F.lit(0.0))
    out = out.select("doc_id", "tokens", mean("s1").alias("loss_target"), mean("s2").alias("loss_background"))
    return out.withColumn("score", F.col("loss_target") - F.col("loss_background"))
