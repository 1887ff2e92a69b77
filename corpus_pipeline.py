"""From raw documents to packed training sequences, in stages.

Every stage works on all rows its predecessor kept; its decisions take effect.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import minhash_dedup, mixing, packing, quality_rules, substring_dedup
from flowtide.llm.queries import QUERIES, tokenizer_path
from flowtide.llm.work import read, stored
from flowtide.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy accepts."""
    return quality_rules.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id: five words, similarity of 0.8."""
    return minhash_dedup.dedup(docs, width=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that documents of smaller ids hold; a changed text has its new length."""
    return substring_dedup.dedup(docs, size="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source; a document taken twice is there twice."""
    return mixing.taken(mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1,024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("minhash_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs


# Packing chooses sequences by branch and bound, which SQL cannot express.
ORACLE_SQL = None
QUERIES["pipeline"] = run
