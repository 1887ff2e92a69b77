"""Connected components of a graph in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.work import stored


def _halved(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: a node keeps the edge to its smallest neighbour, which takes over the others."""
    down = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    least = down.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "_b")
    over = down.join(least, F.col("b") == F.col("_b")).filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return over.unionByName(least.select(F.col("m").alias("a"), F.col("_b").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b).

    Each round points every node at the smallest label around it and then at
    its label's label, so paths halve. Minima are combined before the shuffle,
    so a node with very many edges costs one row per task. Rounds end when no
    label changed; only that count reaches the driver.
    """
    both = stored(_halved(edges.select("a", "b").filter(F.col("a") != F.col("b"))), "components-halved")
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "components-labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        next_ = labels.join(around, labels.node == around.a, "left").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        up = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        next_ = next_.join(up, F.col("root") == F.col("_n"), "left").select("node", F.least("root", "_r").alias("root"), "was")
        next_ = stored(next_, "components-labels")
        changed = next_.filter("root <> was").limit(1).count()
        labels = next_.select("node", "root")
        if not changed:
            return labels
