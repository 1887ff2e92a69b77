"""Exact top-k inner products by three-phase uniform threshold.

The dimensions are cut into parts; each part ranks all vectors by its share of
the inner product. Phase one gathers the k best of every part's local lists and
scores these few vectors exactly: the k-th best of them is a score the answer
must reach. Divided by the number of parts it is the cutoff that goes back with
the queries: a vector below it in every part cannot reach the k-th best. Phase
two collects the vectors that reach the cutoff in a part and whose bound (known
shares, the cutoff for each share that is missing) still reaches the score.
Phase three fills in the missing shares of these entries, which the block still
holds, and passes on what reaches the score. Queries meet vectors in blocks of
both.

Vectors with equal components score alike, so only the k + 1 with the smallest
ids of each take part; Spark limits these groups before it shuffles them.

Defined results: vectors that are null or hold a null or non-finite component
take no part, as query or candidate; shorter vectors count as padded with
zeros; ties go to the smaller id; a query with fewer than k candidates gets
all; rows without id take no part; repeated rows of one id are one candidate;
scores are 64-bit integers; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.work import stored

SCALE = 256
PARTS = 2
BLOCK = 2048
ENTRIES = 20_000
BROADCAST_BYTES = 32_000_000
NO_CUT = -(1 << 62)


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): valid vectors as floor(scale * x), one row per id (the smallest vector of repeated ids)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    valid = rows.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite)
    return valid.select(F.col(vec_id).cast("bigint").alias("vec_id"), ints.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    ends = np.asarray(column.offsets)
    flat = np.asarray(column.values)
    lengths = np.diff(ends)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], lengths)] = flat[ends[0] : ends[-1]]
    return out


def blocks(rows: DataFrame, width: int, more: str = "") -> DataFrame:
    """Rows packed by the block: (block, ids, vectors[, more]) as 64-bit integers."""
    names = ["ids", "vectors"] + ([more] if more else [])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                cells = [np.asarray(part["vec_id"]).tobytes(), _matrix(part["v"], width).tobytes()]
                if more:
                    cells.append(np.asarray(part[more]).astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=names)

    packed = rows.select("vec_id", "v", *([more] if more else [])).mapInArrow(pack, ", ".join(f"{n} binary" for n in names))
    return packed.withColumn("block", F.monotonically_increasing_id())


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _meet(candidates: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """Every block of queries next to every block of candidates; sent to all tasks only if known to be small."""
    q = stored(queries, "topk-queries")
    number = q.select(F.row_number().over(Window.orderBy("block")).alias("n"), "block")  # one row per 2,048 queries
    q = q.join(number, "block").drop("block")
    many = q.count()
    left = candidates.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(many)))) if many else candidates.withColumn("n", F.lit(0))
    right = q.select("n", *(F.col(c).alias(f"q_{c}") for c in q.columns if c != "n"))
    return left.join(F.broadcast(right) if size < BROADCAST_BYTES else right, "n")


def _best(rows: DataFrame, by: list[str], score: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (query_id, vec_id) with their whole inner product as ``score``."""
    q = vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    c = vectors.select("vec_id", F.col("v").alias("c"))
    n = F.least(F.size("q"), F.size("c"))
    terms = F.zip_with(F.slice("q", 1, n), F.slice("c", 1, n), lambda a, b: a * b)
    return pairs.join(q, "query_id").join(c, "vec_id").select("query_id", "vec_id", F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("score"))


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    scale: int = SCALE, parts: int = PARTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row that satisfies ``is_query``, a condition on ``vec_id``."""
    vectors = stored(integer_vectors(rows, vec_id, vector, scale), "topk-vectors")
    shape = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.count("*").alias("n")).first()
    width = max(1, shape.width)
    edges = [width * p // parts for p in range(parts + 1)]
    alike = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    candidates = stored(blocks(vectors.withColumn("_r", alike).filter(F.col("_r") <= k + 1).drop("_r"), width), "topk-blocks")
    asked = vectors.filter(is_query)
    size = asked.count() * width * 8

    def unpack(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, ...]:
        q = np.frombuffer(batch["q_ids"][row].as_py(), np.int64)
        c = np.frombuffer(batch["ids"][row].as_py(), np.int64)
        qv = np.frombuffer(batch["q_vectors"][row].as_py(), np.int64).reshape(len(q), width)
        cv = np.frombuffer(batch["vectors"][row].as_py(), np.int64).reshape(len(c), width)
        return q, c, qv, cv

    def local_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, c, qv, cv = unpack(batch, row)
                for p in range(parts):
                    share = _products(qv[:, edges[p] : edges[p + 1]], cv[:, edges[p] : edges[p + 1]])
                    share[q[:, None] == c[None, :]] = NO_CUT
                    top = np.argsort(-share, 1, kind="stable")[:, :k] if share.shape[1] <= k else np.argpartition(-share, k - 1, 1)[:, :k]
                    value = np.take_along_axis(share, top, 1)
                    keep = value > NO_CUT
                    who = np.broadcast_to(np.arange(len(q))[:, None], top.shape)[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q[who]), pa.array(np.full(len(who), p, np.int32)), pa.array(c[top[keep]]), pa.array(value[keep])],
                        names=["query_id", "part", "vec_id", "share"],
                    )

    first = _meet(candidates, blocks(asked, width), size).mapInArrow(local_lists, "query_id bigint, part int, vec_id bigint, share bigint")
    listed = _best(first, ["query_id", "part"], "share", k).select("query_id", "vec_id").distinct()
    known = exact(listed, vectors).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s"))  # at most parts * k
    cut = known.select(F.col("query_id").alias("_q"), F.get("s", F.lit(k - 1)).alias("_cut"))
    again = asked.join(cut, F.col("vec_id") == F.col("_q"), "left").select("vec_id", "v", F.coalesce("_cut", F.lit(NO_CUT)).alias("cut"))

    def sufficient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, c, qv, cv = unpack(batch, row)
                goal = np.frombuffer(batch["q_cut"][row].as_py(), np.int64)
                each = -(-goal // parts)  # the least whole number not under goal / parts
                sure = np.zeros((len(q), len(c)), np.int64)
                missing = np.zeros((len(q), len(c)), np.int8)
                for p in range(parts):
                    share = _products(qv[:, edges[p] : edges[p + 1]], cv[:, edges[p] : edges[p + 1]])
                    reached = share >= each[:, None]
                    sure += np.where(reached, share, 0)
                    missing += ~reached
                bound = sure + missing * (each[:, None] - 1)
                i, j = np.nonzero((missing < parts) & (bound >= goal[:, None]) & (q[:, None] != c[None, :]))
                for lo in range(0, len(i), ENTRIES):
                    a, b = i[lo : lo + ENTRIES], j[lo : lo + ENTRIES]
                    score = sure[a, b]
                    rest = missing[a, b] > 0
                    score[rest] = (qv[a[rest]] * cv[b[rest]]).sum(1)
                    keep = score >= goal[a]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q[a[keep]]), pa.array(c[b[keep]]), pa.array(score[keep])], names=["query_id", "vec_id", "score"]
                    )

    entries = _meet(candidates, blocks(again, width, "cut"), size).mapInArrow(sufficient, "query_id bigint, vec_id bigint, score bigint")
    return _best(entries, ["query_id"], "score", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
