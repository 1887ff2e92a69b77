"""Near-duplicate documents: MinHash signatures in an LSH forest, links confirmed on full sets.

A document is the set of its word shingles. Equal sets are one node from the
start. Every tree of the forest orders the nodes by its own part of the
signature, and a task walks through a range of that order: within runs that
share a prefix, neighbours by longest common prefix whose signatures agree in
at least ESTIMATE of all values become candidate links, as few as keep the
run's candidates connected. A run is looked at in stretches of REGION nodes
that overlap by a quarter. Where more than REGION nodes share a prefix, the
region is also cut by longer and longer prefixes, each part as often as it
needs, until a part is small enough to be compared as a whole; every node of a
part that is not is held against the part's first node, so that parts stay
connected. Nodes that agree in all values hang on their first node.

Connected candidates form a family. Families get their full shingle sets, and
every two members of a family are compared exactly; what leaves a task are
links that span the classes found there, never all pairs. A large family is
compared page by page, each pair of pages in a task of its own. Components of
the confirmed links are the result.

With 3 values per tree and 24 trees, two sets at similarity 0.8 share no
tree's prefix with a chance below 4e-8. In a tree where that prefix is dense
they meet if they also share the longer prefix of a small part (6 values: 0.26,
12 values: 0.07 per tree), stand in one stretch of the order or both agree with
the region's first node; ``tests/llm`` measures the recall for pairs whose
every region is dense.

Defined results: null and empty texts have no shingles and link with nothing;
a text with fewer words than a shingle is one shingle; rows of the same text
are in one component; rows without id take part but never name a component;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.components import components
from flowtide.llm.tokens import Words, mix, packed, pieces, rising, risen, runs, unpacked
from flowtide.llm.work import stored

SHINGLE = 2
NUMERATOR, DENOMINATOR = 4, 5  # links need |A and B| / |A or B| of at least this
DEPTH = 3
TREES = 24
ESTIMATE = 0.5
REGION = 512
PAGE = 2048
PAGE_SHINGLES = 1_000_000


def _shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle; a text shorter than one is one shingle."""
    place = np.flatnonzero(w.at + width <= w.count[w.doc])
    row, value = w.doc[place], w.grams(place, width)
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for n in np.unique(w.count[short]):
            at = w.count[short] == n
            whole[at] = mix(w.grams(w.first[short[at]], int(n)) + np.uint64(n))
        row, value = np.concatenate([row, short]), np.concatenate([value, whole])
    return row, value


def _sets(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by row: hashes sorted within the row, where each row begins, how many it has."""
    row, value = _shingles(w, width)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = runs(row, value)
    row, value = row[first], value[first]
    size = np.bincount(row, minlength=len(w.count))
    return value, np.cumsum(size) - size, size


def _signatures(value: np.ndarray, begin: np.ndarray, size: np.ndarray, many: int) -> np.ndarray:
    """Minima of ``many`` hashes per non-empty set, 32 bits each."""
    full = np.flatnonzero(size)
    out = np.zeros((len(size), many), np.uint32)
    if len(full):
        low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for k in range(many):
                a, b = (int(x) for x in mix(np.array([2 * k + 1, 2 * k + 2], np.uint64)))
                x = (low ^ np.uint32(b & 0xFFFFFFFF)) * np.uint32(a & 0xFFFFFFFF | 1)
                x ^= x >> np.uint32(15)
                x += high
                x *= np.uint32(a >> 32 | 1)
                x ^= x >> np.uint32(16)
                out[full, k] = np.minimum.reduceat(x, begin[full])
    return out


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, many: int = DEPTH * TREES) -> DataFrame:
    """One row per document: id, th (hash of the text), n, node (hash of the set, null if empty), sig."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(body).alias("th"), body.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                value, begin, size = _sets(Words(part["text"], lower=True), width)
                sig = _signatures(value, begin, size, many)
                full = np.flatnonzero(size)
                node = np.zeros(len(size), np.uint64)
                with np.errstate(over="ignore"):
                    if len(full):
                        node[full] = mix(np.add.reduceat(mix(value), begin[full]) ^ mix(size[full].astype(np.uint64)))
                empty = size == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"], part["th"], pa.array(size.astype(np.int64)), pa.array(node.view(np.int64), mask=empty),
                        pa.array([None if e else s.tobytes() for e, s in zip(empty, sig)], pa.binary()),
                    ],
                    names=["id", "th", "n", "node", "sig"],
                )

    return rows.mapInArrow(run, "id bigint, th bigint, n bigint, node bigint, sig binary")


def _close(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    return (a == b).sum(-1) >= least


def _forest(node: np.ndarray, sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links from the smallest node of each cluster of similar signatures to its other nodes, so that trees name the same links."""
    links = []
    loose = np.arange(len(node))
    while len(loose) > 1:
        # The row that agrees most with the commonest values takes in all that are similar to it, then these take in others.
        own = sig[loose]
        middle = np.sort(own, 0)[len(loose) // 2]
        near = _close(own, own[int((own == middle).sum(1).argmax())], least)
        near[int((own == middle).sum(1).argmax())] = True
        cluster, new, loose = [loose[near]], loose[near], loose[~near]
        while len(new) and len(loose):
            found = np.zeros(len(loose), bool)
            for lo in range(0, len(new), 64):
                rest = np.flatnonzero(~found)
                found[rest] = _close(sig[loose[rest]][:, None, :], sig[new[lo : lo + 64]][None, :, :], least).any(1)
            new, loose = loose[found], loose[~found]
            cluster.append(new)
        members = node[np.concatenate(cluster)]
        head = int(members.min())
        links += [(head, int(m)) for m in members if m != head]
    return links


def _regions(least: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Regions come sorted by tree, prefix and the rest of the signature; long ones are cut with an overlap."""
        key, nodes, sigs = None, [], []

        def out() -> Iterator[tuple[int, int]]:
            if len(nodes) > 1:
                yield from _forest(np.array(nodes, np.int64), np.array([np.frombuffer(s, np.uint8) for s in sigs]), least)

        for batch in batches:
            found = []
            for k, n, s in zip(batch["key"].to_pylist(), batch["node"].to_pylist(), batch["sig"].to_pylist()):
                if k != key or len(nodes) >= limit:
                    found += out()
                    carry = 0 if k != key else limit // 4
                    key, nodes, sigs = k, nodes[len(nodes) - carry :], sigs[len(sigs) - carry :]
                nodes.append(n), sigs.append(s)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        found = list(out())
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _tree_rows(trees: int, depth: int):
    """Per node and tree: the key of the region that shares the tree's first ``depth`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
            for t in range(trees):
                with np.errstate(over="ignore"):
                    key = np.full(len(sig), t + 1, np.uint64)
                    for k in range(t * depth, (t + 1) * depth):
                        key = mix(key * np.uint64(31) + sig[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array(key.view(np.int64)), batch["node"]], names=["tree", "key", "node"])

    return run


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures in 8 bits a value: enough to compare two of a region."""
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([s.tobytes() for s in sig], pa.binary())], names=["_node", "sig"])


def _held(least: int):
    """Links from the heads of regions to the members similar to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig", "head_sig"))
                near = pa.array(_close(a, b, least))
                yield pa.RecordBatch.from_arrays([batch["head"].filter(near), batch["node"].filter(near)], names=["a", "b"])

    return run


def _deepened(dense: DataFrame, least: int, width: int, depth: int, region: int) -> list[DataFrame]:
    """Links within regions of more than ``region`` nodes, each cut by longer prefixes until its parts are small.

    A part is cut again as often as it needs; parts that agree in all values
    are alike and hang on their head.
    """
    found = []
    while not dense.isEmpty():
        depth = min(2 * depth, width)
        cut = dense.select(F.xxhash64("key", F.substring("sig", 1, depth)).alias("key"), "node", "sig")
        count = cut.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "sig")).alias("head")).filter("n > 1")
        count = count.select(F.col("key").alias("_key"), "n", F.col("head.node").alias("head"), F.col("head.sig").alias("head_sig"))
        parts = stored(cut.join(count, F.col("key") == F.col("_key")).drop("_key"), f"forest-depth-{depth}")
        large = F.col("n") > region
        small = parts.filter(~large).select("key", "node", "sig").repartition("key").sortWithinPartitions("key", "sig")
        found.append(small.mapInArrow(_regions(least, region), "a bigint, b bigint"))
        found.append(parts.filter(large & (F.col("node") != F.col("head"))).select("node", "sig", "head", "head_sig").mapInArrow(_held(least), "a bigint, b bigint"))
        if depth == width:
            break
        dense = parts.filter(large).select("key", "node", "sig")
    return found


def candidates(nodes: DataFrame, trees: int = TREES, depth: int = DEPTH, estimate: float = ESTIMATE, region: int = REGION) -> DataFrame:
    """Candidate links (a, b) that connect all nodes found similar in some tree."""
    least, width = int(estimate * trees * depth), trees * depth
    rows = stored(nodes.mapInArrow(_tree_rows(trees, depth), "tree int, key bigint, node bigint"), "forest")
    count = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).filter("n > 1")
    # Regions of one node have no links. Signatures travel with the others only.
    count = count.select(F.col("key").alias("_key"), "n", "head")
    shared = rows.join(count, F.col("key") == F.col("_key")).drop("_key")
    short = stored(nodes.mapInArrow(_short, "_node bigint, sig binary"), "forest-signatures")
    # The tree's order goes on behind its prefix.
    behind = (F.col("tree") + 1) * depth
    order = F.concat(F.substring("sig", behind + 1, F.lit(width)), F.substring("sig", F.lit(1), behind)).alias("sig")
    shared = stored(shared.join(short, F.col("node") == F.col("_node")).select("key", "n", "head", "node", order), "forest-regions")
    # Longest-common-prefix neighbours: the order of all trees, dealt out by range, so that no region has to fit one task.
    regions = shared.select("key", "node", "sig").repartitionByRange("key", "sig").sortWithinPartitions("key", "sig")
    links = [regions.mapInArrow(_regions(least, region), "a bigint, b bigint")]
    dense = shared.filter(F.col("n") > region)
    heads = dense.filter(F.col("node") == F.col("head")).select(F.col("key").alias("_key"), F.col("sig").alias("head_sig"))
    to_head = dense.filter(F.col("node") != F.col("head")).join(heads, F.col("key") == F.col("_key"))
    links.append(to_head.select("node", "sig", "head", "head_sig").mapInArrow(_held(least), "a bigint, b bigint"))
    links += _deepened(dense.select("key", "node", "sig"), least, width, depth, region)
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _confirm(sets: list[np.ndarray], split: int) -> Iterator[tuple[int, int]]:
    """Confirmed links between any two sets (rows from ``split`` on, if set, against rows before), as a spanning forest."""
    size = np.array([len(s) for s in sets], np.int64)
    value = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    begins = runs(value)
    many = np.diff(np.append(begins, len(value)))
    column = np.repeat(np.arange(len(begins)), many)
    take = np.repeat(many > 1, many)
    row, column = row[take], column[take]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    root = np.arange(len(sets))
    width = int(column.max()) + 1 if len(column) else 0
    for lo in range(0, split or len(sets), 256):
        hi = min(lo + 256, len(sets))
        inter = np.zeros((hi - lo, len(sets)), np.float32)
        for c in range(0, width, 4096):
            inside = (column >= c) & (column < c + 4096)
            x = np.zeros((len(sets), min(4096, width - c)), np.float32)
            x[row[inside], column[inside] - c] = 1
            inter += x[lo:hi] @ x.T
        union = size[lo:hi, None] + size[None, :] - inter
        linked = DENOMINATOR * inter >= NUMERATOR * union
        for i in range(lo, hi):
            to = np.flatnonzero(linked[i - lo])
            to = to[root[to] != root[i]]
            if len(to):
                classes, first = np.unique(root[to], return_index=True)
                yield from ((i, int(j)) for j in to[first])
                joined = np.append(classes, root[i])
                root[np.isin(root, joined)] = joined.min()


def links(docs: DataFrame, sigs: DataFrame, families: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """Confirmed links (a, b) between nodes; families (node, root)."""
    chosen = sigs.filter(F.col("node").isNotNull()).join(families, sigs.node == families.node).groupBy(sigs.node).agg(
        F.min(F.struct(F.col("th"))).alias("m"), F.min("root").alias("root"), F.max("n").alias("n")
    )
    # A page holds so many sets, and of long sets fewer, that any two pages fit one task.
    many = F.greatest(F.ceil(F.count("*") / PAGE), F.ceil(F.sum("n") / PAGE_SHINGLES)).cast("bigint").alias("many")
    pages = F.pmod(F.xxhash64("node"), F.col("many"))
    many = chosen.groupBy("root").agg(F.count("*").alias("sets"), many).filter("sets > 1").drop("sets").withColumnRenamed("root", "_root")
    chosen = chosen.join(many, F.col("root") == F.col("_root")).select("node", F.col("m.th").alias("_th"), "root", "many", pages.cast("int").alias("page"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(body).alias("th"), body.alias("text")).join(chosen, F.col("th") == F.col("_th"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                value, begin, size = _sets(Words(part["text"], lower=True), width)
                cells = [packed(rising(value[b : b + n])) for b, n in zip(begin, size)]
                yield pa.RecordBatch.from_arrays([part["node"], part["root"], part["many"], part["page"], pa.array(cells, pa.binary())], names=["node", "root", "many", "page", "cell"])

    cells = rows.select("text", "node", "root", "many", "page").mapInArrow(cut, "node bigint, root bigint, many bigint, page int, cell binary")
    cells = stored(cells.dropDuplicates(["node"]), "family-sets")
    last = F.col("many").cast("int") - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda p: F.struct(F.least(p, F.col("page")).alias("p"), F.greatest(p, F.col("page")).alias("q")))
    dealt = cells.withColumn("pq", F.explode(pairs)).select("root", "pq.p", "pq.q", "page", "node", "cell")

    def run(key, table):  # untyped: hints as text are not understood here
        node = np.asarray(table["node"])
        page = np.asarray(table["page"])
        order = np.argsort(page, kind="stable")
        sets = [risen(unpacked(table["cell"][int(i)].as_py())[0]) for i in order]
        split = int((page == page.min()).sum()) if page.min() != page.max() else 0
        got = list(_confirm(sets, split))
        node = node[order]
        return pa.table([pa.array([int(node[i]) for i, _ in got], pa.int64()), pa.array([int(node[j]) for _, j in got], pa.int64())], names=["a", "b"])

    return dealt.groupBy("root", "p", "q").applyInArrow(run, "a bigint, b bigint")


def _rooted(docs: DataFrame, text: str, doc_id: str, width: int, trees: int, depth: int) -> DataFrame:
    """(id, th, n, root) per row of ``docs``; root: the node that names the class, null for empty texts."""
    sigs = stored(signatures(docs, text, doc_id, width, trees * depth), "signatures")
    nodes = sigs.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("sig").alias("sig"))
    families = components(candidates(nodes, trees, depth))
    confirmed = components(links(docs, sigs, families, text, doc_id, width))
    up = confirmed.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return sigs.drop("sig").join(up, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "node"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(id, th, n_shingles, component) per row of ``docs``; component: the smallest id reachable."""
    joined = _rooted(docs, text, doc_id, width, trees, depth)
    least = joined.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least")).withColumnRenamed("root", "_r")
    out = joined.join(least, F.col("root") == F.col("_r"), "left")
    return out.select("id", "th", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """One document of each class: the row with the smallest (id, hash of the text), null ids last, columns unchanged.

    An empty text is a class of its own; rows equal in id and text stay once.
    """
    rooted = _rooted(docs, text, doc_id, width, TREES, DEPTH)
    alone = F.col("root").isNull()
    own = [F.when(alone, F.col(c)).alias(f"_{c}") for c in ("id", "th")]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("m")
    keep = rooted.groupBy("root", *own).agg(first).select(F.col("m.id").alias("_id"), F.col("m.th").alias("_th"))
    cells = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*cells).alias("_row"), F.col(doc_id).cast("bigint").alias("_i"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    kept = rows.join(keep, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th"))).select("_row", "_i", "_t")
    return kept.dropDuplicates(["_i", "_t"]).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
