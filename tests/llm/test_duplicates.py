import hashlib
import random
from collections import Counter, defaultdict

from cases import documents, frame, lower, words

from flowtide.llm import components, minhash_dedup, substring_dedup, suffix_dedup


def shingles(text, width):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def plain_components(rows, width):
    sets = [shingles(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, r in enumerate(rows))


def test_near_duplicates_equal_all_pairs(spark):
    for seed, width in ((1, 2), (2, 2), (3, 5)):
        rows = documents(seed, copies=25)
        got = minhash_dedup.classes(frame(spark, rows), width=width).collect()
        assert Counter((r.id, r.n_shingles, r.component) for r in got) == plain_components(rows, width)
    docs = frame(spark, rows)
    kept = minhash_dedup.dedup(docs, width=5)
    assert kept.columns == docs.columns and {r["id"] for r in kept.collect()} == {"kept"}
    assert minhash_dedup.classes(frame(spark, [])).count() == 0


def test_large_family_page_by_page(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "PAGE", 4)
    monkeypatch.setattr(minhash_dedup.candidates, "__defaults__", (24, 3, 0.5, 5))
    rows = documents(4, copies=25)
    got = minhash_dedup.classes(frame(spark, rows)).collect()
    assert Counter((r.id, r.n_shingles, r.component) for r in got) == plain_components(rows, 2)


def test_recall_where_every_region_is_dense(spark, monkeypatch):
    """Pairs at 0.8 among documents that share more than half of their text; regions of more than eight nodes are cut."""
    import random

    monkeypatch.setattr(minhash_dedup.candidates, "__defaults__", (24, 3, 0.5, 8))
    r = random.Random(9)
    common = [f"c{n}" for n in range(70)]
    rows, pairs = [], []
    for n in range(0, 600, 2):
        text = common + [f"o{n}x{k}" for k in range(50)]
        other = list(text)
        while True:  # edits as far as the similarity stays at 0.8
            tried = list(other)
            tried[r.randrange(len(tried))] = f"e{r.randrange(10**9)}"
            a, b = shingles(" ".join(text), 2), shingles(" ".join(tried), 2)
            if 5 * len(a & b) < 4 * len(a | b):
                break
            other = tried
        rows += [(n, " ".join(text)), (n + 1, " ".join(other))]
        pairs.append((n, n + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sigs = minhash_dedup.signatures(docs).filter("node IS NOT NULL").select("node", "sig")
    rows_of = minhash_dedup._tree_rows(24, 3)
    sizes = sigs.mapInArrow(rows_of, "tree int, key bigint, node bigint").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert sizes > 8
    found = {x.id: x.component for x in minhash_dedup.classes(docs).collect()}
    recall = sum(found[a] == found[b] for a, b in pairs) / len(pairs)
    print("recall", recall)
    assert recall >= 0.9
    for a, b in ((found[0], found[2]), (found[10], found[400])):
        assert a != b  # unlike documents of the region stay apart


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_substrings_equal_all_windows(spark):
    rows = documents(5)
    low = {}
    for d, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            low[key] = min(low.get(key, 1 << 62), 1 << 62 if d is None else d)
    expected = {}
    for d, text, *_ in rows:
        w = words(text)
        lost = {i + k for i in range(len(w) - 12) if low[tuple(w[i : i + 13])] < (1 << 62 if d is None else d) for k in range(13)}
        if lost:
            kept = " ".join(x for i, x in enumerate(w) if i not in lost)
            expected[d] = (len(lost), hashlib.sha256(kept.encode()).hexdigest())
    docs = frame(spark, rows)
    lossy = substring_dedup.repeated(docs)
    assert {r.id: (r.n_removed, r.kept_sha256) for r in substring_dedup.digests(lossy).collect()} == expected and expected
    out = substring_dedup.dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert all(hashlib.sha256(" ".join(words(texts[d])).encode()).hexdigest() == sha for d, (_, sha) in expected.items())
    assert all(texts[d] == t for d, t, *_ in rows if d not in expected)
    assert substring_dedup.dedup(frame(spark, [])).count() == 0


def test_anchor_cover_has_every_difference():
    pairs = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert pairs == set(range(substring_dedup.PERIOD))


def plain_bytes(rows, length, keep_first):
    seen = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for n in order:
        t = (rows[n][1] or "").encode()
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].append((n, i))
    out = []
    for n, r in enumerate(rows):
        t = (r[1] or "").encode()
        lost = set()
        for i in range(len(t) - length + 1):
            at = seen[t[i : i + length]]
            if len(at) > 1 and not (keep_first and at[0] == (n, i)):
                lost.update(range(i, i + length))
        kept = bytes(b for i, b in enumerate(t) if i not in lost)
        out.append((r[0], len(lost), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_bytes_equal_all_windows(spark):
    rows = documents(6)
    unique = list({(r[0], r[1]): r for r in rows}.values())
    for given, keep_first in ((rows, False), (unique, True)):
        lossy = suffix_dedup.repeated(frame(spark, given), length=120, keep_first=keep_first)
        got = {r.id: (r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.cleaned(lossy, 120).collect()}
        expected = {d: (n, sha) for d, n, sha in plain_bytes(given, 120, keep_first) if n}
        assert got == expected and expected
    assert suffix_dedup.repeated(frame(spark, [])).count() == 0


def test_zones_do_not_depend_on_neighbours():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(8)
    text = lambda n: r.integers(97, 123, n, np.uint8).tobytes().decode()
    passage = text(5000)
    texts = [text(1_500_000), *(text(90_000) + passage for _ in range(8)), text(5_000_000)]

    def zones(order):
        z = suffix_dedup.Zones(pa.array([texts[i] for i in order]), suffix_dedup.LENGTH)
        return {i: [x[z.doc == n].tolist() for x in (z.lo, z.windows, z.anchor)] for n, i in enumerate(order)}

    alone = {i: zones([i])[i] for i in range(len(texts))}
    whole = list(range(len(texts)))
    assert zones(whole) == alone and zones(whole[::-1]) == alone
    assert all(sum(alone[i][1]) == len(t) - suffix_dedup.LENGTH + 1 for i, t in enumerate(texts))


def test_repeated_bytes_by_id(spark, tmp_path):
    from flowtide.llm.queries import QUERIES

    r = random.Random(8)
    some = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    long, short = some(70), " ".join(f"{n:03}" for n in range(60))  # 60 words in 239 bytes stay, though they repeat
    rows = [(n, f"{some(20)} {p} {some(20)}") for n, p in enumerate([long, short, long, short])]
    rows += [(n, t) for n in (None, 2**63 - 1) for t in (long, "a" * 400 + "é", short)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op8_suffix_dedup"](spark, folder).select("doc_id", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(plain_bytes(rows, 400, False))
    assert len(long) >= 400 and {x.doc_id: x.n_removed > 0 for x in got if x.doc_id in range(4)} == {0: True, 1: False, 2: True, 3: False}
