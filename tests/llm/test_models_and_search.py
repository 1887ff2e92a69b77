import math
import random
from collections import Counter

import numpy as np
import pytest
from cases import frame
from pyspark.sql import functions as F

from flowtide.llm import exact_topk, lm_scoring, quality_classifier


def test_top_k_equals_all_scores(spark):
    r = np.random.default_rng(3)
    vectors = [(n, [float(np.float32(x)) for x in v]) for n, v in enumerate(r.normal(size=(300, 16)))]
    vectors += [(n, vectors[7][1]) for n in range(300, 330)]  # ties
    bad = [(400, None), (450, [1.0, None] * 8), (500, [float("nan")] * 16), (550, [float("inf")] * 16), (None, [1.0] * 16), (600, [])]
    given = spark.createDataFrame([*vectors, *bad, vectors[0]], "vec_id long, embedding array<float>").withColumn("rank", F.lit("kept"))
    got = exact_topk.top_k(given.repartition(5), F.col("vec_id") % 50 == 0).collect()
    whole = {n: np.floor(256 * np.array(v)).astype(np.int64) for n, v in vectors} | {600: np.zeros(16, np.int64)}
    expected = []
    for q in (n for n in whole if n % 50 == 0):
        scored = sorted((-int(whole[q] @ v), n) for n, v in whole.items() if n != q)[:5]
        expected += [(q, k + 1, n, -s) for k, (s, n) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_top_k_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_topk.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 131072)]
    assert exact_topk.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0


def corpus(spark, seed=0):
    r = random.Random(seed)
    good = [f"w{i}" for i in range(30)]
    rows, labels = [], []
    for n in range(120):
        if n % 3 == 2:
            text = " ".join(f"z{r.randrange(400)}" for _ in range(60))
        else:
            at, text = 0, []
            for _ in range(60):
                at = (at + r.choice((1, 2, 3))) % 30
                text.append(good[at])
            text = " ".join(text)
            if n % 2:
                labels.append((n, 1, 0))
        rows.append((n, text, "en" if n % 5 else None, "s", 1, *["kept"] * 10))
    rows += [(500, None, "en", None, None, *["kept"] * 10), (501, "", "xx", None, None, *["kept"] * 10), rows[0]]
    return frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), labels[0]], "doc_id long, quality int, toxic int"), {n for n, *_ in labels}


def test_scores_by_hand(spark):
    docs, labels, good = corpus(spark)
    rows = lm_scoring.score(docs, labels, F.col("quality") == 1, size=64).collect()
    assert len(rows) == docs.count()
    texts = [(r.doc_id, (r.text or "").split()) for r in docs.collect()]
    many = Counter(w for _, t in texts for w in t)
    from flowtide.llm import ngrams
    from flowtide.llm.tokens import Words
    import pyarrow as pa

    hashed = {w: int(h) for w, h in zip(many, Words(pa.array(list(many))).hash)}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    top = sorted(many, key=lambda w: (-many[w], signed(hashed[w])))[: 64 - ngrams.FIRST]
    ids = {w: n for n, w in enumerate(sorted(top, key=lambda w: hashed[w]), ngrams.FIRST)}
    pairs = lambda t: list(zip([ngrams.BEGIN] + [ids.get(w, 0) for w in t], [ids.get(w, 0) for w in t]))
    both = []
    for chosen in (lambda d: d in good, lambda d: True):
        both.append(Counter(p for d, t in texts if chosen(d) for p in pairs(t)))
    for r in rows:
        text = next(t for d, t in texts if d == r.doc_id)
        for m, (model, mean) in enumerate(zip(both, (r.loss_target, r.loss_background))):
            own = Counter(pairs(text)) if (m or r.doc_id in good) else Counter()
            total, kinds, word = Counter(), Counter(), Counter()
            for (h, w), c in model.items():
                total[h] += c
                kinds[h] += 1
                word[w] += c
            sum_ = 0.0
            for h, w in pairs(text):
                mine, c = own[(h, w)], model[(h, w)]
                unigram = (max(word[w] - mine, 0) + 1) / (sum(word.values()) + 64)
                weight = max(total[h] - mine, 0) + max(kinds[h] - (c > 0 and c == mine), 0)
                p = (max(c - mine, 0) + max(kinds[h] - (c > 0 and c == mine), 0) * unigram) / weight if weight else unigram
                sum_ -= math.log(max(p, unigram * 1e-6))
            assert mean == pytest.approx(sum_ / len(text) if text else 0.0)
        assert r.score == pytest.approx(r.loss_target - r.loss_background)


def test_perplexity_tells_held_out_text_apart(spark):
    docs, labels, good = corpus(spark, 1)
    rows = quality_classifier.classify(docs, labels, F.col("quality") == 1, size=1000).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.doc_id not in good and r.tokens]
    assert all(r.kept == (r.doc_id % 3 != 2) for r in held)
    assert all(r.kept for r in rows if r.doc_id in good)
    assert {(r.perplexity, r.kept) for r in rows if not r.tokens} == {(None, False)}


def plain_kneser_ney(texts, good):
    """Perplexities by the formulas of interpolated modified Kneser-Ney, all counts in dictionaries."""
    pairs = lambda t: list(zip(["<s>", *t], t))
    model = Counter(p for d, t in texts if d in good for p in pairs(t))
    types = len({w for _, t in texts for w in t})
    contexts = Counter(w for _, w in model)

    def discounts(counts):
        n = [max(1.0, sum(1 for c in counts if c == k)) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]

    d, low = discounts(model.values()), discounts(contexts.values())
    cut = lambda by, c: by[min(c, 3)]
    kinds = len(model)
    spare = sum(cut(low, c) for c in contexts.values()) / kinds if kinds else 1.0
    out = []
    for doc, text in texts:
        own = Counter(pairs(text)) if doc in good else Counter()
        total = 0.0
        for h, w in pairs(text):
            c = model[h, w] - own[h, w]
            into = contexts[w] - sum(1 for (g, v), n in own.items() if v == w and n == model[g, v])
            unigram = max(into - cut(low, into), 0) / max(kinds, 1) + spare / (types + 1)
            left = {v: n - own[g, v] for (g, v), n in model.items() if g == h}
            n = sum(left.values())
            freed = sum(cut(d, k) for k in left.values())
            p = (max(c - cut(d, c), 0) + max(freed, 0.05) * unigram) / n if n else unigram
            total -= math.log(p)
        out.append((doc, len(text), math.exp(total / len(text)) if text else None))
    return out


@pytest.mark.parametrize("seed", [1, 4])
def test_perplexities_equal_the_formulas(spark, seed):
    r = random.Random(seed)
    rows = [(n, " ".join(f"w{int(r.expovariate(0.3))}" for _ in range(r.randrange(0, 40))), "en", "s", 1, *["kept"] * 10) for n in range(40)]
    good = {n for n in range(40) if n % 3}
    labels = spark.createDataFrame([(n, 1) for n in good], "doc_id long, quality int")
    got = quality_classifier.perplexity(frame(spark, rows), labels, F.col("quality") == 1).collect()
    want = {d: (n, p) for d, n, p in plain_kneser_ney([(row[0], row[1].split()) for row in rows], good)}
    assert len(got) == len(rows)
    for row in got:
        n, p = want[row.doc_id]
        assert row.tokens == n and (row.perplexity is None if p is None else row.perplexity == pytest.approx(p, rel=1e-9))


@pytest.mark.parametrize("few", [1, 2, 5])
def test_few_trusted_documents_of_a_language_set_no_limits(spark, few):
    r = random.Random(few)
    rows = []
    for n in range(200):
        lang, stem = ("de", "d") if n < 60 else ("en", "e")
        rows.append((n, " ".join(f"{stem}{int(r.expovariate(0.2))}" for _ in range(60)), lang, "s", 1, *["kept"] * 10))
    labels = spark.createDataFrame([(n, 1) for n in [*range(few), *range(60, 120)]], "doc_id long, quality int")
    kept = {x.doc_id for x in quality_classifier.classify(frame(spark, rows), labels, F.col("quality") == 1).collect() if x.kept}
    assert len([n for n in range(60, 200) if n in kept]) >= 130
    alone = quality_classifier.classify(frame(spark, rows[:60]), labels, F.col("quality") == 1).collect()
    assert all(x.kept for x in alone)


def test_models_of_nothing(spark):
    docs, labels, _ = corpus(spark)
    assert lm_scoring.score(docs.limit(0), labels, F.col("quality") == 1).count() == 0
    assert all(r.kept == bool(r.tokens) for r in quality_classifier.classify(docs, labels.limit(0), F.col("quality") == 1).collect())


def test_classify_no_documents(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_classifier.classify(frame(spark, []), labels, F.col("quality") == 1).count() == 0


def test_planted_low_quality_is_rejected(spark, tmp_path):
    from flowtide.llm.queries import QUERIES

    r = random.Random(5)
    clean = lambda: " ".join(f"w{(7 * k + r.choice((1, 2, 3))) % 50}" for k in range(r.randrange(60, 120)))
    noise = lambda: " ".join(f"z{r.randrange(10**6)}" for _ in range(80))
    foul = lambda: " ".join(f"t{r.randrange(20)}" for _ in range(80))
    kinds = [("trusted", clean, 300), ("odd", noise, 3), ("toxic", foul, 60), ("planted", noise, 40), ("clean", clean, 100)]
    kind = [k for k, _, many in kinds for _ in range(many)]
    makers = {k: m for k, m, _ in kinds}
    given = {"trusted": (1, 0), "odd": (1, 0), "toxic": (1, 1)}
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(n, makers[k](), "en") for n, k in enumerate(kind)], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    labels = [(n, *given[k]) for n, k in enumerate(kind) if k in given]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op6_quality_classifier"](spark, folder).collect()
    kept = Counter(kind[x.doc_id] for x in rows if x.kept)
    assert {kind[x.doc_id] for x in rows if x.trusted} == {"trusted", "odd"}
    assert not kept["planted"] and not kept["toxic"] and not kept["odd"]
    assert kept["clean"] >= 93 and kept["trusted"] >= 285


def test_words_of_any_number_are_told_apart(spark):
    """70,000 words: a pair that follows twice is known by its words, and unseen words do not count as one common word."""
    words = [f"v{n}" for n in range(70_000)]
    rows = [(n, " ".join(words[n * 1000 : (n + 1) * 1000])) for n in range(70)] * 2
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    rows += [(900, " ".join(words[69_000:69_500])), (901, " ".join(reversed(words[69_000:69_500]))), (902, " ".join(f"u{n}" for n in range(500)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(n, 1) for n in range(140)], "doc_id long, quality int")
    scored = {r.doc_id: r for r in lm_scoring.score(docs, labels, F.col("quality") == 1).collect()}
    total, types = 140_000, 70_500
    unseen = -math.log(1 / (total + types + 1))
    assert scored[902].loss_target == pytest.approx(unseen, rel=1e-3)
    first = (2 + 1) / (total + types + 1)
    known = -math.log((2 + 1 * first) / 3)
    assert scored[900].loss_target == pytest.approx((499 * known - math.log((2 + 70 * first) / 210)) / 500, rel=1e-3)
    assert scored[900].loss_target < 1 < scored[901].loss_target < scored[902].loss_target
    judged = docs.withColumn("lang", F.lit("en"))
    seen = {r.doc_id: r.perplexity for r in quality_classifier.perplexity(judged, labels, F.col("quality") == 1).collect()}
    assert seen[900] < seen[901] < seen[902] and seen[902] > types / 2


def test_answers_in_the_blocks_order_for_any_split(spark, monkeypatch):
    """Many shards, small blocks and few entries at once change no score; stored answers name no word or bigram."""
    from flowtide.llm import ngrams

    docs, labels, _ = corpus(spark, 2)
    rows = lambda: [
        sorted(
            ((r.doc_id is None, r.doc_id, r.tokens, *(x if x is None else round(x, 9) for x in values(r))) for r in run(docs, labels, F.col("quality") == 1).collect()), key=repr
        )
        for run, values in (
            (lm_scoring.score, lambda r: (r.loss_target, r.loss_background)),
            (quality_classifier.classify, lambda r: (r.perplexity,)),
            (lambda *a: lm_scoring.score(*a, size=40), lambda r: (r.loss_target, r.loss_background)),
            (lambda *a: quality_classifier.classify(*a, size=40), lambda r: (r.perplexity,)),
        )
    ]
    want = rows()
    for name, value in (("SHARD_BYTES", 3000), ("BLOCK", 500), ("ENTRIES", 90)):
        monkeypatch.setattr(ngrams, name, value)
    sizes, stored = Counter(), ngrams.stored

    def kept(table, name):
        out = stored(table, name)
        if "blob" in out.columns:
            blobs = out.filter("kind = 0") if "kind" in out.columns else out
            sizes[name] += blobs.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
        return out

    assert rows() == want
    monkeypatch.undo()
    monkeypatch.setattr(ngrams, "stored", kept)
    r = random.Random(4)
    many = [(n, " ".join(f"v{int(r.paretovariate(0.4)) % 50021}" for _ in range(400)), "en", "s", 1, *["kept"] * 10) for n in range(200)]
    assert lm_scoring.score(frame(spark, many), labels, F.col("quality") == 1).count() == 200
    pairs = len({p for _, t, *_ in many for p in zip(["", *t.split()], t.split())})
    assert sizes["ngram-counts"] < 3 * pairs


def test_no_turn_holds_all_that_travels(spark, monkeypatch):
    """Bigrams, words and blocks travel in turns, and what a turn shuffled is gone before the next one ends."""
    import glob
    import os
    import time

    from flowtide.llm import ngrams

    docs, labels, _ = corpus(spark, 2)
    folder = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", "/tmp")
    files = lambda: set(glob.glob(f"{folder}/blockmgr-*/*/shuffle_*"))
    before = files()
    assert spark.range(100).repartition(3).groupBy("id").count().count() == 100
    own = {os.path.dirname(os.path.dirname(f)) for f in files() - before}
    files = lambda: {f for d in own for f in glob.glob(f"{d}/*/shuffle_*")}
    assert files()
    for name, value in (("SHARD_BYTES", 3000), ("BLOCK", 500)):
        monkeypatch.setattr(ngrams, name, value)
    old, names, stored = files(), Counter(), ngrams.stored

    def kept(table, name):
        out = stored(table, name)
        names[name] += out.count() > 0
        if name in ("ngram-labels", "ngram-blocks"):
            old.update(files())
        end = time.time() + 20
        while files() - old and time.time() < end:
            time.sleep(0.1)
        assert not files() - old, name
        return out

    monkeypatch.setattr(ngrams, "stored", kept)
    assert quality_classifier.perplexity(docs, labels, F.col("quality") == 1).count() == docs.count()
    assert all(names[n] > 2 for n in ("ngram-counts", "ngram-words", "ngram-sums")), names
