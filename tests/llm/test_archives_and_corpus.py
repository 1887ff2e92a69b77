import base64
import gzip
import hashlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import pyarrow as pa
import pytest
from cases import documents, frame, lower

from flowtide.llm import collocations, divergence_audit, vocabulary, warc

PAGES = "page_id long, url string, html string, digest string, row string, offset string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def pages(copies=40):
    rows = [(n, f"http://a.example/{n}", f"<p>page {n % 7}</p>" if n % 3 else None, "x", "y", "z") for n in range(copies)]
    rows += [(1000, None, "", "x", "y", "z"), (None, "http://b.example/ \r\nX: y", "ünïcode €", None, None, None), (None, "http://b.example/2", "ünïcode €", None, None, None)]
    rows += [rows[1], rows[1], (2000, "http://c.example/é", "long " * 200_000, "x", "y", "z"), (2001, "http://c.example/", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n", "x", "y", "z")]
    return rows


def plain_records(rows, least=0):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2] or ""].append(r[0])
    want = Counter()
    for body, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        small = len(body.encode()) < least
        for place, i in enumerate(order):
            first = place == 0 or small
            want[(i, len(body.encode()), sha(body), "response" if first else "revisit", None if first else order[0])] += 1
    return want


@pytest.mark.parametrize("least,hot,file_bytes", [(0, 1000, 10**9), (10, 5, 2_000), (0, 3, 1)])
def test_archives_round_trip(spark, tmp_path, monkeypatch, least, hot, file_bytes):
    monkeypatch.setattr(warc, "HOT", hot)  # with 3 and 5 the large groups are settled before the exchange
    rows, folder = pages(), f"file://{tmp_path}/archive"
    docs = spark.createDataFrame(rows, PAGES).repartition(3)
    index = warc.write(warc.planned(warc.payloads(docs), least), folder, file_bytes)
    got = warc.read_records(index, folder).collect()
    assert all(r.intact for r in got) and len({r.record_id for r in got}) == len(rows)
    assert Counter((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in got) == plain_records(rows, least)
    bodies = {sha(r[2]): (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == bodies[r.digest] if r.record_type == "response" else r.payload is None for r in got)
    ids = {r.record_id: r for r in got}
    assert all(ids[r.refers_to_id].record_type == "response" and ids[r.refers_to_id].digest == r.digest for r in got if r.refers_to_id)
    assert sorted((r.url or "") for r in got) == sorted((r[1] or "") for r in rows)
    # The files are ordinary archives: members one after the other, lengths as in the index.
    held = Counter(r.file for r in index.collect())
    for path in (tmp_path / "archive").glob("*.gz"):
        records = gzip.decompress(path.read_bytes()).split(b"WARC/1.1\r\nWARC-Type: ")
        assert not records[0] and records[1].startswith(b"warcinfo") and len(records) == held[path.name] + 2


def test_a_few_records_are_read_by_range(spark, tmp_path):
    rows, folder = pages(300), f"file://{tmp_path}/archive"
    index = warc.write(warc.planned(warc.payloads(spark.createDataFrame(rows, PAGES).repartition(2))), folder)
    some = index.filter("page_id % 10 = 0")
    for gap, span in ((65_536, 8_000_000), (0, 1), (10, 500)):
        got = warc.read_records(some, folder, gap, span).collect()
        assert all(r.intact for r in got) and sorted(r.page_id for r in got) == sorted(r[0] for r in rows if r[0] is not None and r[0] % 10 == 0)


def test_a_damaged_record_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/archive"
    index = warc.write(warc.planned(warc.payloads(spark.createDataFrame([(1, "u", "a" * 50, "", "", "")], PAGES))), folder)
    wrong = index.withColumn("record_id", index.record_id.substr(1, 20))
    assert [r.intact for r in warc.read_records(wrong, folder).collect()] == [False]


def test_no_pages(spark):
    index, folder = warc.archive(spark.createDataFrame([], PAGES))
    assert warc.read_records(index, folder).count() == 0


def plain_collocations(rows, least, top, share, longest=5):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        text = lower(r[1])
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[(lang, tuple(w[i : i + k]))] += 1
    out = defaultdict(list)
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    cand = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    for (lang, p), a in cand.items():
        if any(g == lang and len(q) > len(p) and 100 * v >= share * a and inside(p, q) for (g, q), v in cand.items()):
            continue
        cuts = [(floor(Fraction(1000 * a * n[lang], f[(lang, p[:k])] * f[(lang, p[k:])])), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[(lang, p[:k])], f[(lang, p[k:])]))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize("block,step,share", [(1_000_000, 4_000_000, 100), (50, 64, 60)])
def test_collocations_equal_all_phrases(spark, monkeypatch, block, step, share):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(vocabulary.slices, "__defaults__", (step,))
    rows = documents(6, copies=30)
    rows += [(None, "a a a a a a. a a a\tb\nA a", None, None, None, *["k"] * 10), (7, "New York City, new york city! new york " * 40, "und", None, None, *["k"] * 10)]
    rows += [(8, "\x00odd one  two " * 9, "xx", "s", 1, *["k"] * 10), (9, ".,;:!?\n", "de", "s", 1, *["k"] * 10)]
    got = {tuple(r) for r in collocations.collocations(frame(spark, rows), least=5, top=300, share=share).collect()}
    assert got == plain_collocations(rows, 5, 300, share) and len(got) > 300
    assert collocations.collocations(frame(spark, [])).count() == 0


def test_scores_pass_64_bits(spark):
    row = spark.range(1).select(*(collocations.F.lit(v).cast("bigint").alias(k) for k, v in (("f", 3 * 10**11), ("n", 10**13 + 7), ("x", 5 * 10**11), ("y", 4 * 10**11 + 1))))
    c = collocations.F
    got = row.select(collocations.score(c.col("f"), c.col("n"), c.array("x"), c.array("y")).alias("s")).first().s
    assert got.score == 1000 * 3 * 10**11 * (10**13 + 7) // (5 * 10**11 * (4 * 10**11 + 1))


def plain_audit(rows, least, top):
    import re

    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, held, out = defaultdict(Counter), Counter(), set()
    for r in rows:
        key = (r[2] or "", r[3] or "")
        w = term.findall(lower(r[1]))
        counts[key].update(w)
        held.update((key[0], t) for t in set(w))
    kept = defaultdict(list)
    for (lang, t), d in held.items():
        if d >= least:
            kept[lang].append(t)
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {k[0] for k in counts}:
        terms, groups = kept[lang], {s: c for (g, s), c in counts.items() if g == lang}
        v, whole = len(terms), sum((c for c in groups.values()), Counter())
        n = {s: sum(c[t] for t in terms) for s, c in groups.items()}
        every = sum(whole[t] for t in terms)
        for s, c in groups.items():
            pairs = sorted((-sum(f(share(c[t], n[s], v), share(d[t], n[o], v)) for t in terms), o.encode()) for o, d in groups.items() if o != s)
            out |= {(lang, s, "pair", o.decode(), -x, k) for k, (x, o) in enumerate(pairs, 1)}
            marks = [(share(c[t], n[s], v), share(whole[t], every, v), t) for t in terms if c[t]]
            best = sorted((-f(p, q), t.encode()) for p, q, t in marks if p > q)[:top]
            out |= {(lang, s, "term", t.decode(), -x, k) for k, (x, t) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("groups,terms,small,block", [(64, 4096, 100_000, 10**6), (1, 7, 0, 100)])
def test_divergences_equal_the_dense_form(spark, monkeypatch, groups, terms, small, block):
    monkeypatch.setattr(divergence_audit, "BLOCK", block)
    monkeypatch.setattr(vocabulary.slices, "__defaults__", (64 if block < 1000 else 4_000_000,))
    rows = documents(8, copies=20)
    rows += [(None, None, "xx", "only", None, *["k"] * 10), (1, "", "yy", None, None, *["k"] * 10), (2, "!!", "yy", "s", None, *["k"] * 10)]
    got = divergence_audit.audit(frame(spark, rows), least_docs=3, top=4, groups=groups, terms=terms, small_rows=small).collect()
    assert {tuple(r) for r in got} == plain_audit(rows, 3, 4) and len(got) == len(plain_audit(rows, 3, 4))
    assert divergence_audit.audit(frame(spark, [])).count() == 0


def test_long_division_is_exact():
    import numpy as np

    for count, total in ((0, 1), (10**12, 10**12 + 5), (123_456_789_012, 987_654_321_098_765), (7, 10**15)):
        assert divergence_audit._shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 2) // total


def test_slices_end_outside_words():
    texts = pa.array(["one two  three", "", "four", None, "five" * 30 + " six"])
    data, offsets = vocabulary.column(texts)
    inside = collocations.INSIDE
    for step in (1, 3, 7, 1000):
        words = []
        for lo, hi in vocabulary.slices(data, inside, step):
            part = vocabulary.Runs(data, offsets, lo, hi, inside)
            words += [(int(r), part.words[int(c)].as_py()) for r, c in zip(part.row, part.code)]
        assert words == [(0, "one"), (0, "two"), (0, "three"), (2, "four"), (4, "five" * 30), (4, "six")]
