import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from cases import documents, frame, words

from flowtide.llm import mixing, packing


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_mix_meets_targets_and_repeats(spark):
    docs = frame(spark, documents(copies=40))
    out = mixing.mix(docs)
    rows = out.collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs).collect()))
    assert set(out.columns) == set(docs.columns) and len(rows) == docs.count() and rows[0]["key"] == "kept"
    size, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert r.mix.size == len(words(r.text)) and 0 <= r.mix.copies <= 2
        size[r.source] += r.mix.size
        taken[r.source] += r.mix.size * r.mix.copies
        largest[r.source] = max(largest[r.source], r.mix.size)
        target[r.source] = r.mix.target
    for r in rows:
        assert r.mix.source_size == size[r.source]
    # Water filling by hand: reshare the excess until no source is above twice its size.
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and level * weight[s] > 2 * size[s]}
        if not more:
            break
        capped |= more
    for s in names:
        assert target[s] == pytest.approx(2 * size[s] if s in capped else level * weight[s])
        assert abs(taken[s] - target[s]) <= 2 * max(largest.values())
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    assert mixing.taken(out).count() == sum(r.mix.copies for r in rows)


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    blank = [(n, None, None, "a", 0, *["kept"] * 10) for n in range(3)]
    assert {r.mix.target for r in mixing.mix(frame(spark, blank)).collect()} == {0.0}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = packing.pack(frame(spark, documents()), tokenizer(), size=128, ids=True).collect()
    model = Tokenizer.from_file(tokenizer())
    expected = Counter((d[0], np.array([*model.encode(d[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d in documents())
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 512
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, text in expected:
        copies = sum(n for (i, _), n in expected.items() if i == d)
        own = sorted(by_doc[d], key=lambda r: (r.start, r.piece))[::copies]
        assert b"".join(r.ids for r in own) == text and all(r.length == 128 for r in own[1:])
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert packing.pack(frame(spark, []), tokenizer()).count() == 0


def best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


def fewest(lengths, size):
    """Exact, by trying all fillings around the largest piece."""
    if not lengths:
        return 0
    top, rest = lengths[0], lengths[1:]
    best = 1 + fewest(rest, size)
    for k in range(1, len(rest) + 1):
        for chosen in combinations(range(len(rest)), k):
            if top + sum(rest[i] for i in chosen) <= size:
                best = min(best, 1 + fewest(tuple(x for i, x in enumerate(rest) if i not in chosen), size))
    return best


def test_bin_completion_is_sound_and_near_best():
    for seed in range(30):
        r = random.Random(seed)
        lengths = sorted((r.randrange(1, 21) for _ in range(7)), reverse=True)
        plan = packing.complete(dict(Counter(lengths)), 20)
        got = Counter()
        for filling, times in plan:
            assert sum(filling) <= 20
            got.update({s: filling.count(s) * times for s in set(filling)})
        assert got == Counter(lengths)
        bins = sum(t for _, t in plan)
        assert packing.lower_bound(dict(Counter(lengths)), 20) <= fewest(tuple(lengths), 20) <= bins <= best_fit(lengths, 20)
        assert bins <= fewest(tuple(lengths), 20)
    assert packing.complete({}, 20) == []


def test_short_pieces_are_kept_for_each_other():
    r = random.Random(5)
    for n, most in ((5000, 2014), (300, 121)):
        counts = dict(Counter(r.randrange(260, 521) for _ in range(n)))
        plan, above = packing.planned(counts)
        got = Counter()
        for filling, times in plan:
            assert sum(filling) <= 1024
            got.update({s: filling.count(s) * times for s in set(filling)})
        assert got == Counter(counts)
        assert packing.sequences(plan) <= most and above == packing.sequences(plan) - packing.lower_bound(counts, 1024)


def test_a_full_cache_changes_no_ids(monkeypatch):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    encoder, model = packing._Encoder(open(tokenizer(), encoding="utf-8").read()), Tokenizer.from_file(tokenizer())
    for d in documents(3):
        text = d[1] or ""
        want = np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert list(encoder.batch([text])) == [want]


def test_an_encoder_is_kept_per_model():
    pytest.importorskip("public_tokenizers")
    model = open(tokenizer(), encoding="utf-8").read()
    one = packing._encoder(model)
    other = packing._encoder(model.replace('"unk_token":', '"unk_token" :'))
    assert packing._encoder(model) is one and (other is one) == ('"unk_token":' not in model)


def test_new_parts_are_encoded_as_one_string(monkeypatch):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    encoder, model = packing._Encoder(open(tokenizer(), encoding="utf-8").read()), Tokenizer.from_file(tokenizer())
    sent, encode = [], encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda texts: sent.extend(texts) or encode(texts))
    r = random.Random(8)
    parts = ["".join(r.choice("aeiouklmnsé中9'.,-\nĠ") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    texts = ["go " + " ".join(r.choice(parts) for _ in range(60)) for _ in range(40)] + ["", "go  twice ", None]
    want = lambda t: np.array(model.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    odd = [t for t in texts if any(not p or p != p.strip() for p in (t or "").split(" "))]
    for _ in range(2):
        assert list(encoder.batch(texts)) == [want(t) for t in texts]
        # The first part, the others as one, and texts with odd spaces as a whole.
        assert len(sent) <= 2 + len(odd)
        sent.clear()
    monkeypatch.setattr(encoder, "leads", np.zeros_like(encoder.leads))  # no token begins with a space: one by one
    assert list(encoder.batch(["go new words", "go on"])) == [want("go new words"), want("go on")]


MEMORY = """
import random, re, sys
from flowtide.llm import packing

def used():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

r = random.Random(5)
encoder = packing._encoder(open(sys.argv[1], encoding="utf-8").read())
before = used()
for _ in range(4):
    text = ["go " + " ".join("".join(r.choices("aeiouklmns", k=8)) for _ in range(100)) for _ in range(1000)]
    assert sum(1 for _ in encoder.batch(text)) == 1000
    del text
print(used() - before)
"""


def test_an_idle_encoder_holds_little_memory():
    path, root = tokenizer(), Path(__file__).parents[2]
    pytest.importorskip("tokenizers")
    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("memory can't be read here")
    got = subprocess.run([sys.executable, "-c", MEMORY, path], cwd=root, capture_output=True, text=True, check=True)
    # A worker keeps this through later stages: some 100 bytes for each of 400,000 parts, and little of the work.
    assert float(got.stdout) < 130


def test_long_parts_do_not_fill_the_cache(monkeypatch):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    encoder, model = packing._Encoder(open(tokenizer(), encoding="utf-8").read()), Tokenizer.from_file(tokenizer())
    for k in range(12):
        text = "go " + " ".join(f"{k}{n}" + "ab" * 300 for n in range(8)) + " on, and on."
        want = np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert list(encoder.batch([text])) == [want]
        assert encoder.later.parts.nbytes < 20_000 + 2 * len(text)
