import hashlib
import sys
from collections import Counter

import pytest
from cases import documents, frame, lower, words

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline  # noqa: E402
from test_duplicates import plain_components  # noqa: E402
from test_rules_and_licenses import plain_measures  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_by_hand(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows = [r for r in dict.fromkeys(documents(9, copies=30)) if r[0] is not None]
    folder = f"file://{tmp_path}"
    frame(spark, rows).select(*COLUMNS).write.parquet(f"{folder}/documents.parquet")
    docs, outputs = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}.parquet"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        outputs.append(docs.collect())
    rules, near, passages, mixed, packed = outputs
    assert all(list(out[0].asDict()) == COLUMNS for out in outputs[:4])

    def good(m):
        return m["n_words"] >= 50 and 2 * m["n_repeat_words"] <= m["n_words"] and 10 * m["n_symbols"] <= m["n_words"] and (
            2 * m["n_dup_lines"] <= m["n_lines"]) and 100 * m["n_upper"] <= 40 * m["word_chars"] and m["word_chars"] <= 20 * m["n_words"]

    assert {r.doc_id for r in rules} == {r[0] for r in rows if good(plain_measures(r[1]))}
    classes = plain_components([(r.doc_id, r.text) for r in rules], 5)
    assert {r.doc_id for r in near} == {d for d, _, c in classes if d == c}
    seen = {}
    for r in sorted(near, key=lambda r: r.doc_id):
        w = words(r.text)
        lost = {i + k for i in range(len(w) - 12) if seen.setdefault(tuple(w[i : i + 13]), r.doc_id) < r.doc_id for k in range(13)}
        after = next(p for p in passages if p.doc_id == r.doc_id)
        assert words(after.text) == [x for i, x in enumerate(w) if i not in lost] and after.n_chars == len(after.text)
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in passages} and max(copies.values()) <= 2
    assert sum(copies[r.doc_id] * len(words(r.text)) for r in passages) <= 1.5 * sum(len(words(r.text)) for r in passages)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    assert max(Counter({s: sum(r.length for r in packed if r.sequence_id == s) for s in {r.sequence_id for r in packed}}).values()) <= 1024


def test_documents_without_id_pass_the_near_duplicate_stage(spark):
    word = lambda k: " ".join(f"{k}{n}" for n in range(60))
    near = word("c").replace("c30", "other")
    texts = [(None, word("a")), (None, word("b")), (None, word("b")), (None, word("c")), (None, near), (None, word("d")), (7, word("d")), (3, word("e")), (4, word("e")), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    empty = [k for k in kept if not k[1]]
    one = [k for k in kept if k[1] in (word("c"), near)]
    assert len(empty) == 1 and len(one) == 1 and one[0][0] is None and set(kept.values()) == {1}
    assert set(kept) - {*empty, *one} == {(None, word("a")), (None, word("b")), (7, word("d")), (3, word("e"))}
