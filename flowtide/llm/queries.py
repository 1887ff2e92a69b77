"""The operators' registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm import (
    collocations,
    divergence_audit,
    exact_topk,
    license_scan,
    lm_scoring,
    minhash_dedup,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    warc,
)
from flowtide.llm.work import read, words
from flowtide.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, twin: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(prepare(spark), sf_dir)

        QUERIES[name] = prepared
        if twin:
            TWINS[name] = twin.strip()
        return run

    return add


OP5_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, range(0, 3) AS g(k) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(text, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper
      FROM w LEFT JOIN cover USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
        + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN 100 * n_upper > 40 * word_chars THEN 16 ELSE 0 END
        + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_upper, fail_bits FROM b
"""


@query("op5_quality_rules", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_rules.ledger(docs)
    at = lambda name: F.col(f"{quality_rules.LEDGER}.{name}")
    return rows.select(
        "doc_id",
        *(at(n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        quality_rules.failed(1).alias("base_failed"),
        (~quality_rules.failed(quality_rules.PRODUCTION)).alias("kept"),
        *(at(n).alias(n) for n in ("n_lines", "n_upper", "fail_bits")),
    )


def _sql_templates() -> str:
    rows = []
    for number, t in enumerate(license_scan.TEMPLATES):
        listed = ", ".join(f"'{w}'" for w in t.words)
        rows.append(f"({number}, '{t.label}', {str(t.phrase).lower()}, [{listed}], {[i + 1 for i in t.needed]})")
    return ", ".join(rows)


OP1_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tpl(tid, label, phrase, words, needed) AS (VALUES {_sql_templates()}),
p AS (SELECT r, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
c AS (SELECT r, w, tid, label, phrase, words, needed, i - needed[1] + 1 AS s FROM p JOIN tpl ON word = words[needed[1]]),
m AS (SELECT r, label, phrase, s, len(list_filter(range(1, len(words) + 1), lambda j: s + j > 1 AND w[s + j - 1] = words[j])) / len(words) AS share
      FROM c WHERE len(list_filter(needed, lambda j: s + j > 1 AND w[s + j - 1] = words[j])) = len(needed)),
g AS (SELECT r, count(*) FILTER (phrase) AS n_base, min(s) FILTER (phrase) - 1 AS first_word, max(s) FILTER (phrase) - 1 AS last_word,
        coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
        coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, max(share) AS score
      FROM m WHERE share >= {license_scan.MIN_SHARE} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM t LEFT JOIN g USING (r)
"""


@query("op1_license_scan", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = license_scan.scan(docs).select("doc_id", f"{license_scan.SCAN}.*")
    phrases = [n for n, t in enumerate(license_scan.TEMPLATES) if t.phrase]
    rows = rows.withColumn("base", F.filter("matches", lambda m: m["template"].isin(phrases)))
    place = F.transform("base", lambda m: m["start"])
    return rows.select(
        "doc_id", "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(place).cast("bigint").alias("first_word"),
        F.array_max(place).cast("bigint").alias("last_word"),
        license_scan.labels(F.col("base")).alias("base_labels"),
        license_scan.labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5(coalesce(doc_id::VARCHAR, '') || chr(1) || coalesce(text, '')) AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM src),
lv AS (SELECT *, (budget - coalesce(sum(2 * source_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lam
       FROM w WINDOW o AS (ORDER BY 2 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(lam, (2 * source_size / weight, place)) AS level FROM lv WHERE lam * weight <= 2 * source_size),
s AS (SELECT w.*, CASE WHEN level * weight > 2 * source_size THEN (2 * source_size)::DOUBLE ELSE level * weight END AS target FROM w, level),
k AS (SELECT source, key, sum(size)::BIGINT AS size FROM d GROUP BY ALL),
cum AS (SELECT k.*, s.place, s.source_size, s.target, s.budget, sum(k.size) OVER (PARTITION BY s.place ORDER BY key) AS cum
        FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source),
line AS (SELECT *, CASE WHEN target > 0 THEN (cum + round * source_size)::DOUBLE / target ELSE 0 END AS finish FROM cum, range(0, 2) AS g(round)),
cut AS (SELECT *, sum(size) OVER (ORDER BY finish, place, round, key ROWS UNBOUNDED PRECEDING) AS upto FROM line),
n AS (SELECT place, key, count(*) FILTER (upto <= budget) AS copies FROM cut GROUP BY ALL)
SELECT doc_id, d.size, s.source_size, s.target, (d.size * copies)::BIGINT AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN n ON n.place = s.place AND n.key = d.key
"""


@query("op2_mixing", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mixing.mix(docs)
    return rows.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target",
        (F.col("mix.size") * F.col("mix.copies")).cast("bigint").alias("taken"),
    )


def tokenizer_path() -> str:
    """The vocabulary that the packing query uses; packing itself takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path())


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op10_exact_topk", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk.top_k(rows, F.col("vec_id") % 50 == 0)


OP9_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
        FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, i + k AS i FROM win JOIN low USING (h), range(0, 13) AS g(k) WHERE low < doc_id),
per AS (SELECT r, list(i) AS gone FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '') END) AS kept_sha256
FROM t LEFT JOIN per USING (r)
"""


@query("op9_substring_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lossy = substring_dedup.repeated(docs)
    lost = substring_dedup.digests(lossy).dropDuplicates(["id", "th"]).alias("lost")
    own = words(F.col("text"))
    rows = substring_dedup.keyed(docs).select(
        "id", "th", F.size(own).cast("bigint").alias("n_words"), F.sha2(F.array_join(own, " ").cast("binary"), 256).alias("sha")
    ).alias("own")
    both = rows.join(lost, (F.col("own.id") == F.col("lost.id")) & (F.col("own.th") == F.col("lost.th")), "left")
    return both.select(
        F.when(F.col("own.id") != int(substring_dedup.LAST), F.col("own.id")).alias("doc_id"), "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_sort(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM t),
nodes AS (SELECT s, min(doc_id) AS least FROM s WHERE len(s) > 0 GROUP BY s),
post AS (SELECT least, len(s) AS n, unnest(s) AS x FROM nodes),
df AS (SELECT x, count(*) AS df FROM post GROUP BY x HAVING count(*) > 1),
ranked AS (SELECT least, n, x, row_number() OVER (PARTITION BY least ORDER BY coalesce(df, 1), x) AS k, df FROM post LEFT JOIN df USING (x)),
pre AS (SELECT least, n, x FROM ranked WHERE df > 1 AND k <= n - (4 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT a.least AS a, b.least AS b FROM pre a JOIN pre b ON a.x = b.x AND a.least < b.least AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
link AS (SELECT a, b FROM cand JOIN nodes p ON p.least = a JOIN nodes q ON q.least = b
         WHERE 100 * len(list_intersect(p.s, q.s)) >= 80 * (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(root, least, doc_id) AS component_id, doc_id = coalesce(root, least, doc_id) AS kept
FROM s LEFT JOIN nodes ON nodes.s = s.s LEFT JOIN comp ON comp.a = nodes.least
"""


@query("op7_minhash_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = minhash_dedup.classes(docs)
    return rows.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lossy = suffix_dedup.repeated(docs, keep_first=False)
    lost = suffix_dedup.cleaned(lossy).dropDuplicates(["id", "th"]).select(
        "id", "th", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    ).alias("lost")
    rows = substring_dedup.keyed(docs, "text", "doc_id", "doc_id").select(
        "doc_id", "id", "th", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")
    ).alias("own")
    both = rows.join(lost, (F.col("own.id") == F.col("lost.id")) & (F.col("own.th") == F.col("lost.th")), "left")
    return both.select(
        "doc_id", "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


@query("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return lm_scoring.score(docs, labels, (F.col("quality") == 1) & (F.col("toxic") == 0))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return quality_classifier.classify(docs, labels, (F.col("quality") == 1) & (F.col("toxic") == 0))


OP11_SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT r, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS h FROM p),
k AS (SELECT r, list_transform(range(0, 4), lambda i: ('0x' || substr(h, 10 * i + 1, 10))::BIGINT) AS k FROM d),
b AS (SELECT r, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((k[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31)::INTEGER + 1, 1)), '') AS payload_digest FROM k),
t AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN top END AS refers_to
FROM t JOIN d USING (r) JOIN b USING (r)
"""


@query("op11_warc", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    records = warc.read_records(index, folder, payload=False)
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "intact").filter(
        F.when(F.col("intact"), F.lit(True)).otherwise(F.raise_error(F.lit("a record does not match its index")).cast("boolean"))
    ).drop("intact")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w[i:i + k - 1] AS p FROM w, range(1, 6) AS a(k), range(1, 1 + len(w) - k + 1) AS b(i)),
f AS (SELECT lang, k, p, count(*)::BIGINT AS f FROM g GROUP BY ALL),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 100),
x AS (SELECT a.lang, a.p FROM c a JOIN c b ON a.lang = b.lang AND b.k = a.k + 1 AND (b.p[1:a.k] = a.p OR b.p[2:] = a.p) WHERE 100 * b.f >= 100 * a.f),
cut AS (SELECT c.lang, c.p, c.f, n.n, t.j, l.f AS l, r.f AS r, ((1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM c JOIN n ON n.lang = c.lang, range(1, 5) AS t(j), f l, f r
        WHERE t.j < c.k AND l.lang = c.lang AND l.p = c.p[1:t.j] AND r.lang = c.lang AND r.p = c.p[t.j + 1:]),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS place FROM cut),
kept AS (SELECT low.* FROM low ANTI JOIN x ON low.lang = x.lang AND low.p = x.p WHERE place = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, array_to_string(p, ' ')) AS rank,
             array_to_string(p, ' ') AS phrase, f AS a, l, r, n, score FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"))
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


OP13_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
k AS (SELECT lang, term, count(*)::BIGINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM t),
c AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::BIGINT AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v))::BIGINT AS p,
        (1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v))::BIGINT AS q
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
two AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
one AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pair UNION ALL FROM one))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op13_divergence_audit", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(read(spark, sf_dir, "documents").select("lang", "source", "text"))
