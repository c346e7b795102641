"""The registered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import read, shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


def _of_kind(kind: int):
    return lambda span: span["kind"] == kind


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.token_files import read_digests, write_tokens

    folder = shared_folder(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, folder)


@_query
def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.byte_bpe import round_trip_digests

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.simhash import components

    found = components(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), keep="largest")


ORACLES["op9_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) d
WINDOW g AS (PARTITION BY t)
"""


@_query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.secret_scan import BASE_RULES, scan_secrets, spans_text

    found = scan_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_RULES))
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.line_dedup import drop_repeated_lines

    out = drop_repeated_lines(read(spark, sf_dir, "documents", "doc_id", "text"), removed="removed", n_lines="n_lines")
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "text")


# the shortest runs that reach 10 words ahead of and up to each line, compared as strings
ORACLES["op10_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d),
w AS (SELECT doc_id, ls, i, greatest(1, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+'))) AS w FROM l),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(w) OVER (PARTITION BY doc_id) AS total FROM w),
m AS (SELECT *, count(*) OVER (PARTITION BY doc_id ORDER BY upto - w RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead,
             count(*) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS back FROM c),
r AS (SELECT doc_id, ls, i, ahead AS n FROM m WHERE total - upto + w >= 10
      UNION SELECT doc_id, ls, i - back + 1, back FROM m WHERE upto >= 10),
s AS (SELECT doc_id, i, n, min((doc_id, i)) OVER (PARTITION BY array_to_string(ls[i:i + n - 1], chr(10)), n) AS f FROM r),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM s WHERE (doc_id, i) <> f),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
             coalesce(string_agg(l.ls[l.i], chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, k.text AS text FROM documents LEFT JOIN k USING (doc_id)
"""


@_query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.embedding_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


@_query
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.lm_score import score_documents

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_documents(docs, held_out, public_tokenizers.path("byte_bpe_50k.json"), ids=50257, end_id=50256)


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.language_id import identify, train

    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return identify(docs, train(docs.where(~F.coalesce(held_out, F.lit(False)))), held_out)


@_query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.substring_dedup import remove_repeated

    return remove_repeated(read(spark, sf_dir, "documents", "doc_id", "text"))


ORACLES["op11_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' '))) AS t FROM d),
f AS (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY t) AS f FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE (doc_id, i) <> f),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS t FROM d),
k AS (SELECT w.doc_id, count(g.i) AS gone, string_agg(w.t, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS kept
      FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


@_query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.divergence import divergence

    return divergence(read(spark, sf_dir, "documents", "text", "lang", "source"))


ORACLES["op12_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS c FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
             1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p, 1 + (1000000000 * (k.c + 1)) // (l.n + l.v) AS q
      FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
      LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 200
"""


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.hard_negatives import mine

    rows = read(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, b.r AS o, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id, o) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.r, p.o ORDER BY s.score DESC, s.id, s.o) AS rank
      FROM p JOIN s ON p.r = s.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
