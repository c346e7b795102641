"""Text analytics over whole documents and conversations."""

from pyspark.sql import functions as F

from tabloom.functions import patterns as P
from tabloom.operators import text as T
from workload.feature_queries import STRIPPED
from workload.registry import query, union_all


def hits(words, col="text"):
    return "(" + " + ".join(f"CAST(contains(lower({col}), '{w}') AS INTEGER)" for w in words) + ")"


def docs(t):
    return t.documents.select("doc_id", "text")


def without_text(df):
    return df.drop("text")


_SENT = (
    f"SELECT doc_id, text, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN p = n THEN 0.5::DOUBLE ELSE least(0.9, 0.6 + abs(p - n) * 0.1::DOUBLE) END AS confidence "
    f"FROM (SELECT doc_id, text, {hits(P.POSITIVE_WORDS)} AS p, {hits(P.NEGATIVE_WORDS)} AS n FROM documents)"
)


@query("sentiment", f"SELECT doc_id, sentiment, confidence FROM ({_SENT})", rnd={6: "confidence"})
def _(t):
    return without_text(T.sentiment(docs(t), "text"))


@query(
    "text_enrichment",
    "SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS text_text_length, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS text_word_count, "
    f"CASE WHEN {hits(P.POSITIVE_WORDS_WIDE)} > {hits(P.NEGATIVE_WORDS_WIDE)} THEN 'positive' WHEN {hits(P.NEGATIVE_WORDS_WIDE)} > {hits(P.POSITIVE_WORDS_WIDE)} THEN 'negative' ELSE 'neutral' END AS text_sentiment, "
    "regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}') AS text_contains_email, regexp_matches(text, '(^|[^\\p{L}\\p{N}_])\\d{3}[-.]?\\d{3}[-.]?\\d{4}([^\\p{L}\\p{N}_]|$)') AS text_contains_phone FROM conversations",
)
def _(t):
    return without_text(T.text_enrichment(t.conversations.select("conv_id", "turn", "text"), ["text"]))


def best_sql(table, key, names, none, scores, col="category"):
    s = ", ".join(f"{sc} AS s{i}" for i, sc in enumerate(scores))
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(names))) + ")" if len(names) > 1 else "s0"
    when = " ".join(f"WHEN s{i} = top THEN '{n}'" for i, n in enumerate(names))
    return (
        f"SELECT {key}, CASE WHEN top = 0 THEN '{none}' {when} END AS {col}, CASE WHEN top = 0 THEN 0.5::DOUBLE ELSE least(0.9, 0.5 + top * 0.1::DOUBLE) END AS confidence "
        f"FROM (SELECT *, {top} AS top FROM (SELECT {key}, {s} FROM {table}))"
    )


_TOPICS = best_sql("documents", "doc_id", list(P.TOPIC_KEYWORDS), "other", [hits(w) for w in P.TOPIC_KEYWORDS.values()])


@query("classify_topics", _TOPICS, rnd={6: "confidence"})
def _(t):
    return without_text(T.classify_topics(docs(t), "text"))


_CATS = ["technology", "business", "travel"]
_CUSTOM = best_sql("documents", "doc_id", _CATS, "technology", [hits(P.CUSTOM_KEYWORDS.get(c, [c])) for c in _CATS])


@query("classify_custom", _CUSTOM, rnd={6: "confidence"})
def _(t):
    return without_text(T.classify_custom(docs(t), "text", "technology, business, travel"))


# letters outside ASCII become '_', one for one, so that RE2's ASCII word edge sees them as word characters
MASK = "regexp_replace(text, '[^\\x00-\\x7F\\P{L}]', '_', 'g')"
_ENT = union_all(
    f"SELECT doc_id, text, {o} AS kind_no, '{k}' AS type, unnest(regexp_extract_all({MASK}, '{p}')) AS entity, unnest(range(len(regexp_extract_all({MASK}, '{p}')))) AS i FROM documents"
    for o, k, p in (
        (1, "PERSON", "\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b"),
        (2, "DATE", "\\b\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}\\b|\\b\\d{4}[/-]\\d{1,2}[/-]\\d{1,2}\\b"),
        (3, "MONEY", "\\$\\d+(?:,\\d{3})*(?:\\.\\d{2})?"),
    )
)
_ENT5 = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind_no, i) AS r FROM ({_ENT})) WHERE r <= 5"


@query(
    "extract_entities",
    f"SELECT doc_id, CAST(r - 1 AS INTEGER) AS pos, entity, type, CAST(instr(text, entity) - 1 AS INTEGER) AS \"start\", CAST(instr(text, entity) - 1 + length(entity) AS INTEGER) AS \"end\" FROM ({_ENT5})",
)
def _(t):
    return T.extract_entities(docs(t), "text").select("doc_id", F.posexplode("entities").alias("pos", "e")).select("doc_id", "pos", "e.*")


def strip(x):
    return STRIPPED.replace("text", x)


_SUM = (
    f"SELECT doc_id, {strip('raw')} AS summary, length(raw) / length(text) AS compression_ratio FROM (SELECT doc_id, text, CASE WHEN len(p) <= 2 THEN text ELSE p[1] || '. ' || p[-1] END AS raw "
    "FROM (SELECT doc_id, text, string_split(text, '.') AS p FROM documents))"
)


@query("summarize", _SUM, rnd={6: "compression_ratio"})
def _(t):
    return without_text(T.summarize(docs(t), "text"))


_EXT = (
    "SELECT doc_id, summary, length(summary) / length(text) AS compression_ratio FROM (SELECT doc_id, text, CASE WHEN suffix(c, '.') THEN c ELSE c || '.' END AS summary FROM "
    f"(SELECT doc_id, text, {strip('raw')} AS c FROM (SELECT doc_id, text, CASE WHEN len(s) <= 2 THEN text WHEN len(s) <= 5 THEN s[1] || '. ' || s[-1] ELSE s[1] || '. ' || s[len(s) // 2 + 1] || '. ' || s[-1] END AS raw "
    f"FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, '.'), lambda x: {strip('x')}), lambda x: length(x) > 10) AS s FROM documents))))"
)


@query("summarize_extractive", _EXT, rnd={6: "compression_ratio"})
def _(t):
    return without_text(T.summarize_extractive(docs(t), "text"))


W3 = f"regexp_extract_all(lower({MASK}), '\\b[a-z]{{3,}}\\b')"
_TOPW = f"(SELECT word, count(*) AS word_count FROM (SELECT unnest({W3}) AS word FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"


@query("topic_words", f"SELECT * FROM {_TOPW} w")
def _(t):
    return T.topic_words(docs(t), "text", 5)


_TOPIC = (
    f"WITH w AS (SELECT word, row_number() OVER (ORDER BY word_count DESC, word) AS o FROM {_TOPW} x), s AS (SELECT doc_id, word, o, CAST((length(lower(text)) - length(replace(lower(text), word, ''))) / length(word) AS INTEGER) AS n FROM documents, w), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS r FROM s) SELECT doc_id, word AS topic, least(0.9, 0.5 + n * 0.1::DOUBLE) AS confidence FROM b WHERE r = 1"
)


@query("topic_model", _TOPIC, rnd={6: "confidence"})
def _(t):
    return without_text(T.topic_model(docs(t), "text", 5))


_STOP = "(" + ", ".join(f"'{w}'" for w in P.KEYWORD_STOP_WORDS) + ")"


def top_terms_sql(kind, arr, cond, k):
    return (
        f"SELECT doc_id, term, count(*) AS term_count, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS INTEGER) AS rank, '{kind}' AS kind FROM (SELECT doc_id, unnest({arr}) AS term, unnest(range(len({arr}))) AS i FROM (SELECT doc_id, {W3} AS w FROM documents)) WHERE {cond} GROUP BY doc_id, term QUALIFY rank <= {k}"
    )


_KEY = union_all(
    [
        top_terms_sql("keyword", "w", f"term NOT IN {_STOP}", 5),
        top_terms_sql("phrase", "list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])", f"split_part(term, ' ', 1) NOT IN {_STOP} AND split_part(term, ' ', 2) NOT IN {_STOP}", 3),
    ]
)


@query("keywords", _KEY)
def _(t):
    return T.keywords(docs(t), "doc_id", "text", 5, 3)


def votes(code):
    words = ", ".join(f"'{w}'" for w in P.LANGUAGE_WORDS[code])
    return f"len(list_filter(w, lambda x: x IN ({words})))"


_LANG = (
    "SELECT doc_id, CASE code WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Spanish' END AS language, code AS language_code, confidence FROM ("
    "SELECT doc_id, CASE WHEN top = 0 THEN 'en' WHEN en = top THEN 'en' WHEN de = top THEN 'de' WHEN fr = top THEN 'fr' ELSE 'es' END AS code, CASE WHEN top = 0 THEN 0.8::DOUBLE ELSE top / (en + de + fr + es) END AS confidence FROM "
    "(SELECT *, greatest(en, de, fr, es) AS top FROM (SELECT doc_id, " + ", ".join(f"{votes(c)} AS {c}" for c in P.LANGUAGE_WORDS)
    + " FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}]+') AS w FROM documents))))"
)


@query("detect_language", _LANG, rnd={6: "confidence"})
def _(t):
    return without_text(T.detect_language(docs(t), "text"))


@query("text_vectors")
def _(t):
    return without_text(T.text_vectors(docs(t), "text", 384))


def metrics_sql(items):
    return union_all(f"SELECT '{m}' AS metric, CAST({n} AS DOUBLE) AS number, CAST({lab} AS VARCHAR) AS label FROM {src}" for m, n, lab, src in items)


_MR = {6: "number"}


def _common(sql, col):
    return f"(SELECT {col} FROM ({sql}) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "nlp_metrics_sentiment",
    metrics_sql(
        [("total_texts", "count(*)", "NULL", f"({_SENT})")]
        + [(f"{s}_count", f"count(*) FILTER (sentiment = '{s}')", "NULL", f"({_SENT})") for s in ("positive", "negative", "neutral")]
        + [("avg_confidence", "avg(confidence)", "NULL", f"({_SENT})")]
    ),
    rnd=_MR,
)
def _(t):
    return T.nlp_metrics(T.sentiment(docs(t), "text"), "sentiment")


def _class_metrics(sql, col, plural):
    return metrics_sql(
        [
            ("total_texts", "count(*)", "NULL", f"({sql})"), (f"unique_{plural}", f"count(DISTINCT {col})", "NULL", f"({sql})"),
            (f"most_common_{col}", "NULL", _common(sql, col), "(SELECT 1)"), ("avg_confidence", "avg(confidence)", "NULL", f"({sql})"),
        ]
    )


@query("nlp_metrics_classification", _class_metrics(_TOPICS, "category", "categories"), rnd=_MR)
def _(t):
    return T.nlp_metrics(T.classify_topics(docs(t), "text"), "classification")


@query("nlp_metrics_topics", _class_metrics(_TOPIC, "topic", "topics"), rnd=_MR)
def _(t):
    return T.nlp_metrics(T.topic_model(docs(t), "text"), "topic_modeling")


@query("nlp_metrics_language", _class_metrics(_LANG, "language", "languages"), rnd=_MR)
def _(t):
    return T.nlp_metrics(T.detect_language(docs(t), "text"), "language_detection")


@query(
    "nlp_metrics_entities",
    metrics_sql(
        [
            ("total_texts", "count(*)", "NULL", "documents"), ("total_entities", "count(*)", "NULL", f"({_ENT5})"),
            ("avg_entities_per_text", f"(SELECT count(*) FROM ({_ENT5})) / (SELECT count(*) FROM documents)", "NULL", "(SELECT 1)"),
            ("most_common_entity_type", "NULL", _common(_ENT5, "type"), "(SELECT 1)"),
        ]
    ),
    rnd=_MR,
)
def _(t):
    return T.nlp_metrics(T.extract_entities(docs(t), "text"), "entity_extraction")


@query(
    "nlp_metrics_summaries",
    metrics_sql([("total_texts", "count(*)", "NULL", f"({_SUM})")] + [(f"{f}_compression_ratio", f"{f}(compression_ratio)", "NULL", f"({_SUM})") for f in ("avg", "min", "max")]),
    rnd=_MR,
)
def _(t):
    return T.nlp_metrics(T.summarize(docs(t), "text"), "summarization")


@query(
    "nlp_metrics_embeddings",
    metrics_sql([("total_texts", "count(*)", "NULL", "documents"), ("embedding_dimension", "384", "NULL", "(SELECT 1)"), ("avg_text_length", "avg(length(text))", "NULL", "documents")]),
    rnd=_MR,
)
def _(t):
    return T.nlp_metrics(T.text_vectors(docs(t), "text", 384), "embedding")


_KW = f"(SELECT * FROM ({_KEY}) WHERE kind = 'keyword')"


@query(
    "nlp_metrics_keywords",
    metrics_sql(
        [
            ("total_texts", "count(*)", "NULL", "documents"), ("total_keywords", "count(*)", "NULL", _KW), ("unique_keywords", "count(DISTINCT term)", "NULL", _KW),
            ("avg_keywords_per_text", f"(SELECT count(*) FROM {_KW}) / (SELECT count(*) FROM documents)", "NULL", "(SELECT 1)"),
        ]
    ),
    rnd=_MR,
)
def _(t):
    return T.nlp_metrics(T.keyword_arrays(docs(t), "doc_id", "text"), "keyword_extraction")


@query(
    "batch_annotate",
    "SELECT conv_id, turn, CASE WHEN contains(text, '?') THEN 'question' ELSE 'statement' END AS kind, CAST(length(text) AS INTEGER) AS size FROM conversations",
)
def _(t):
    def stub(texts):
        import json

        return json.dumps([{"kind": "question" if "?" in x else "statement", "size": len(x)} for x in texts])

    return T.batch_annotate(t.conversations.select("conv_id", "turn", "text"), "text", stub, "kind string, size int", 10).drop("text")


@query(
    "batch_annotate_fallback",
    f"SELECT doc_id, sentiment, confidence FROM ({_SENT})",
    rnd={6: "confidence"},
)
def _(t):
    def broken(texts):
        raise RuntimeError("service not reachable")

    return T.batch_annotate(docs(t), "text", broken, "sentiment string, confidence double", 10, T.sentiment_columns("text")).drop("text")


@query(
    "text_suitability",
    "WITH h AS (SELECT * FROM documents ORDER BY doc_id LIMIT 5) " + union_all(f"SELECT '{c}' AS column_name, avg(length({c})) AS avg_length, avg(length({c})) > 10 AS is_text FROM h" for c in ("text", "lang", "source")),
    rnd={6: "avg_length"},
)
def _(t):
    return T.text_suitability(t.documents, "doc_id")


@query(
    "annotate_texts",
    f"SELECT d.doc_id, c.category AS text_category, c.confidence AS classification_confidence, e.summary AS text_summary, CAST(length(e.summary) AS INTEGER) AS summary_length FROM documents d JOIN ({_CUSTOM}) c USING (doc_id) JOIN ({_EXT}) e USING (doc_id)",
    rnd={6: "classification_confidence"},
)
def _(t):
    return without_text(T.annotate_texts(docs(t), "text", "both", "technology, business, travel"))
