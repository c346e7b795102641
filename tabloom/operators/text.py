"""Rule-based text analytics.  Row-wise results are column expressions; only corpus facts shuffle."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.columns import as_list, text_cols, total
from tabloom.functions import patterns as P
from tabloom.functions import scalars as X
from tabloom.session import saved

_EDGE_BEFORE, _EDGE_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# fixed values: words of at least three plain letters, names, dates and amounts of money
WORD3 = _EDGE_BEFORE + "[a-z]{3,}" + _EDGE_AFTER
PERSON = _EDGE_BEFORE + r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*" + _EDGE_AFTER
DATE = (
    _EDGE_BEFORE + r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}" + _EDGE_AFTER + "|"
    + _EDGE_BEFORE + r"[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}" + _EDGE_AFTER
)
MONEY = r"\$[0-9]+(?:,[0-9]{3})*(?:\.[0-9]{2})?"


def _hits(text: Column, words) -> Column:
    """How many of the words occur in the lower-cased text."""
    low = F.lower(text)
    return total([low.contains(w).cast("int") for w in words])


def sentiment_columns(text: str, wide: bool = False) -> dict[str, Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    pos = _hits(t, P.POSITIVE_WORDS_WIDE if wide else P.POSITIVE_WORDS)
    neg = _hits(t, P.NEGATIVE_WORDS_WIDE if wide else P.NEGATIVE_WORDS)
    label = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
    confidence = F.when(pos == neg, F.lit(0.5)).otherwise(F.least(F.lit(0.9), 0.6 + F.abs(pos - neg) * 0.1))
    return {"sentiment": label, "confidence": confidence}


def sentiment(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns(sentiment_columns(text))


def text_enrichment(df: DataFrame, cols=None) -> DataFrame:
    """Length, word count, sentiment and e-mail / phone marks of each text column."""
    made = {}
    for c in text_cols(df, cols):
        t = F.coalesce(F.col(c), F.lit(""))
        made[f"{c}_text_length"] = F.length(t)
        made[f"{c}_word_count"] = F.size(X.words(t))
        made[f"{c}_sentiment"] = sentiment_columns(c, wide=True)["sentiment"]
        made[f"{c}_contains_email"] = X.contains_email(t)
        made[f"{c}_contains_phone"] = X.contains_phone(t)
    return df.withColumns(made)


def _best(names: list[str], scores: list[Column], none: str, none_confidence: Column) -> dict[str, Column]:
    """First name with the highest score and its confidence."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    label = None
    for name, score in zip(names, scores):
        label = F.when(score == top, name) if label is None else label.when(score == top, name)
    hit = top > 0
    return {
        "category": F.when(hit, label).otherwise(none),
        "confidence": F.when(hit, F.least(F.lit(0.9), 0.5 + top * 0.1)).otherwise(none_confidence),
    }


def topic_columns(text: str) -> dict[str, Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    names = list(P.TOPIC_KEYWORDS)
    return _best(names, [_hits(t, P.TOPIC_KEYWORDS[n]) for n in names], "other", F.lit(0.5))


def classify_topics(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns(topic_columns(text))


def custom_columns(text: str, categories) -> dict[str, Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    names = [c.strip() for c in (categories.split(",") if isinstance(categories, str) else categories)]
    words = [P.CUSTOM_KEYWORDS.get(n.lower(), [n.lower()]) for n in names]
    return _best(names, [_hits(t, w) for w in words], names[0], F.lit(0.5))


def classify_custom(df: DataFrame, text: str, categories) -> DataFrame:
    """Caller's categories; a category without known keywords uses its own name."""
    return df.withColumns(custom_columns(text, categories))


def entities_column(text: str, limit: int = 5) -> Column:
    t = F.coalesce(F.col(text), F.lit(""))

    def found(pattern, kind):
        def one(e):
            start = F.locate(e, t) - 1 if isinstance(e, str) else F.instr(t, e) - 1
            return F.struct(e.alias("entity"), F.lit(kind).alias("type"), start.alias("start"), (start + F.length(e)).alias("end"))

        return F.transform(F.slice(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), 1, limit), one)

    return F.slice(F.concat(found(PERSON, "PERSON"), found(DATE, "DATE"), found(MONEY, "MONEY")), 1, limit)


def extract_entities(df: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """First entities of each text (persons, dates, money in that order) with the place of the first occurrence."""
    return df.withColumn("entities", entities_column(text, limit))


def summary_columns(text: str) -> dict[str, Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.split(t, r"\.")
    raw = F.when(F.size(parts) <= 2, t).otherwise(F.concat(F.element_at(parts, 1), F.lit(". "), F.element_at(parts, -1)))
    ratio = F.when(F.length(t) > 0, F.length(raw) / F.length(t)).otherwise(F.lit(1.0))
    return {"summary": X.strip(raw), "compression_ratio": ratio}


def summarize(df: DataFrame, text: str) -> DataFrame:
    """First and last sentence."""
    return df.withColumns(summary_columns(text))


def summarize_extractive(df: DataFrame, text: str) -> DataFrame:
    """First, middle and last of the sentences longer than 10 characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    n, dot = F.size("_s"), F.lit(". ")
    first, last = F.try_element_at("_s", F.lit(1)), F.try_element_at("_s", F.lit(-1))
    middle = F.try_element_at("_s", (F.floor(n / 2) + 1).cast("int"))
    raw = F.when(n <= 2, t).when(n <= 5, F.concat(first, dot, last)).otherwise(F.concat(first, dot, middle, dot, last))
    # each step is a column of its own, so that it is made once a row
    split = df.withColumn("_s", F.filter(F.transform(F.split(t, r"\."), X.strip), lambda x: F.length(x) > 10))
    clean = split.withColumn("_c", X.strip(raw))
    out = clean.withColumn("summary", F.when(F.col("_c").endswith("."), F.col("_c")).otherwise(F.concat("_c", F.lit("."))))
    ratio = F.when(F.length(t) > 0, F.length("summary") / F.length(t)).otherwise(F.lit(1.0))
    return out.withColumn("compression_ratio", ratio).drop("_s", "_c")


def plain_words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD3), F.lit(0))


def topic_words(df: DataFrame, text: str, k: int = 5) -> DataFrame:
    """The k most frequent words of the corpus, ties by word."""
    words = df.select(F.explode(plain_words(text)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("word_count")).orderBy(F.desc("word_count"), "word").limit(k)


def topic_model(df: DataFrame, text: str, k: int = 5) -> DataFrame:
    """Each text gets the corpus topic word it contains most often (k words reach the driver)."""
    topics = [r["word"] for r in topic_words(df, text, k).orderBy(F.desc("word_count"), "word").collect()]
    if not topics:
        return df.withColumns({"topic": F.lit("general"), "confidence": F.lit(0.5)})
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    scores = [((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int") for w in topics]
    best = _best(topics, scores, topics[0], F.lit(0.5))
    return df.withColumns({"topic": best["category"], "confidence": best["confidence"]})


def _runs(rows: DataFrame, spots: Column) -> DataFrame:
    """(all columns, _runs): the distinct terms of each row's array of (term, pos) with their number and first place."""
    at = rows.withColumn("_s", F.sort_array(spots))
    new = F.filter(F.transform("_s", lambda x, i: F.when((i == 0) | (x["term"] != F.get("_s", i - 1)["term"]), i)), lambda i: i.isNotNull())
    at = at.withColumn("_at", new)

    def run(i, k):
        return F.struct((i - F.coalesce(F.get("_at", k + 1), F.size("_s"))).cast("long").alias("less"), F.get("_s", i)["pos"].alias("first_pos"), F.get("_s", i)["term"].alias("term"))

    return at.withColumn("_runs", F.transform("_at", run)).select(*rows.columns, "_runs")


def _spots(terms: Column, keep) -> Column:
    return F.filter(F.transform(terms, lambda w, i: F.struct(w.alias("term"), i.alias("pos"))), lambda x: keep(x["term"]))


def _row_spots(stop) -> list[Column]:
    """The words in ``_w`` and their bigrams, without stop words, as (term, pos)."""
    stop_array = F.array(*[F.lit(w) for w in (stop or P.KEYWORD_STOP_WORDS)])

    def plain(w):
        return ~F.array_contains(stop_array, w)

    return [_spots(F.col("_w"), plain), _spots(X.ngrams(F.col("_w"), 2), lambda t: plain(F.split(t, " ")[0]) & plain(F.split(t, " ")[1]))]


def _first_runs(k: int) -> Column:
    """The k most frequent terms of a row, ties by first place."""
    return F.slice(F.sort_array("_runs"), 1, k)


def _top_terms(rows: DataFrame, key: str, k: int, single: bool) -> DataFrame:
    """The k most frequent terms per key, ties by first position; ``single``: each key has one row."""
    if single:
        found = rows.select(key, F.posexplode_outer(_first_runs(k)).alias("_i", "_r")).where(F.col("_r").isNotNull())
        return found.select(key, F.col("_r.term").alias("term"), (-F.col("_r.less")).alias("term_count"), (F.col("_i") + 1).alias("rank"))
    terms = rows.select(key, F.inline_outer("_runs")).where(F.col("term").isNotNull())
    counts = terms.groupBy(key, "term").agg((-F.sum("less")).alias("term_count"), F.min("first_pos").alias("first_pos"))
    order = Window.partitionBy(key).orderBy(F.desc("term_count"), "first_pos")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first_pos")


def _single_keys(df: DataFrame, key: str) -> bool:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").isEmpty()


def keywords(df: DataFrame, key: str, text: str, k: int = 5, p: int = 3, stop=None) -> DataFrame:
    """Top words and top bigrams of each text without stop words: (key, kind, rank, term, term_count).

    Terms are counted within their row, so no term is shuffled; only if a key repeats are its rows put together.
    """
    single = _single_keys(df, key)
    base = df.select(key, plain_words(text).alias("_w"))
    parts = zip(("keyword", "phrase"), (k, p), _row_spots(stop))
    words, pairs = (_top_terms(_runs(base, spots).select(key, "_runs"), key, n, single).withColumn("kind", F.lit(kind)) for kind, n, spots in parts)
    return words.unionByName(pairs)


def detect_language(df: DataFrame, text: str, default=("en", 0.8)) -> DataFrame:
    """Function words vote; the share of the winner is the confidence.  No vote gives ``default``."""
    codes = list(P.LANGUAGE_WORDS)
    # words and votes are columns of their own, so that each is made once
    split = df.withColumn("_w", F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"))

    def count_of(known):
        return F.size(F.filter("_w", lambda x: x.isin(known)))

    counted = split.withColumn("_v", F.array(*[count_of(P.LANGUAGE_WORDS[c]) for c in codes]))
    votes = [F.col("_v")[i] for i in range(len(codes))]
    names = F.create_map(*[F.lit(x) for kv in P.LANGUAGE_NAMES.items() for x in kv])
    best = counted.withColumn("_best", _best(codes, votes, default[0], F.lit(default[1]))["category"])
    top, cast = F.greatest(*votes), total(votes)
    made = {
        "language": names[F.col("_best")],
        "language_code": F.col("_best"),
        "confidence": F.when(cast > 0, F.try_divide(top.cast("double"), cast)).otherwise(F.lit(default[1])),
    }
    return best.withColumns(made).drop("_w", "_v", "_best")


def text_vectors(df: DataFrame, text: str, dim: int = 384, name: str = "embedding") -> DataFrame:
    """L2-normalised hashed term frequencies as an array of ``dim`` numbers."""
    filled = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    steps = [
        RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim),
        Normalizer(inputCol="_tf", outputCol="_v"),
    ]
    out = Pipeline(stages=steps).fit(filled).transform(filled)
    return out.withColumn(name, vector_to_array("_v", "float32")).drop("_t", "_w", "_tf", "_v")


def _most_common(counts: DataFrame, col: str) -> tuple:
    """Number of values, the most frequent one (ties to the smallest) and its count, from (col, c)."""
    row = counts.agg(F.count(F.lit(1)).alias("k"), F.max("c").alias("c")).first()
    best = counts.where(F.col("c") == row["c"]).agg(F.min(col)).first()[0] if row["k"] else "none"
    return row["k"], best, row["c"]


_METRIC_COLUMNS = {"classification": ("category", "categories"), "topic_modeling": ("topic", "topics"), "language_detection": ("language", "languages")}


def nlp_metrics(results: DataFrame, task: str) -> DataFrame:
    """(metric, number, label) rows describing the results of one text task."""
    if task in _METRIC_COLUMNS:
        # one pass over the results; what follows reads a row for each value
        col, plural = _METRIC_COLUMNS[task]
        counts = saved(results.groupBy(col).agg(F.count(F.lit(1)).alias("c"), F.sum("confidence").alias("_sum"), F.count("confidence").alias("_known")))
        n = counts.agg(F.sum("c")).first()[0] or 0
    else:
        n = results.count()
    rows: list[tuple] = [("total_texts", float(n), None)]

    def averages(*pairs):
        row = results.agg(*[e.alias(m) for m, e in pairs]).first()
        rows.extend((m, float(row[m]) if row[m] is not None else None, None) for m, _ in pairs)

    if task == "sentiment":
        averages(*[(f"{s}_count", F.count_if(F.col("sentiment") == s)) for s in ("positive", "negative", "neutral")], ("avg_confidence", F.avg("confidence")))
    elif task in _METRIC_COLUMNS:
        k, best, _ = _most_common(counts, col)
        mean = counts.agg(F.try_divide(F.sum("_sum"), F.sum("_known"))).first()[0]
        rows += [(f"unique_{plural}", float(k), None), (f"most_common_{col}", None, best), ("avg_confidence", None if mean is None else float(mean), None)]
    elif task == "entity_extraction":
        counts = saved(results.select(F.explode_outer("entities.type").alias("type")).where(F.col("type").isNotNull()).groupBy("type").agg(F.count(F.lit(1)).alias("c")))
        m = counts.agg(F.sum("c")).first()[0] or 0
        best = _most_common(counts, "type")[1]
        rows += [("total_entities", float(m), None), ("avg_entities_per_text", m / n if n else 0.0, None), ("most_common_entity_type", None, best)]
    elif task == "embedding":
        averages(("embedding_dimension", F.max(F.size("embedding"))), ("avg_text_length", F.avg(F.length("text"))))
    elif task == "summarization":
        r = F.col("compression_ratio")
        averages(("avg_compression_ratio", F.avg(r)), ("min_compression_ratio", F.min(r)), ("max_compression_ratio", F.max(r)))
    elif task == "keyword_extraction":
        counts = results.select(F.explode_outer("keywords").alias("w")).where(F.col("w").isNotNull()).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
        m, unique = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        rows += [("total_keywords", float(m), None), ("unique_keywords", float(unique), None), ("avg_keywords_per_text", m / n if n else 0.0, None)]
    return results.sparkSession.createDataFrame(rows, "metric string, number double, label string")


def keyword_arrays(df: DataFrame, key: str, text: str, k: int = 5, p: int = 3) -> DataFrame:
    """keywords() as two arrays per text; texts without any, or without a key, keep empty arrays."""
    empty = F.array().cast("array<string>")
    if _single_keys(df, key):
        # each key has one row, which stays where it is
        rows = df.select(key, text)
        for name, n, part in (("keywords", k, 0), ("phrases", p, 1)):
            spots = _row_spots(None)[part]
            rows = _runs(rows.withColumn("_w", plain_words(text)), spots).withColumn(name, F.transform(_first_runs(n), lambda r: r["term"])).drop("_runs", "_w")
        return rows.select(key, *[F.when(F.col(key).isNotNull(), F.col(c)).otherwise(empty).alias(c) for c in ("keywords", "phrases")])
    found = keywords(df, key, text, k, p).groupBy(key).agg(
        *[
            F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "term")))), lambda s: s["term"]).alias(name)
            for kind, name in (("keyword", "keywords"), ("phrase", "phrases"))
        ]
    )
    return df.select(key).join(found, key, "left").withColumns({c: F.coalesce(c, empty) for c in ("keywords", "phrases")})


def batch_annotate(df: DataFrame, text: str, fn, schema: str, batch: int = 10, fallback: dict[str, Column] | None = None) -> DataFrame:
    """Call ``fn(list of texts)`` once per batch; it returns one record (dict) per text, or JSON text of them.

    Rows of a failed batch, or records that do not parse, take the ``fallback`` columns.
    """
    columns = df.columns

    def annotate(frames):
        import json

        import pandas as pd

        for frame in frames:
            answers = []
            for start in range(0, len(frame), batch):
                texts = ["" if t is None else t for t in frame[text].iloc[start : start + batch]]
                try:
                    records = fn(texts)
                    records = json.loads(records) if isinstance(records, str) else list(records)
                    if len(records) != len(texts):
                        raise ValueError("one record per text expected")
                    answers += [json.dumps(r) for r in records]
                except Exception:
                    answers += [None] * len(texts)
            yield frame[columns].assign(_answer=pd.Series(answers, index=frame.index, dtype="object"))

    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _answer string"
    answered = df.mapInPandas(annotate, out_schema).withColumn("_r", F.from_json("_answer", schema))
    made = {}
    for part in answered.schema["_r"].dataType.names:
        value = F.col(f"_r.{part}")
        made[part] = F.coalesce(value, fallback[part]) if fallback and part in fallback else value
    return answered.withColumns(made).drop("_answer", "_r")


def text_suitability(df: DataFrame, order_by, n: int = 5, limit: float = 10) -> DataFrame:
    """Is the average length of the first n values of each text column above the limit?"""
    cols = text_cols(df)
    head = df.orderBy(*as_list(order_by)).limit(n)
    row = head.agg(*[F.avg(F.length(c)).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    rows = [(c, row[f"a{i}"], row[f"a{i}"] is not None and row[f"a{i}"] > limit) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column_name string, avg_length double, is_text boolean")


def annotate_texts(df: DataFrame, text: str, op: str = "both", categories="positive,negative,neutral") -> DataFrame:
    """Category with confidence and/or summary with length; null texts keep the defaults."""
    known, out = F.col(text).isNotNull(), df
    if op in ("classification", "both"):
        # made outside the condition on the text, where equal parts are made once
        c = custom_columns(text, categories)
        out = out.withColumn("_c", F.struct(c["category"].alias("category"), c["confidence"].alias("confidence")))
        out = out.withColumns({
            "text_category": F.when(known, F.col("_c.category")).otherwise("unprocessed"),
            "classification_confidence": F.when(known, F.col("_c.confidence")).otherwise(F.lit(0.0)),
        }).drop("_c")
    if op in ("summarization", "both"):
        made = summarize_extractive(out.withColumn("_kept", F.struct(*[F.col(f"`{c}`") for c in out.columns])).select("_kept", text), text)
        s = F.col("summary")
        columns = {"text_summary": F.when(known, s).otherwise(""), "summary_length": F.when(known, F.length(s)).otherwise(0)}
        out = made.withColumns(columns).select("_kept.*", *columns)
    return out
