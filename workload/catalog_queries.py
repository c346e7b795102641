"""Suitability labels, catalogue, governance, rules and whole reports."""

from pyspark.sql import functions as F

from tabloom.operators import catalog as G
from tabloom.operators import drift as D
from tabloom.operators import forecast as X
from tabloom.operators import matching as M
from tabloom.operators import profile as P
from tabloom.operators import rules as R
from tabloom.operators import suitability as U
from tabloom.operators import text as T
from tabloom.plans import reports
from workload import drift_queries as DQ
from workload import matching_queries as MQ
from workload import text_queries as TQ
from workload.profile_queries import CUSTOMER, ORDERS, PART, PART_COLS, PART_SRC, column_quality_sql, dup_sql, facts_sql, missing_sql
from workload.registry import query, union_all
from workload.shape_queries import part_with_nulls

# part with a mostly empty number, a constant and a date text
MIX_SRC = f"(SELECT s.*, CASE WHEN p_size <= 10 THEN p_size END AS sparse, 'same' AS fixed_value, '2024-01-0' || CAST(1 + p_size % 9 AS VARCHAR) AS day_text FROM {PART_SRC} s)"
MIX = PART + [("sparse", "int", "numeric"), ("fixed_value", "string", "text"), ("day_text", "string", "text")]


def mixed(t):
    return part_with_nulls(t).withColumns(
        {
            "sparse": F.when(F.col("p_size") <= 10, F.col("p_size")),
            "fixed_value": F.lit("same"),
            "day_text": F.concat(F.lit("2024-01-0"), (1 + F.col("p_size") % 9).cast("string")),
        }
    )


FACTS = f"({facts_sql(MIX_SRC, MIX)})"
NUM, TEXT, NAME = "kind = 'numeric'", "kind = 'text'", "lower(column_name)"


def named(words):
    return "(" + " OR ".join(f"contains({NAME}, '{w}')" for w in words) + ")"


_LABELS = {
    "feature_engineering": (f"CASE WHEN {NUM} AND unique_count < 5 THEN 'Medium' WHEN {NUM} AND missing_pct > 50 THEN 'Low' WHEN {TEXT} AND unique_count > row_count * 0.8 THEN 'Low' ELSE 'High' END", "NULL"),
    "data_quality": ("CASE WHEN missing_pct > 50 THEN 'Poor' WHEN missing_pct > 20 THEN 'Fair' ELSE 'Good' END", "NULL"),
    "documentation": (
        "printf('%.1f', 100 - missing_pct)",
        "CASE kind WHEN 'numeric' THEN printf('Numeric: %.2f to %.2f', min_value, max_value) WHEN 'text' THEN printf('Text/Categorical: %d unique values', unique_count) ELSE 'Data type: ' || data_type END",
    ),
    "drift": (
        f"CASE WHEN ({NUM} AND (unique_count < 2 OR missing_pct > 90)) OR ({TEXT} AND unique_count > 0.9 * row_count) THEN 'No' ELSE 'Yes' END",
        f"CASE WHEN {NUM} AND unique_count < 2 THEN 'Constant' WHEN {NUM} AND missing_pct > 90 THEN 'Too many missing' WHEN {NUM} THEN 'Numerical Distribution' WHEN {TEXT} AND unique_count > 0.9 * row_count THEN 'High cardinality' WHEN {TEXT} THEN 'Categorical Distribution' ELSE 'Statistical' END",
    ),
    "matching": (
        f"CASE WHEN {TEXT} AND avg_length > 5 AND unique_count > 1 THEN 'Excellent' WHEN {TEXT} AND unique_count = 1 THEN 'Poor' WHEN {NUM} AND unique_count < 5 THEN 'Low' WHEN {NUM} AND missing_pct > 50 THEN 'Poor' ELSE 'High' END",
        f"CASE WHEN {TEXT} AND avg_length > 5 AND unique_count > 1 THEN 'Excellent' WHEN {TEXT} AND unique_count = 1 THEN 'Poor' WHEN {NUM} AND unique_count < 5 THEN 'Fair' WHEN {NUM} AND missing_pct > 50 THEN 'Poor' ELSE 'Good' END",
    ),
    "time_series": (
        f"CASE WHEN kind = 'datetime' THEN 'Excellent' WHEN column_name = 'day_text' THEN 'Good' WHEN {TEXT} AND ({named(['date', 'time', 'year', 'month', 'day', 'timestamp'])} OR (column_name = 'p_name' AND (SELECT bool_or(regexp_matches(p_name, '[-/:]')) FROM part)) "
        f"OR (column_name = 'p_brand' AND (SELECT bool_or(regexp_matches(p_brand, '[-/:]')) FROM part)) OR (column_name = 'p_type' AND (SELECT bool_or(regexp_matches(p_type, '[-/:]')) FROM part))) THEN 'Medium' WHEN {NUM} AND unique_count > 5 AND missing_pct < 80 THEN 'Good' ELSE 'Low' END",
        "NULL",
    ),
    "governance": (
        f"CASE WHEN ({NUM} AND unique_count > 10 AND missing_pct < 20) OR ({TEXT} AND unique_count < 0.8 * row_count) THEN 'High' ELSE 'Medium' END",
        f"CASE WHEN {TEXT} AND unique_count < 0.8 * row_count AND {named(['id', 'key'])} THEN 'High' WHEN {NUM} AND unique_count > 10 AND missing_pct > 10 AND missing_pct < 20 THEN 'Medium' ELSE 'Low' END",
    ),
    "enrichment": (
        f"CASE WHEN {named(['name', 'title', 'description', 'text', 'comment', 'email', 'phone', 'address', 'location', 'date', 'time', 'created', 'updated'])} THEN 'High' WHEN {NUM} THEN 'Medium' WHEN {TEXT} AND unique_count < 0.5 * row_count THEN 'Medium' WHEN unique_count = 1 THEN 'Low' ELSE 'Medium' END",
        f"CASE WHEN {named(['name', 'title', 'description', 'text', 'comment'])} THEN 'Text data suitable for NLP enrichment' WHEN {named(['email', 'phone', 'address', 'location'])} THEN 'Contact data suitable for validation and standardization' "
        f"WHEN {named(['date', 'time', 'created', 'updated'])} THEN 'Temporal data suitable for time-based features' WHEN {NUM} THEN 'Numeric data suitable for statistical enrichment' WHEN {TEXT} AND unique_count < 0.5 * row_count THEN 'Categorical data suitable for encoding and clustering' "
        "WHEN unique_count = 1 THEN 'Constant values - limited enrichment potential' ELSE 'General data suitable for basic enrichment' END",
    ),
    "clustering": (
        f"CASE WHEN {NUM} AND unique_count < 3 THEN 'Low' WHEN {NUM} AND missing_pct > 50 THEN 'Medium' WHEN {TEXT} AND unique_count > 0.8 * row_count THEN 'Low' WHEN {TEXT} AND unique_count >= 10 THEN 'Medium' ELSE 'High' END",
        "NULL",
    ),
    "machine_learning": (f"CASE WHEN missing_pct > 80 OR unique_count = 1 OR ({TEXT} AND unique_count > 0.8 * row_count) THEN 'No' ELSE 'Yes' END", "NULL"),
    "deployment": ("CASE WHEN missing_pct > 50 THEN 'Low' WHEN missing_pct > 20 THEN 'Medium' ELSE 'High' END", "NULL"),
}


def _register_suitability(ruleset, label, detail):
    @query(f"suitability_{ruleset}", f"SELECT column_name, {label} AS label, CAST({detail} AS VARCHAR) AS detail FROM {FACTS} f")
    def _(t):
        return U.suitability(mixed(t), ruleset)


for _r, (_l, _d) in _LABELS.items():
    _register_suitability(_r, _l, _d)


@query(
    "target_candidates",
    f"SELECT column_name, unique_count, target_type IS NOT NULL AS is_target, target_type, ml_suitability FROM (SELECT column_name, unique_count, CASE WHEN {NUM} AND unique_count BETWEEN 2 AND 20 THEN 'classification' WHEN {NUM} AND unique_count > 20 THEN 'regression' WHEN {TEXT} AND unique_count BETWEEN 2 AND 50 THEN 'classification' END AS target_type, "
    f"CASE WHEN {NUM} AND missing_pct > 50 THEN 'Poor' WHEN {NUM} AND missing_pct > 20 THEN 'Fair' WHEN {TEXT} AND unique_count > 0.8 * row_count THEN 'Poor' WHEN {TEXT} AND missing_pct > 30 THEN 'Fair' ELSE 'Good' END AS ml_suitability FROM {FACTS} f)",
)
def _(t):
    return U.target_candidates(mixed(t))


SUPPLIER = [("s_suppkey", "bigint", "numeric"), ("s_name", "string", "text"), ("s_nationkey", "int", "numeric"), ("s_acctbal", "double", "numeric")]
CONTACT = [("c_custkey", "bigint", "numeric"), ("contact_email", "string", "text"), ("phone", "string", "text"), ("c_acctbal", "double", "numeric"), ("c_mktsegment", "string", "text")]
CONTACT_SRC = "(SELECT c_custkey, lower(c_name) || '@mail.test' AS contact_email, CASE WHEN c_nationkey > 3 THEN CAST(c_nationkey AS VARCHAR) END AS phone, c_acctbal, c_mktsegment FROM customer)"


def contacts(t):
    return t.customer.select(
        "c_custkey", F.concat(F.lower("c_name"), F.lit("@mail.test")).alias("contact_email"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("string")).alias("phone"), "c_acctbal", "c_mktsegment"
    )


def _semantic(position, extra):
    cases = []
    for words, *values in G.SEMANTIC_RULES:
        cases.append(f"WHEN {named(words)} THEN '{values[position]}'")
    return f"CASE {' '.join(cases)} {extra} END"


def catalog_sql(tables):
    parts = []
    for name, src, cols in tables:
        pos = " ".join(f"WHEN '{c}' THEN {i}" for i, (c, _, _) in enumerate(cols))
        parts.append(
            f"SELECT '{name}' AS table_name, CASE column_name {pos} END AS position, column_name, data_type, "
            + _semantic(0, f"WHEN {NUM} THEN 'Numeric' WHEN {TEXT} THEN 'Text' ELSE 'General'") + " AS semantic_type, "
            + _semantic(1, f"WHEN {NUM} THEN 'Numeric measurement or count' WHEN {TEXT} THEN 'Text or categorical data' ELSE 'General data column'") + " AS business_meaning, "
            + _semantic(2, "ELSE 'General'") + " AS data_category, " + _semantic(3, "ELSE 'Public'") + " AS privacy_level, CAST(floor(greatest(0, 100 - missing_pct)) AS INTEGER) AS quality_score, "
            f"concat_ws(', ', CASE WHEN has_at THEN 'Email pattern' END, CASE WHEN has_digit THEN 'Contains numbers' END) AS patterns_detected, missing_pct, unique_count FROM ({facts_sql(src, cols)})"
        )
    return union_all(parts)


_CAT = catalog_sql([("contacts", CONTACT_SRC, CONTACT), ("orders", "orders", ORDERS), ("part", PART_SRC, PART), ("supplier", "supplier", SUPPLIER)])


def lake(t):
    return G.classify_columns({"contacts": contacts(t), "orders": t.orders, "part": part_with_nulls(t), "supplier": t.supplier})


@query("classify_columns", _CAT, rnd={6: "missing_pct"})
def _(t):
    return lake(t)


def tags_sql(cat):
    return (
        f"WITH c AS ({cat}), "
        + ", ".join(
            f"{n} AS (SELECT table_name, {col} AS x, count(*) AS k, row_number() OVER (PARTITION BY table_name ORDER BY min(position)) AS r FROM c GROUP BY 1, 2)"
            for n, col in (("s", "semantic_type"), ("d", "data_category"))
        )
        + ", q AS (SELECT table_name, count(*) FILTER (privacy_level = 'Confidential') AS p, avg(quality_score) AS a FROM c GROUP BY 1) "
        "SELECT table_name, 'Contains ' || x AS tag, 'semantic' AS tag_type, 0.9::DOUBLE AS confidence, k AS tag_count, NULL::DOUBLE AS score FROM s WHERE r <= 5 UNION ALL SELECT table_name, x || ' Data', 'category', 0.8, k, NULL FROM d WHERE r <= 3 "
        "UNION ALL SELECT table_name, 'Contains Sensitive Data', 'privacy', 0.95, p, NULL FROM q WHERE p > 0 UNION ALL SELECT table_name, CASE WHEN a > 90 THEN 'High Quality Dataset' ELSE 'Needs Data Cleaning' END, 'quality', CASE WHEN a > 90 THEN 0.9 ELSE 0.8 END, NULL, round(a, 1) FROM q WHERE a > 90 OR a < 60"
    )


@query("smart_tags", tags_sql(_CAT))
def _(t):
    return G.smart_tags(lake(t))


@query(
    "catalog_search",
    "SELECT table_name, column_name, semantic_type, business_meaning, relevance_score FROM (SELECT *, "
    + " + ".join(f"CASE WHEN contains(lower({c}), 'price') OR contains(lower({c}), 'name') THEN {p} ELSE 0 END" for c, p in (("semantic_type", 3), ("business_meaning", 2), ("data_category", 1), ("column_name", 2)))
    + f" AS relevance_score FROM ({_CAT})) WHERE relevance_score > 0 ORDER BY relevance_score DESC, table_name, position LIMIT 10",
)
def _(t):
    return G.catalog_search(lake(t), "Price name", 10)


_FREQUENT = "SELECT 'customer' AS table_name, 'c_mktsegment' AS column_name, c_mktsegment AS value FROM customer GROUP BY 3"
_TERMS = union_all(
    f"SELECT table_name, column_name, unnest(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')) AS term, {w}::DOUBLE AS w FROM ({src})"
    for c, w, src in (("column_name", 2, _CAT), ("semantic_type", 3, _CAT), ("business_meaning", 2, _CAT), ("data_category", 1, _CAT), ("value", 1, _FREQUENT))
)


@query(
    "catalog_ranked_search",
    f"WITH tf AS (SELECT table_name, column_name, term, sum(w) AS tf FROM ({_TERMS}) GROUP BY ALL), le AS (SELECT table_name, column_name, sum(tf) AS len FROM tf GROUP BY ALL), "
    f"n AS (SELECT count(*) AS n, (SELECT sum(len) FROM le) / count(*) AS mean FROM ({_CAT})), d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1) "
    "SELECT table_name, column_name, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score, count(*) AS words_found "
    "FROM tf JOIN le USING (table_name, column_name) JOIN d USING (term), n WHERE term IN ('customer', 'name', 'building', 'identifier') GROUP BY 1, 2 ORDER BY round(score, 9) DESC, 1, 2 LIMIT 10",
    rnd={8: "score"},
)
def _(t):
    values = t.customer.select(F.lit("customer").alias("table_name"), F.lit("c_mktsegment").alias("column_name"), F.col("c_mktsegment").alias("value")).distinct()
    return G.ranked_search(G.search_index(lake(t), values), "Customer name, BUILDING identifier", 10)


_CC = [c for c, _, _ in CONTACT]
_CCAT = catalog_sql([("contacts", CONTACT_SRC, CONTACT)])


@query(
    "catalog_report",
    f"WITH m AS (SELECT 100.0 * (1 - {missing_sql(CONTACT_SRC, _CC)} / (5 * (SELECT count(*) FROM customer))) AS comp, 100 - 100.0 * {dup_sql(CONTACT_SRC, _CC)} / (SELECT count(*) FROM customer) AS cons) "
    f"SELECT 'column' AS section, column_name AS item, semantic_type AS detail, CAST(quality_score AS DOUBLE) AS score FROM ({_CCAT}) "
    "UNION ALL SELECT 'quality', 'overall_score', CASE WHEN (comp + cons) / 2 >= 90 THEN 'Excellent' WHEN (comp + cons) / 2 >= 70 THEN 'Good' ELSE 'Fair' END, (comp + cons) / 2 FROM m "
    f"UNION ALL SELECT 'tag', tag, tag_type, confidence FROM ({tags_sql(_CCAT)}) "
    "UNION ALL SELECT 'advice', 'Implement missing value handling strategies', 'High', NULL FROM m WHERE comp < 90 UNION ALL SELECT 'advice', 'Implement data masking and encryption', 'Critical', NULL "
    "UNION ALL SELECT 'advice', 'Implement data partitioning and indexing', 'Medium', NULL WHERE (SELECT count(*) FROM customer) > 100000 UNION ALL SELECT 'advice', 'Standardize text data formats', 'Medium', NULL",
    rnd={6: "score"},
)
def _(t):
    return reports.catalog_report(contacts(t), "contacts")


_RISK_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CV = "(SELECT max(v) FROM (" + union_all(f"SELECT stddev_samp({c}) / avg({c}) AS v FROM lineitem" for c in _RISK_COLS) + "))"


@query(
    "model_risks",
    f"SELECT 'Data Drift' AS category, CASE WHEN {_CV} > 1 THEN 'High' WHEN {_CV} > 0.5 THEN 'Medium' ELSE 'Low' END AS level UNION ALL SELECT 'Model Complexity', 'Low' UNION ALL SELECT 'Data Privacy', 'Low' UNION ALL SELECT 'Overall', CASE WHEN {_CV} > 1 THEN 'High' ELSE 'Medium' END",
)
def _(t):
    return G.model_risks(t.lineitem, _RISK_COLS)


def people(t):
    return t.customer.select("c_custkey", F.col("c_nationkey").alias("nationality"), F.col("c_mktsegment").alias("city_segment"), "c_acctbal")


_PEOPLE = "(SELECT c_custkey, c_nationkey AS nationality, c_mktsegment AS city_segment, c_acctbal FROM customer)"


@query(
    "bias_indicators",
    union_all(
        f"SELECT '{c}' AS column_name, '{k}' AS bias_type, '{r}' AS risk_level, CAST({c} AS VARCHAR) AS group_value, 100.0 * count(*) / (SELECT count(*) FROM customer) AS group_share, avg(c_acctbal) AS outcome_mean FROM {_PEOPLE} p GROUP BY {c}"
        for c, k, r in (("nationality", "Demographic Attribute", "High"), ("city_segment", "Geographic Bias", "Medium"))
    ),
    rnd={6: "group_share", 4: "outcome_mean"},
)
def _(t):
    return G.bias_indicators(people(t), outcome="c_acctbal")


@query("fairness_score", "SELECT 60 AS fairness_score, 2 AS indicator_count FROM customer LIMIT 1")
def _(t):
    return G.fairness_score(people(t))


@query(
    "audit_record",
    f"SELECT 'parts' AS dataset_name, count(*) AS total_records, 6 AS total_columns, 'p_partkey, p_type, p_size' AS selected_columns, '{{\"p_partkey\":\"bigint\",\"p_type\":\"string\",\"p_size\":\"int\"}}' AS data_types, "
    f"CAST(to_json({{'p_partkey': count(*) - count(p_partkey), 'p_type': count(*) - count(p_type), 'p_size': count(*) - count(p_size)}}) AS VARCHAR) AS missing_data, 'Column Selection for Analysis' AS decision FROM {PART_SRC} s",
)
def _(t):
    return G.audit_record(part_with_nulls(t), ["p_partkey", "p_type", "p_size"], "parts")


_GQ = column_quality_sql("customer", CUSTOMER)


@query(
    "governance_columns",
    f"WITH q AS ({_GQ}) SELECT c_custkey, c_acctbal, true AS governance_reviewed, '2024-01-01 00:00:00' AS governance_timestamp, (SELECT avg(overall_score) FROM q WHERE column_name IN ('c_custkey', 'c_acctbal')) AS data_quality_score, "
    + ", ".join(f"(SELECT overall_score FROM q WHERE column_name = '{c}') AS {c}_quality_score, (SELECT governance_flags FROM q WHERE column_name = '{c}') AS {c}_governance_flags" for c in ("c_custkey", "c_acctbal"))
    + " FROM customer",
    rnd={6: "data_quality_score c_custkey_quality_score c_acctbal_quality_score"},
)
def _(t):
    df = t.customer.select("c_custkey", "c_acctbal")
    return G.governance_columns(df, P.column_quality(df), "2024-01-01 00:00:00")


@query(
    "governance_score",
    "SELECT *, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' ELSE 'D' END AS grade FROM (SELECT *, 0.4 * quality_score + 0.3 * risk_component + 0.3 * compliance_score AS overall_score FROM "
    "(SELECT p_partkey, CAST(50 + p_size AS DOUBLE) AS quality_score, CASE WHEN p_size > 30 THEN 'Low' WHEN p_size > 10 THEN 'Medium' ELSE 'High' END AS risk_level, CAST(100 - p_size / 2 AS DOUBLE) AS compliance_score, CASE WHEN p_size > 30 THEN 90 WHEN p_size > 10 THEN 70 ELSE 40 END AS risk_component FROM part))",
    rnd={6: "overall_score"},
)
def _(t):
    s = F.col("p_size")
    scores = t.part.select(
        "p_partkey", (50 + s).cast("double").alias("quality_score"), F.when(s > 30, "Low").when(s > 10, "Medium").otherwise("High").alias("risk_level"), (100 - s / 2).cast("double").alias("compliance_score")
    )
    return G.governance_score(scores)


_GSUM = f"(SELECT avg(overall_score) FROM ({_GQ}))"


@query(
    "governance_report",
    f"SELECT 'column' AS section, column_name AS item, governance_flags AS detail, overall_score AS score FROM ({_GQ}) UNION ALL SELECT 'risk', x, y, NULL FROM (SELECT 'Data Drift' AS x, CASE WHEN v > 1 THEN 'High' WHEN v > 0.5 THEN 'Medium' ELSE 'Low' END AS y FROM (SELECT max(v) AS v FROM ("
    + union_all(f"SELECT stddev_samp({c}) / avg({c}) AS v FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal"))
    + ")) UNION ALL SELECT 'Model Complexity', 'Low' UNION ALL SELECT 'Data Privacy', 'High' UNION ALL SELECT 'Overall', 'High') UNION ALL SELECT 'fairness', 'fairness_score', '', 95 "
    f"UNION ALL SELECT 'overall', 'grade', CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' ELSE 'D' END, s FROM (SELECT 0.4 * {_GSUM} + 0.3 * 40 + 0.3 * 80 AS s) "
    f"UNION ALL SELECT 'advice', CASE WHEN {_GSUM} >= 90 THEN 'Excellent Data Quality Foundation' WHEN {_GSUM} >= 70 THEN 'Good Data Quality with Improvement Opportunities' ELSE 'Critical Data Quality Issues Detected' END, CASE WHEN {_GSUM} >= 70 THEN 'Medium' ELSE 'Critical' END, NULL UNION ALL SELECT 'advice', 'High Risk Model Deployment', 'Critical', NULL",
    rnd={6: "score"},
)
def _(t):
    return reports.governance_report(t.customer, t.customer.columns, 80)


# ---- rules over reports
@query(
    "rules_sentiment",
    f"SELECT CASE WHEN p > 0.6 * n THEN 'Predominantly Positive Sentiment' WHEN g > 0.6 * n THEN 'Predominantly Negative Sentiment' ELSE 'Mixed Sentiment Distribution' END AS title, 'Medium' AS priority FROM (SELECT count(*) AS n, count(*) FILTER (sentiment = 'positive') AS p, count(*) FILTER (sentiment = 'negative') AS g FROM ({TQ._SENT}))",
)
def _(t):
    return R.sentiment_advice(T.sentiment(TQ.docs(t), "text"))


@query(
    "rules_most_common_topic",
    f"SELECT category AS value, count(*) AS value_count, 100.0 * count(*) / (SELECT count(*) FROM documents) AS value_pct FROM ({TQ._TOPICS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    rnd={6: "value_pct"},
)
def _(t):
    return R.most_common_note(T.classify_topics(TQ.docs(t), "text"), "category")


_OVER = f"(SELECT sum(drift_score * {DQ._W}) / sum({DQ._W}) FROM ({DQ._RESULTS}))"
_ADVICE = (
    f"SELECT title, priority FROM (SELECT {_OVER} AS o, count(*) FILTER (drift_detected) AS d, count(*) FILTER (drift_magnitude = 'High') AS h FROM ({DQ._RESULTS})), "
    "(VALUES ('Investigate High Drift', 'High', 1), ('Retrain Models', 'High', 2), ('No Significant Drift Detected', 'Low', 3), ('High Drift Alert', 'High', 4)) v(title, priority, k) "
    "WHERE (k = 1 AND o > 0.3) OR (k = 2 AND o > 0.1) OR (k = 3 AND d = 0) OR (k = 4 AND d > 0 AND h > 0)"
)


@query("rules_drift", _ADVICE)
def _(t):
    res = DQ.results(t)
    return R.drift_advice(res, D.overall_drift(res))


@query(
    "drift_report",
    f"SELECT 'column' AS section, column_name AS item, drift_magnitude AS detail, drift_score AS score FROM ({DQ._RESULTS}) UNION ALL SELECT 'overall', 'drift_detected', CAST(o > 0.05 AS VARCHAR), o FROM (SELECT {_OVER} AS o) UNION ALL SELECT 'advice', title, priority, NULL FROM ({_ADVICE})",
    rnd={8: "score"},
)
def _(t):
    return reports.drift_report(t.events.select("event_id", "ts", "user_id", "event_type", "value"), DQ.COLS, DQ.ORDER)


@query(
    "rules_documentation",
    f"SELECT 'Data Quality Check' AS title, 'Medium' AS priority WHERE {missing_sql(PART_SRC, PART_COLS)} > 0 UNION ALL SELECT 'Large Dataset', 'Medium' WHERE (SELECT count(*) FROM part) > 100000",
)
def _(t):
    return R.apply_rules(P.table_info(part_with_nulls(t)), "documentation")


@query(
    "rules_etl",
    f"SELECT 'Implement data validation checks' AS title, 'High' AS priority WHERE (SELECT count(*) FROM ({facts_sql(PART_SRC, PART)}) WHERE missing_pct > 20 OR (kind = 'text' AND unique_count > 0.8 * row_count)) > 0 "
    f"UNION ALL SELECT 'Consider data partitioning strategies', 'Medium' WHERE (SELECT count(*) FROM part) > 100000 UNION ALL SELECT 'Implement robust missing value handling in ETL pipeline', 'Medium' WHERE {missing_sql(PART_SRC, PART_COLS)} > 0 "
    f"UNION ALL SELECT 'Add deduplication step in ETL process', 'Medium' WHERE {dup_sql(PART_SRC, PART_COLS)} > 0",
)
def _(t):
    df = part_with_nulls(t)
    issues = P.quality_issues(df).count()
    return R.apply_rules(P.table_info(df).withColumn("quality_issues", F.lit(issues)), "etl")


@query(
    "rules_governance",
    "SELECT p_partkey, title, priority FROM (SELECT p_partkey, 50 + p_size AS q, p_size > 30 AS high FROM part), (VALUES (1, 'Excellent Data Quality Foundation', 'Medium'), (2, 'Good Data Quality with Improvement Opportunities', 'Medium'), (3, 'Critical Data Quality Issues Detected', 'Critical'), (4, 'High Risk Model Deployment', 'Critical')) v(k, title, priority) "
    "WHERE (k = 1 AND q >= 90) OR (k = 2 AND q >= 70 AND q < 90) OR (k = 3 AND q < 70) OR (k = 4 AND high)",
)
def _(t):
    scores = t.part.select("p_partkey", (50 + F.col("p_size")).alias("quality_score"), F.when(F.col("p_size") > 30, "High").otherwise("Low").alias("risk_level"))
    return R.apply_rules(scores, "governance", ["p_partkey"])


@query(
    "rules_forecast",
    f"SELECT series, CASE WHEN r_squared > 0.8 THEN 'Excellent Model Performance' WHEN r_squared > 0.5 THEN 'Good Model Performance' ELSE 'Baseline Model Performance' END AS title, CASE WHEN r_squared > 0.8 THEN 'High' ELSE 'Medium' END AS priority FROM ({DQ._METRICS}) "
    f"UNION ALL SELECT series, CASE trend_direction WHEN 'Increasing' THEN 'Positive Growth Trend Detected' WHEN 'Decreasing' THEN 'Declining Trend Alert' ELSE 'Stable Trend Pattern' END, CASE WHEN trend_direction = 'Stable' THEN 'Medium' ELSE 'High' END FROM ({DQ._METRICS})",
)
def _(t):
    return R.apply_rules(X.ts_metrics(DQ.monthly(t), 12, 0.95, "series"), "forecast", ["series"])


@query(
    "rules_enrichment",
    "SELECT 'Data Enrichment Summary' AS title, 'High' AS priority FROM part UNION SELECT 'Data Quality Improvement', 'High' FROM part WHERE p_size % 10 = 0",
)
def _(t):
    before = part_with_nulls(t)
    return R.apply_rules(P.enrichment_delta(before, before.na.fill({"p_type": "Unknown"}).withColumn("flag", F.lit(1))), "enrichment")


@query(
    "rules_readiness",
    "SELECT s_suppkey, 'Excellent Data Quality for Deployment' AS title, 'High' AS priority FROM supplier WHERE s_nationkey * 5 > 90 UNION ALL SELECT s_suppkey, 'Good Data Quality with Minor Issues', 'Medium' FROM supplier WHERE s_nationkey * 5 > 70 AND s_nationkey * 5 <= 90 "
    "UNION ALL SELECT s_suppkey, 'High-Performance Model Ready for Production', 'High' FROM supplier WHERE s_acctbal / 10000 > 0.9",
)
def _(t):
    df = t.supplier.select("s_suppkey", (F.col("s_nationkey") * 5).alias("quality_score"), (F.col("s_acctbal") / 10000).alias("accuracy"))
    return R.apply_rules(df, "readiness", ["s_suppkey"])


@query(
    "matching_facts",
    f"WITH d AS ({MQ._DUP}) SELECT 100.0 * count(*) FILTER (is_duplicate) / count(*) AS duplicate_rate_pct, (SELECT avg(n) FROM (SELECT count(*) AS n FROM d WHERE duplicate_group <> -1 GROUP BY duplicate_group)) AS mean_group_size, "
    f"(WITH {MQ._V}, {MQ._COPIES}, p AS ({MQ._P}) SELECT count(*) FROM p JOIN c a ON i = a.rep JOIN c b ON j = b.rep WHERE similarity > 0.9) AS high_confidence_pairs FROM d",
    rnd={6: "duplicate_rate_pct mean_group_size"},
)
def _(t):
    return R.matching_facts(*MQ.duplicates_and_links(t))
