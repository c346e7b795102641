"""Data catalogue and governance.  A catalogue has one row per (table, column), over any number of tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.columns import as_list, numeric_cols
from tabloom.functions.scalars import band
from tabloom.operators.profile import column_facts, cv_risk, pct

# fixed values: name keywords in order of precedence, with type, meaning, category and privacy level
SEMANTIC_RULES = [
    (["id", "identifier", "key"], "Identifier", "Unique identifier for records", "General", "Public"),
    (["name", "title", "label"], "Name", "Descriptive name or title", "General", "Public"),
    (["email", "mail"], "Email", "Email address", "Personal", "Confidential"),
    (["phone", "tel", "mobile"], "Phone", "Phone number", "Personal", "Confidential"),
    (["date", "time", "created", "updated"], "DateTime", "Date or timestamp information", "General", "Public"),
    (["amount", "price", "cost", "value", "salary"], "Amount", "Monetary or numeric value", "Financial", "Public"),
]
#: How much a word counts in each field of a catalogue, and the two constants of BM25.
FIELD_WEIGHTS = {"column_name": 2, "semantic_type": 3, "business_meaning": 2, "data_category": 1}
K1, B = 1.2, 0.75
# fixed values: names that suggest private, demographic or geographic data
PRIVATE_NAMES = ["email", "phone", "ssn", "id", "name", "address"]
DEMOGRAPHIC_NAMES = ["age", "gender", "race", "ethnicity", "religion", "nationality"]
GEOGRAPHIC_NAMES = ["zip", "postal", "city", "state", "country", "address"]
# fixed values: score of a risk level and the weights of the overall governance score
RISK_SCORES = {"Low": 90, "Medium": 70, "High": 40}
GOVERNANCE_WEIGHTS = (0.4, 0.3, 0.3)


def classify_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Catalogue rows of all tables."""
    out = None
    for name, df in tables.items():
        order = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
        facts = column_facts(df).withColumns({"table_name": F.lit(name), "position": order[F.col("column_name")]})
        out = facts if out is None else out.unionByName(facts)
    low = F.lower("column_name")

    def rule(position):
        col = None
        for words, *values in SEMANTIC_RULES:
            hit = low.contains(words[0])
            for w in words[1:]:
                hit = hit | low.contains(w)
            col = F.when(hit, values[position]) if col is None else col.when(hit, values[position])
        return col

    num, text = F.col("kind") == "numeric", F.col("kind") == "text"
    return out.select(
        "table_name",
        "position",
        "column_name",
        "data_type",
        rule(0).when(num, "Numeric").when(text, "Text").otherwise("General").alias("semantic_type"),
        rule(1).when(num, "Numeric measurement or count").when(text, "Text or categorical data").otherwise("General data column").alias("business_meaning"),
        rule(2).otherwise("General").alias("data_category"),
        rule(3).otherwise("Public").alias("privacy_level"),
        F.greatest(F.lit(0.0), 100 - F.col("missing_pct")).cast("int").alias("quality_score"),
        F.concat_ws(", ", F.when(F.col("has_at"), "Email pattern"), F.when(F.col("has_digit"), "Contains numbers")).alias("patterns_detected"),
        "missing_pct",
        "unique_count",
    )


def smart_tags(catalog: DataFrame) -> DataFrame:
    """Tags of each table: first five types, first three categories, sensitive data, quality."""

    def counted(col, k, fmt, kind, confidence):
        seen = catalog.groupBy("table_name", col).agg(F.count(F.lit(1)).alias("tag_count"), F.min("position").alias("p"))
        ranked = seen.withColumn("r", F.row_number().over(Window.partitionBy("table_name").orderBy("p"))).where(F.col("r") <= k)
        return ranked.select("table_name", F.format_string(fmt, col).alias("tag"), F.lit(kind).alias("tag_type"), F.lit(confidence).alias("confidence"), "tag_count", F.lit(None).cast("double").alias("score"))

    per_table = catalog.groupBy("table_name").agg(F.count_if(F.col("privacy_level") == "Confidential").alias("c"), F.avg("quality_score").alias("q"))
    none_count, none_score = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    private = per_table.where("c > 0").select("table_name", F.lit("Contains Sensitive Data").alias("tag"), F.lit("privacy").alias("tag_type"), F.lit(0.95).alias("confidence"), F.col("c").alias("tag_count"), none_score.alias("score"))
    good = F.col("q") > 90
    quality = per_table.where(good | (F.col("q") < 60)).select(
        "table_name", F.when(good, "High Quality Dataset").otherwise("Needs Data Cleaning").alias("tag"), F.lit("quality").alias("tag_type"),
        F.when(good, 0.9).otherwise(0.8).alias("confidence"), none_count.alias("tag_count"), F.round("q", 1).alias("score"),
    )
    types = counted("semantic_type", 5, "Contains %s", "semantic", 0.9)
    return types.unionByName(counted("data_category", 3, "%s Data", "category", 0.8)).unionByName(private).unionByName(quality)


def catalog_search(catalog: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Word hits: type 3, meaning 2, category 1, column name 2; best k."""
    words = F.array(*[F.lit(w) for w in query.lower().split()])

    def hit(col, points):
        text = F.lower(col)
        return F.when(F.exists(words, lambda w: text.contains(w)), points).otherwise(0)

    score = hit("semantic_type", 3) + hit("business_meaning", 2) + hit("data_category", 1) + hit("column_name", 2)
    found = catalog.withColumn("relevance_score", score).where(F.col("relevance_score") > 0)
    best = found.orderBy(F.desc("relevance_score"), "table_name", "position").limit(k)
    return best.select("table_name", "column_name", "semantic_type", "business_meaning", "relevance_score")


def search_index(catalog: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(table_name, column_name, term, tf, length, df, columns, mean_length): an inverted index of a catalogue.

    A column's terms come from its name, type, meaning and category, weighted by ``FIELD_WEIGHTS``, and from
    ``values`` (table_name, column_name, value), such as its frequent values.
    """

    def terms(df, field, weight):
        found = F.regexp_extract_all(F.lower(F.coalesce(F.col(field).cast("string"), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
        return df.select("table_name", "column_name", F.explode(found).alias("term"), F.lit(float(weight)).alias("w"))

    parts = [terms(catalog, f, w) for f, w in FIELD_WEIGHTS.items()]
    if values is not None:
        parts.append(terms(values, "value", 1))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    tf = rows.groupBy("table_name", "column_name", "term").agg(F.sum("w").alias("tf"))
    lengths = tf.groupBy("table_name", "column_name").agg(F.sum("tf").alias("length"))
    whole = catalog.agg(F.count(F.lit(1)).alias("columns")).join(F.broadcast(lengths.agg(F.sum("length").alias("_all"))))  # one row each
    whole = whole.select("columns", (F.col("_all") / F.col("columns")).alias("mean_length"))
    known = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(lengths, ["table_name", "column_name"]).join(known, "term").join(F.broadcast(whole))


def ranked_search(index: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The ``k`` columns with the highest BM25 score for the words of ``query``."""
    words = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    rarity = F.log(1 + (F.col("columns") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    hits = index.where(F.col("term").isin(words)).groupBy("table_name", "column_name").agg(F.sum(rarity * share).alias("score"), F.count(F.lit(1)).alias("words_found"))
    return hits.orderBy(F.desc(F.round("score", 9)), "table_name", "column_name").limit(k)


def _name_hits(cols, words) -> list[str]:
    return [c for c in cols if any(w in c.lower() for w in words)]


def model_risks(df: DataFrame, cols=None) -> DataFrame:
    """Data drift (spread of numbers), complexity (number of columns), privacy (names) and the overall level."""
    cols = df.columns if cols is None else as_list(cols)
    rows = []
    if df.count() > 100 and numeric_cols(df, cols):
        levels = {r["drift_risk"] for r in cv_risk(df, cols).collect()}
        rows.append(("Data Drift", next(x for x in ("High", "Medium", "Low") if x in levels)))
    rows.append(("Model Complexity", "High" if len(cols) > 20 else "Medium" if len(cols) > 10 else "Low"))
    rows.append(("Data Privacy", "High" if _name_hits(cols, PRIVATE_NAMES) else "Low"))
    rows.append(("Overall", "High" if any(level == "High" for _, level in rows) else "Medium"))
    return df.sparkSession.createDataFrame(rows, "category string, level string")


def fairness_score(df: DataFrame, cols=None) -> DataFrame:
    cols = df.columns if cols is None else as_list(cols)
    demographic, geographic = _name_hits(cols, DEMOGRAPHIC_NAMES), _name_hits(cols, GEOGRAPHIC_NAMES)
    score = 60 if demographic else 75 if geographic else 95
    return df.sparkSession.createDataFrame([(score, len(demographic) + len(geographic))], "fairness_score int, indicator_count int")


def bias_indicators(df: DataFrame, cols=None, outcome: str | None = None) -> DataFrame:
    """Columns with demographic or geographic names: share (and mean outcome) of each of their groups."""
    cols = df.columns if cols is None else as_list(cols)
    flagged = [(c, "Demographic Attribute", "High") for c in _name_hits(cols, DEMOGRAPHIC_NAMES)]
    flagged += [(c, "Geographic Bias", "Medium") for c in _name_hits(cols, GEOGRAPHIC_NAMES)]
    schema = "column_name string, bias_type string, risk_level string, group_value string, group_share double, outcome_mean double"
    if not flagged:
        return df.sparkSession.createDataFrame([], schema)
    mean = F.avg(outcome) if outcome else F.lit(None).cast("double")
    out = None
    n = df.count()
    for c, kind, risk in flagged:
        groups = df.groupBy(F.col(c).cast("string").alias("group_value")).agg(F.count(F.lit(1)).alias("_n"), mean.alias("outcome_mean"))
        part = groups.select(F.lit(c).alias("column_name"), F.lit(kind).alias("bias_type"), F.lit(risk).alias("risk_level"), "group_value", pct(F.col("_n"), F.lit(n)).alias("group_share"), "outcome_mean")
        out = part if out is None else out.unionByName(part)
    return out


def audit_record(df: DataFrame, cols, name: str, decision: str = "Column Selection for Analysis") -> DataFrame:
    """Dataset facts of an audit as one row; types and missing counts are JSON objects."""
    cols = as_list(cols)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in cols}
    missing = F.to_json(F.struct(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]))
    return df.agg(
        F.lit(name).alias("dataset_name"), F.count(F.lit(1)).alias("total_records"), F.lit(len(df.columns)).alias("total_columns"),
        F.lit(", ".join(cols)).alias("selected_columns"), F.lit(json.dumps(types, separators=(",", ":"))).alias("data_types"), missing.alias("missing_data"), F.lit(decision).alias("decision"),
    )


def governance_columns(df: DataFrame, quality: DataFrame, run_time: str) -> DataFrame:
    """Attach the review mark, the mean score, and each column's score and flags (one quality row per column)."""
    rows = quality.select("column_name", "overall_score", "governance_flags").collect()
    mean = sum(r["overall_score"] for r in rows) / len(rows) if rows else 0.0
    made: dict[str, Column] = {"governance_reviewed": F.lit(True), "governance_timestamp": F.lit(run_time), "data_quality_score": F.lit(mean)}
    for r in rows:
        made[f"{r['column_name']}_quality_score"] = F.lit(r["overall_score"])
        made[f"{r['column_name']}_governance_flags"] = F.lit(r["governance_flags"])
    return df.withColumns(made)


def governance_score(scores: DataFrame) -> DataFrame:
    """Add the weighted score and grade to rows of (quality_score, risk_level, compliance_score)."""
    risk = F.lit(50)
    for level, value in RISK_SCORES.items():
        risk = F.when(F.col("risk_level") == level, F.lit(value)).otherwise(risk)
    wq, wr, wc = GOVERNANCE_WEIGHTS
    overall = F.col("quality_score") * wq + risk * wr + F.col("compliance_score") * wc
    return scores.withColumns({"risk_component": risk, "overall_score": overall, "grade": band(overall, [90, 80, 70], ["A", "B", "C", "D"])})
