"""Suitability labels: one column-facts pass, then a rule set picks the label of each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.columns import as_list, long_rows, text_cols
from tabloom.operators.profile import column_facts
from tabloom.operators.shape import datetime_or_null


def _parts():
    return F.col("kind") == "numeric", F.col("kind") == "text", F.col("unique_count"), F.col("row_count"), F.col("missing_pct")


def _named(words) -> Column:
    low = F.lower("column_name")
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def _feature_engineering():
    num, text, u, n, miss = _parts()
    label = (
        F.when(num & (u < 5), "Medium").when(num & (miss > 50), "Low").when(text & (u > 0.8 * n), "Low").otherwise("High")
    )
    return label, F.lit(None)


def _data_quality():
    *_, miss = _parts()
    return F.when(miss > 50, "Poor").when(miss > 20, "Fair").otherwise("Good"), F.lit(None)


def _documentation():
    num, text, u, _, miss = _parts()
    detail = (
        F.when(num, F.format_string("Numeric: %.2f to %.2f", "min_value", "max_value"))
        .when(text, F.format_string("Text/Categorical: %d unique values", u))
        .otherwise(F.format_string("Data type: %s", "data_type"))
    )
    return F.format_string("%.1f", 100 - miss), detail


def _drift():
    num, text, u, n, miss = _parts()
    detail = (
        F.when(num & (u < 2), "Constant")
        .when(num & (miss > 90), "Too many missing")
        .when(num, "Numerical Distribution")
        .when(text & (u > 0.9 * n), "High cardinality")
        .when(text, "Categorical Distribution")
        .otherwise("Statistical")
    )
    return F.when(detail.isin("Constant", "Too many missing", "High cardinality"), "No").otherwise("Yes"), detail


def _matching():
    num, text, u, _, miss = _parts()
    rich, constant = text & (F.col("avg_length") > 5) & (u > 1), text & (u == 1)
    label = F.when(rich, "Excellent").when(constant, "Poor").when(num & (u < 5), "Low").when(num & (miss > 50), "Poor").otherwise("High")
    detail = F.when(rich, "Excellent").when(constant, "Poor").when(num & (u < 5), "Fair").when(num & (miss > 50), "Poor").otherwise("Good")
    return label, detail


def _time_series():
    num, text, u, _, miss = _parts()
    # fixed values: words that hint at a time column
    hinted = _named(["date", "time", "year", "month", "day", "timestamp"])
    label = (
        F.when(F.col("kind") == "datetime", "Excellent")
        .when(text & F.coalesce(F.col("all_dates"), F.lit(False)), "Good")
        .when(text & (hinted | F.coalesce(F.col("date_marks"), F.lit(False))), "Medium")
        .when(num & (u > 5) & (miss < 80), "Good")
        .otherwise("Low")
    )
    return label, F.lit(None)


def _governance():
    num, text, u, n, miss = _parts()
    wide_num, few_text = num & (u > 10) & (miss < 20), text & (u < 0.8 * n)
    label = F.when(wide_num | few_text, "High").otherwise("Medium")
    risk = F.when(few_text & _named(["id", "key"]), "High").when(wide_num & (miss > 10), "Medium").otherwise("Low")
    return label, risk


def _enrichment():
    num, text, u, n, _ = _parts()
    # fixed values: name hints and their reasons
    label = (
        F.when(_named(["name", "title", "description", "text", "comment", "email", "phone", "address", "location", "date", "time", "created", "updated"]), "High")
        .when(num, "Medium")
        .when(text & (u < 0.5 * n), "Medium")
        .when(u == 1, "Low")
        .otherwise("Medium")
    )
    reason = (
        F.when(_named(["name", "title", "description", "text", "comment"]), "Text data suitable for NLP enrichment")
        .when(_named(["email", "phone", "address", "location"]), "Contact data suitable for validation and standardization")
        .when(_named(["date", "time", "created", "updated"]), "Temporal data suitable for time-based features")
        .when(num, "Numeric data suitable for statistical enrichment")
        .when(text & (u < 0.5 * n), "Categorical data suitable for encoding and clustering")
        .when(u == 1, "Constant values - limited enrichment potential")
        .otherwise("General data suitable for basic enrichment")
    )
    return label, reason


def _clustering():
    num, text, u, n, miss = _parts()
    label = (
        F.when(num & (u < 3), "Low").when(num & (miss > 50), "Medium").when(text & (u > 0.8 * n), "Low")
        .when(text & (u >= 10), "Medium").otherwise("High")
    )
    return label, F.lit(None)


def _machine_learning():
    _, text, u, n, miss = _parts()
    return F.when((miss > 80) | (u == 1) | (text & (u > 0.8 * n)), "No").otherwise("Yes"), F.lit(None)


def _deployment():
    *_, miss = _parts()
    return F.when(miss > 50, "Low").when(miss > 20, "Medium").otherwise("High"), F.lit(None)


RULESETS = {
    "feature_engineering": _feature_engineering,
    "data_quality": _data_quality,
    "documentation": _documentation,
    "drift": _drift,
    "matching": _matching,
    "time_series": _time_series,
    "governance": _governance,
    "enrichment": _enrichment,
    "clustering": _clustering,
    "machine_learning": _machine_learning,
    "deployment": _deployment,
}


def _date_facts(df: DataFrame, cols) -> DataFrame:
    """Do all non-null texts of a column parse as timestamps, and does any hold a date separator?"""
    aggs, rows = [], []
    for i, c in enumerate(cols):
        aggs += [F.min(F.when(F.col(c).isNotNull(), datetime_or_null(c).isNotNull())).alias(f"p{i}"), F.max(F.col(c).rlike("[-/:]")).alias(f"m{i}")]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col(f"p{i}").alias("all_dates"), F.col(f"m{i}").alias("date_marks")))
    return long_rows(df.agg(*aggs), rows)


def suitability(df: DataFrame, ruleset: str, cols=None) -> DataFrame:
    """(column_name, label, detail) under one of the rule sets."""
    facts = column_facts(df, cols)
    if ruleset == "time_series":
        texts = text_cols(df, None if cols is None else as_list(cols))
        if texts:
            facts = facts.join(_date_facts(df, texts), "column_name", "left")
        else:
            facts = facts.withColumns({"all_dates": F.lit(False), "date_marks": F.lit(False)})
    label, detail = RULESETS[ruleset]()
    return facts.select("column_name", label.alias("label"), detail.cast("string").alias("detail"))


def target_candidates(df: DataFrame, cols=None, max_text: int = 50) -> DataFrame:
    """Which columns can be a training target, for which task, and the column's suitability as input."""
    num, text, u, n, miss = _parts()
    task = (
        F.when(num & u.between(2, 20), "classification").when(num & (u > 20), "regression").when(text & u.between(2, max_text), "classification")
    )
    fit = (
        F.when(num & (miss > 50), "Poor").when(num & (miss > 20), "Fair").when(text & (u > 0.8 * n), "Poor").when(text & (miss > 30), "Fair").otherwise("Good")
    )
    return column_facts(df, cols).select("column_name", "unique_count", task.isNotNull().alias("is_target"), task.alias("target_type"), fit.alias("ml_suitability"))
