"""Whole tools: compositions of the operators that answer one question about a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.columns import as_list
from tabloom.operators import catalog as G
from tabloom.operators import drift as D
from tabloom.operators.profile import column_quality, completeness_consistency
from tabloom.operators.rules import apply_rules, drift_advice


def drift_report(df: DataFrame, cols, order_by, ratio: float = 0.7, alpha: float = 0.05, how: str = "temporal") -> DataFrame:
    """Rows (section, item, detail, score): column results, the overall score and the advice."""
    reference, current = D.split_periods(df, order_by, ratio, how)
    results = D.detect_column_drift(reference, current, cols, alpha)
    # a few rows per column: materialise once, three reports read it
    rows = results.collect()
    results = df.sparkSession.createDataFrame(rows, results.schema)
    overall = D.overall_drift(results)
    section = results.select(F.lit("column").alias("section"), F.col("column_name").alias("item"), F.col("drift_magnitude").alias("detail"), F.col("drift_score").alias("score"))
    total = overall.select(
        F.lit("overall"), F.lit("drift_detected"), (F.col("overall_drift_score") > alpha).cast("string"), F.col("overall_drift_score")
    )
    advice = drift_advice(results, overall).select(F.lit("advice"), "title", "priority", F.lit(None).cast("double"))
    return section.union(total).union(advice)


def catalog_report(df: DataFrame, name: str) -> DataFrame:
    """Rows (section, item, detail, score): columns, table quality, tags and recommendations."""
    catalog = G.classify_columns({name: df})
    rows = catalog.collect()
    catalog = df.sparkSession.createDataFrame(rows, catalog.schema)
    quality = completeness_consistency(df)
    columns = catalog.select(F.lit("column").alias("section"), F.col("column_name").alias("item"), F.col("semantic_type").alias("detail"), F.col("quality_score").cast("double").alias("score"))
    overall = quality.select(F.lit("quality"), F.lit("overall_score"), "quality_level", "overall_score")
    tags = G.smart_tags(catalog).select(F.lit("tag"), "tag", "tag_type", "confidence")
    facts = catalog.agg(
        F.count_if(F.col("privacy_level") == "Confidential").alias("confidential_columns"), F.count_if(F.col("semantic_type").isin("Text", "Email", "Phone")).alias("text_columns")
    ).withColumns({"completeness": F.lit(quality.first()["completeness_score"]), "row_count": F.lit(df.count())})
    advice = apply_rules(facts, "catalog").select(F.lit("advice"), "title", "priority", F.lit(None).cast("double"))
    return columns.union(overall).union(tags).union(advice)


def governance_report(df: DataFrame, cols, compliance_score: float) -> DataFrame:
    """Rows (section, item, detail, score): column quality, risks, fairness, overall score and advice."""
    cols = as_list(cols)
    quality = column_quality(df, cols)
    rows = quality.collect()
    quality = df.sparkSession.createDataFrame(rows, quality.schema)
    risks = G.model_risks(df, cols)
    mean = sum(r["overall_score"] for r in rows) / len(rows) if rows else 0.0
    level = risks.where("category = 'Overall'").first()["level"]
    base = df.sparkSession.createDataFrame([(mean, level, float(compliance_score))], "quality_score double, risk_level string, compliance_score double")
    scored = G.governance_score(base)
    out = quality.select(F.lit("column").alias("section"), F.col("column_name").alias("item"), F.col("governance_flags").alias("detail"), F.col("overall_score").alias("score"))
    out = out.union(risks.select(F.lit("risk"), "category", "level", F.lit(None).cast("double")))
    out = out.union(G.fairness_score(df, cols).select(F.lit("fairness"), F.lit("fairness_score"), F.lit(""), F.col("fairness_score").cast("double")))
    out = out.union(scored.select(F.lit("overall"), F.lit("grade"), "grade", "overall_score"))
    return out.union(apply_rules(base, "governance").select(F.lit("advice"), "title", "priority", F.lit(None).cast("double")))
