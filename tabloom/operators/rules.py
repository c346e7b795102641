"""Recommendations: conditions over a report turn into alert rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: (condition on a report row, title, priority); per rule set, all that hold are reported
RULES = {
    "drift": [
        ("overall_drift_score > 0.3", "Investigate High Drift", "High"),
        ("overall_drift_score > 0.1", "Retrain Models", "High"),
        ("detected_columns = 0", "No Significant Drift Detected", "Low"),
        ("detected_columns > 0 AND high_columns > 0", "High Drift Alert", "High"),
    ],
    "catalog": [
        ("completeness < 90", "Implement missing value handling strategies", "High"),
        ("confidential_columns > 0", "Implement data masking and encryption", "Critical"),
        ("row_count > 100000", "Implement data partitioning and indexing", "Medium"),
        ("text_columns > 0", "Standardize text data formats", "Medium"),
    ],
    "documentation": [
        ("missing_cells > 0", "Data Quality Check", "Medium"),
        ("row_count > 100000", "Large Dataset", "Medium"),
    ],
    "etl": [
        ("quality_issues > 0", "Implement data validation checks", "High"),
        ("row_count > 100000", "Consider data partitioning strategies", "Medium"),
        ("missing_cells > 0", "Implement robust missing value handling in ETL pipeline", "Medium"),
        ("duplicate_rows > 0", "Add deduplication step in ETL process", "Medium"),
    ],
    "governance": [
        ("quality_score >= 90", "Excellent Data Quality Foundation", "Medium"),
        ("quality_score >= 70 AND quality_score < 90", "Good Data Quality with Improvement Opportunities", "Medium"),
        ("quality_score < 70", "Critical Data Quality Issues Detected", "Critical"),
        ("risk_level = 'High'", "High Risk Model Deployment", "Critical"),
    ],
    "clustering": [
        ("silhouette > 0.7", "Excellent Clustering Quality", "High"),
        ("silhouette > 0.5 AND silhouette <= 0.7", "Good Clustering Quality", "High"),
        ("silhouette > 0.3 AND silhouette <= 0.5", "Fair Clustering Quality", "High"),
        ("silhouette <= 0.3", "Poor Clustering Quality", "High"),
        ("cluster_count >= 3", "Customer Segmentation Opportunity", "High"),
    ],
    "best_model": [
        ("score > 0.9", "Excellent Model Performance", "High"),
        ("score > 0.8 AND score <= 0.9", "Good Model Performance", "Medium"),
        ("score <= 0.8", "Model Performance Needs Improvement", "High"),
    ],
    "training": [
        ("accuracy > 0.9", "Excellent Model Performance", "High"),
        ("accuracy > 0.8 AND accuracy <= 0.9", "Good Model Performance", "Medium"),
        ("accuracy <= 0.8", "Model Needs Improvement", "High"),
        ("r2 > 0.8", "Strong Predictive Model", "High"),
        ("r2 <= 0.8", "Model Performance Assessment", "Medium"),
    ],
    "forecast": [
        ("r_squared > 0.8", "Excellent Model Performance", "High"),
        ("r_squared > 0.5 AND r_squared <= 0.8", "Good Model Performance", "Medium"),
        ("r_squared <= 0.5", "Baseline Model Performance", "Medium"),
        ("trend_direction = 'Increasing'", "Positive Growth Trend Detected", "High"),
        ("trend_direction = 'Decreasing'", "Declining Trend Alert", "High"),
        ("trend_direction NOT IN ('Increasing', 'Decreasing')", "Stable Trend Pattern", "Medium"),
    ],
    "readiness": [
        ("quality_score > 90", "Excellent Data Quality for Deployment", "High"),
        ("quality_score > 70 AND quality_score <= 90", "Good Data Quality with Minor Issues", "Medium"),
        ("accuracy > 0.9", "High-Performance Model Ready for Production", "High"),
    ],
    "enrichment": [
        ("new_columns_added >= 0", "Data Enrichment Summary", "High"),
        ("original_missing_values > enriched_missing_values", "Data Quality Improvement", "High"),
    ],
    "sentiment": [
        ("positive_count > 0.6 * total_texts", "Predominantly Positive Sentiment", "Medium"),
        ("positive_count <= 0.6 * total_texts AND negative_count > 0.6 * total_texts", "Predominantly Negative Sentiment", "Medium"),
        ("positive_count <= 0.6 * total_texts AND negative_count <= 0.6 * total_texts", "Mixed Sentiment Distribution", "Medium"),
    ],
}


def apply_rules(report: DataFrame, ruleset: str, keep=()) -> DataFrame:
    """(kept columns, title, priority): one row for each rule that holds on a report row."""
    alerts = F.array(*[F.when(F.expr(cond), F.struct(F.lit(title).alias("title"), F.lit(priority).alias("priority"))) for cond, title, priority in RULES[ruleset]])
    return report.select(*keep, F.inline(F.filter(alerts, lambda a: a.isNotNull())))


def drift_advice(results: DataFrame, overall: DataFrame) -> DataFrame:
    facts = results.agg(F.count_if("drift_detected").alias("detected_columns"), F.count_if(F.col("drift_magnitude") == "High").alias("high_columns"))
    score = overall.first()["overall_drift_score"]
    return apply_rules(facts.withColumn("overall_drift_score", F.lit(score)), "drift")


def sentiment_advice(results: DataFrame) -> DataFrame:
    facts = results.agg(
        F.count(F.lit(1)).alias("total_texts"), F.count_if(F.col("sentiment") == "positive").alias("positive_count"), F.count_if(F.col("sentiment") == "negative").alias("negative_count")
    )
    return apply_rules(facts, "sentiment")


def most_common_note(results: DataFrame, col: str) -> DataFrame:
    """The most frequent value with its count and share (ties to the smaller value)."""
    counts = results.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("value_count"))
    n = results.count()
    return counts.orderBy(F.desc("value_count"), "value").limit(1).withColumn("value_pct", 100.0 * F.col("value_count") / n)


def matching_facts(marked: DataFrame, counts: DataFrame) -> DataFrame:
    """Duplicate rate, mean group size and the number of high-confidence pairs of distinct texts.

    ``counts`` has the class of each row and, in ``n_high``, the class's links, so each pair counts twice.
    """
    grouped = marked.groupBy("duplicate_group").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_duplicate").alias("d"))
    classes = counts.groupBy("class_id").agg(F.max("n_high").alias("n_high"))
    high = (classes.agg(F.sum("n_high").alias("h")).first()["h"] or 0) // 2
    inside = F.when(F.col("duplicate_group") != -1, F.col("n"))
    return grouped.agg((100.0 * F.sum("d") / F.sum("n")).alias("duplicate_rate_pct"), F.avg(inside).alias("mean_group_size")).withColumn("high_confidence_pairs", F.lit(high).cast("bigint"))
