"""Imputation, standardisation, validation and anomaly flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.columns import as_list, numeric_cols, text_cols
from tabloom.functions import scalars as X
from tabloom.operators.ordered import dedupe_first
from tabloom.operators.profile import iqr_table, is_outside, modes
from tabloom.operators.quantiles import exact_quantiles


def fill_values(df: DataFrame, cols, numeric: str = "median", text: str = "mode") -> dict:
    """{column: value for its nulls}; one number or text per column reaches the driver."""
    cols = as_list(cols)
    numbers, texts = numeric_cols(df, cols), text_cols(df, cols)
    out = {}
    if numeric == "median":
        out.update({c: q[0] for c, q in exact_quantiles(df, numbers, [0.5]).items()})
    elif numbers:
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
        out.update({c: row[f"m{i}"] for i, c in enumerate(numbers)})
    found = modes(df, texts) if text == "mode" else dict.fromkeys(texts)
    out.update({c: v if v is not None else "Unknown" for c, v in found.items()})
    return out


def apply_fill(df: DataFrame, values: dict) -> DataFrame:
    """Integers become double when filled with a fractional median or mean."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def impute(df: DataFrame, cols, numeric: str = "median", text: str = "mode") -> DataFrame:
    return apply_fill(df, fill_values(df, cols, numeric, text))


def columns_with_nulls(df: DataFrame, cols) -> dict:
    cols = as_list(cols)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(cols) if row[f"n{i}"] > 0}


def impute_with_confidence(df: DataFrame, cols, numeric: str = "median", text: str = "mode") -> DataFrame:
    """Fill nulls and mark each cell 1 (given) or 0 (filled); only columns that had nulls get a mark."""
    gaps = list(columns_with_nulls(df, cols))
    marked = df.withColumns({f"{c}_imputation_confidence": F.col(c).isNotNull().cast("double") for c in gaps})
    return apply_fill(marked, fill_values(df, gaps, numeric, text)) if gaps else marked


def clean_table(df: DataFrame, cols) -> DataFrame:
    """Impute, trim and lower-case text, drop repeated rows."""
    filled = impute(df, cols)
    tidy = filled.withColumns({c: F.lower(X.strip(c)) for c in text_cols(df, cols)})
    return tidy.distinct()


def clean_standardize(df: DataFrame, cols, order_by) -> DataFrame:
    """Impute, add ``col_cleaned`` (title case; e-mail lower; phone digits), keep the first row of each repeat."""
    filled = impute(df, cols)
    made = {}
    for c in text_cols(df, cols):
        name = c.lower()
        if "email" in name:
            made[f"{c}_cleaned"] = X.lower_email(c)
        elif "phone" in name:
            made[f"{c}_cleaned"] = X.digits_only(c)
        else:
            made[f"{c}_cleaned"] = X.title_case(X.strip(c))
    return dedupe_first(filled.withColumns(made), cols, order_by)


def text_quality(col: str):
    """1.0 halved for short values, times 0.3 for suspicious marks, times 0.7 for long values; 0 for null."""
    v = X.strip(col)
    short = F.when(F.length(v) < 2, 0.5).otherwise(1.0)
    # fixed values: marks of doubtful content
    marks = F.when(v.rlike(r"\?|#|NULL|null|N/A|n/a"), 0.3).otherwise(1.0)
    long = F.when(F.length(v) > 200, 0.7).otherwise(1.0)
    return F.when(F.col(col).isNull(), F.lit(0.0)).otherwise(short * marks * long)


def validate_text(df: DataFrame, cols) -> DataFrame:
    made = {}
    for c in text_cols(df, cols):
        made[f"{c}_data_quality"] = text_quality(c)
        made[f"{c}_standardized"] = X.title_case(X.strip(c))
    return df.withColumns(made)


def flag_anomalies(df: DataFrame, cols) -> DataFrame:
    """0/1 flag and distance outside the quartile bounds."""
    numbers = numeric_cols(df, cols)
    made = {}
    for c, b in iqr_table(df, numbers).items():
        if b["lower"] is None:
            continue
        low, high = F.lit(b["lower"]), F.lit(b["upper"])
        made[f"{c}_is_anomaly"] = F.coalesce(is_outside(c, b), F.lit(False)).cast("int")
        made[f"{c}_anomaly_score"] = F.when(F.col(c) < low, low - F.col(c)).when(F.col(c) > high, F.col(c) - high).otherwise(F.lit(0.0))
    return df.withColumns(made)


def change_log(before: DataFrame, after: DataFrame, cols) -> DataFrame:
    """One row per kind of change: filled nulls, standardised texts, removed rows."""
    cols = as_list(cols)
    gaps = columns_with_nulls(before, cols)
    rows = [(c, "filled missing values", n) for c, n in gaps.items()]
    rows += [(c, "standardized text", before.count()) for c in text_cols(before, cols)]
    removed = before.count() - after.count()
    if removed:
        rows.append((None, "removed duplicate rows", removed))
    return before.sparkSession.createDataFrame(rows, "column_name string, action string, affected bigint")
