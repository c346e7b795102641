"""Projection, filtering, parsing, sorting, sampling and row shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.columns import as_list

# fixed values: accepted timestamp formats, tried in this order after the free parse
DATETIME_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss")


def select_cols(df: DataFrame, cols) -> DataFrame:
    return df.select(*as_list(cols))


def drop_cols(df: DataFrame, cols) -> DataFrame:
    return df.drop(*as_list(cols))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def drop_any_null(df: DataFrame, cols=None) -> DataFrame:
    return df.na.drop(subset=as_list(cols) if cols is not None else None)


def outside_range(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(col) < low) | (F.col(col) > high))


def numeric_or_null(col: str) -> Column:
    return F.col(col).try_cast("double")


def to_numeric(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Values that are not numbers become null."""
    return df.withColumn(name or col, numeric_or_null(col))


def datetime_or_null(col: str, formats=DATETIME_FORMATS) -> Column:
    free = F.col(col).try_cast("timestamp_ntz")
    fixed = [F.try_to_timestamp(F.col(col), F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(free, *fixed)


def to_datetime(df: DataFrame, col: str, formats=DATETIME_FORMATS, name: str | None = None) -> DataFrame:
    """Free parse first, then the fixed formats in order; bad values become null."""
    return df.withColumn(name or col, datetime_or_null(col, formats))


def looks_datetime(df: DataFrame, col: str, order_by, n: int = 50, formats=DATETIME_FORMATS) -> DataFrame:
    """Do the first ``n`` non-null texts all parse as timestamps?  One row."""
    head = df.where(F.col(col).isNotNull()).orderBy(*as_list(order_by)).limit(n)
    parsed = datetime_or_null(col, formats).isNotNull()
    return head.agg(F.lit(col).alias("column_name"), F.coalesce(F.min(parsed), F.lit(False)).alias("is_datetime"))


def with_metadata(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def null_quality_flag(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({f"{c}_quality_score": F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.lit(100)) for c in as_list(cols)})


def column_quality_cols(df: DataFrame, cols) -> DataFrame:
    """Attach 100 - missing % of each column as a constant column."""
    cols = as_list(cols)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    share = {c: 100.0 * row[f"c{i}"] / row["n"] if row["n"] else None for i, c in enumerate(cols)}
    return df.withColumns({f"{c}_quality_score": F.lit(v).cast("double") for c, v in share.items()})


def sort_by(df: DataFrame, cols, descending=False) -> DataFrame:
    return df.orderBy(*as_list(cols), ascending=not descending)


def top_k(df: DataFrame, score: str, k: int = 10, ties=()) -> DataFrame:
    """The k best rows; ties go to the smallest ``ties`` columns."""
    return df.orderBy(F.col(score).desc(), *as_list(ties)).limit(k)


def top_k_per_group(df: DataFrame, by, score: str, k: int = 3, ties=(), name: str = "rank") -> DataFrame:
    """Best k rows of each group.

    Catalyst puts a partial group limit before the shuffle, so a hot group arrives already thinned.
    """
    ranked = Window.partitionBy(*as_list(by)).orderBy(F.col(score).desc(), *as_list(ties))
    return df.withColumn(name, F.row_number().over(ranked)).where(F.col(name) <= k)


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def category_union(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).union(b.select(col)).where(F.col(col).isNotNull()).distinct()


def preview(df: DataFrame, n: int, order_by, last: bool = False) -> DataFrame:
    keys = [F.col(c).desc() if last else F.col(c).asc() for c in as_list(order_by)]
    return df.orderBy(*keys).limit(n)


def sample_rows(df: DataFrame, keys, n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample: the n rows whose keyed hash sorts first."""
    keys = as_list(keys)
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.orderBy(digest, *keys).limit(n)


def records_from_json(df: DataFrame, json_col: str, schema: str, required=()) -> DataFrame:
    """Each text holds one JSON object or a list of objects; one row per object, features must exist."""
    text = F.trim(F.col(json_col))
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    keep = [c for c in df.columns if c != json_col]
    rows = df.select(*keep, F.inline(F.from_json(listed, f"array<struct<{schema}>>")))
    missing = [c for c in as_list(required) if c not in rows.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return rows


def rows_to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text per row: ISO dates, NaN as null."""
    safe = [
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias(name))
