"""Key joins.  No hints: Spark broadcasts a side only when its measured size allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.columns import as_list, join_on


def lookup_join(df: DataFrame, dim: DataFrame, on, default: dict | None = None) -> DataFrame:
    """Left join to a lookup table; unmatched values take ``default``."""
    out = join_on(df, dim, on, "left")
    for c, v in (default or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def attach_by_key(df: DataFrame, features: DataFrame, keys) -> DataFrame:
    """Put feature columns beside the rows with the same key."""
    return join_on(df, features, keys, "left")


def update_by_key(df: DataFrame, updates: DataFrame, keys, cols) -> DataFrame:
    """Rows present in ``updates`` take its values, the others keep theirs."""
    keys, cols = as_list(keys), as_list(cols)
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = join_on(df, new, keys, "left")
    for c in cols:
        old = F.col(c) if c in df.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), old))
    return out.drop(*[f"_new_{c}" for c in cols])


def anti_split(df: DataFrame, reference: DataFrame, keys) -> DataFrame:
    return df.join(reference.select(*as_list(keys)), as_list(keys), "left_anti")


def flag_members(df: DataFrame, ids: DataFrame, key: str, name: str = "is_member") -> DataFrame:
    marks = ids.select(key).distinct().withColumn(name, F.lit(True))
    return join_on(df, marks, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))


def align_counts(a: DataFrame, b: DataFrame, col: str, names=("reference_count", "current_count")) -> DataFrame:
    """Value counts of both tables side by side, 0 where a value is absent."""
    left, right = value_counts(a, col, names[0]), value_counts(b, col, names[1])
    return left.join(right, col, "full").select(col, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


def dimension_enrich(df: DataFrame, dim: DataFrame, key: str, dim_key: str, attrs: dict) -> DataFrame:
    """Left join to a dimension; ``attrs`` maps dimension column -> new column."""
    right = dim.select(F.col(dim_key).alias(key), *[F.col(c).alias(n) for c, n in attrs.items()])
    return join_on(df, right, key, "left")
