"""Column-type helpers shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def _of_kind(df: DataFrame, kind: str, cols=None) -> list[str]:
    wanted = None if cols is None else set(cols)
    return [
        f.name
        for f in df.schema.fields
        if kind_of(f.dataType) == kind and (wanted is None or f.name in wanted)
    ]


def numeric_cols(df: DataFrame, cols=None) -> list[str]:
    return _of_kind(df, "numeric", cols)


def text_cols(df: DataFrame, cols=None) -> list[str]:
    return _of_kind(df, "text", cols)


def datetime_cols(df: DataFrame, cols=None) -> list[str]:
    return _of_kind(df, "datetime", cols)


def as_list(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def total(columns) -> Column:
    """Sum of a Python list of columns."""
    return reduce(lambda a, b: a + b, columns)


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Null-safe equi join on equally named keys; the keys appear once in the result."""
    keys = as_list(keys)
    renamed = right
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_jk{i}")
    cond = [left[k].eqNullSafe(renamed[f"_jk{i}"]) for i, k in enumerate(keys)]
    return left.join(renamed, cond, how).drop(*[f"_jk{i}" for i in range(len(keys))])


def long_rows(wide: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn one wide aggregate row into one row per struct."""
    return wide.select(F.inline(F.array(*structs)))
