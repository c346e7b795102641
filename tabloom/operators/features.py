"""Encodings and constructed features.  Everything is a column expression or a key join."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.columns import as_list, datetime_cols, join_on, numeric_cols, text_cols
from tabloom.functions import scalars as X
from tabloom.operators.ordered import row_index, statistical_features, zscore
from tabloom.operators.profile import sample_skewness


def label_encode(df: DataFrame, col: str, fill: str = "missing", name: str | None = None) -> DataFrame:
    """Position of the value among the sorted distinct values; null counts as ``fill``."""
    filled = F.coalesce(F.col(col).cast("string"), F.lit(fill))
    codes = row_index(df.select(filled.alias("_label")).distinct(), "_label", name="_code")
    return join_on(df.withColumn("_label", filled), codes, "_label", "left").withColumnRenamed("_code", name or f"{col}_label_encoded").drop("_label")


def small_categories(df: DataFrame, col: str, max_card: int) -> list | None:
    """Sorted distinct values when there are at most ``max_card``, else None."""
    found = df.where(F.col(col).isNotNull()).select(col).distinct().limit(max_card + 1).collect()
    return sorted(r[0] for r in found) if len(found) <= max_card else None


def one_hot(df: DataFrame, col: str, max_card: int = 10, dummy_na: bool = True, drop_first: bool = False, prefix: str | None = None) -> DataFrame:
    """One boolean column per value; unchanged when there are more than ``max_card`` values."""
    values = small_categories(df, col, max_card)
    if values is None:
        return df
    prefix = prefix or f"{col}_onehot"
    made = {f"{prefix}_{v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False)) for v in values[1 if drop_first else 0 :]}
    if dummy_na:
        made[f"{prefix}_nan"] = F.col(col).isNull()
    return df.withColumns(made)


def frequency_encode(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    name = name or f"{col}_frequency"
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return join_on(df, counts, col, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def categorical_features(df: DataFrame, cols=None, max_card: int = 10) -> DataFrame:
    """One-hot (few values), label, frequency and length columns of each text column."""
    out = df
    for c in text_cols(df, cols):
        out = one_hot(out, c, max_card)
        out = frequency_encode(label_encode(out, c), c)
        out = out.withColumn(f"{c}_length", F.coalesce(F.length(c), F.lit(0)))
    return out


def temporal_features(df: DataFrame, cols=None) -> DataFrame:
    """Calendar parts of each timestamp; Monday is 0."""
    made = {}
    for c in datetime_cols(df, cols):
        d = F.col(c)
        day = F.weekday(d)
        made.update(
            {
                f"{c}_year": F.year(d),
                f"{c}_month": F.month(d),
                f"{c}_day": F.dayofmonth(d),
                f"{c}_dayofweek": day,
                f"{c}_hour": F.hour(d),
                f"{c}_quarter": F.quarter(d),
                f"{c}_is_weekend": (day >= 5).cast("int"),
                f"{c}_is_month_start": (F.dayofmonth(d) == 1).cast("int"),
                f"{c}_is_month_end": (F.to_date(d) == F.last_day(d)).cast("int"),
            }
        )
    return df.withColumns(made)


def interaction_features(df: DataFrame, cols=None, limit: int = 5, kinds=("x", "plus", "div", "minus")) -> DataFrame:
    """Product, sum, ratio and difference of each pair among the first ``limit`` numeric columns."""
    made = {}
    for a, b in combinations(numeric_cols(df, cols)[:limit], 2):
        x, y = F.col(a), F.col(b)
        ops = {"x": x * y, "plus": x + y, "div": X.safe_ratio(a, b), "minus": x - y}
        made.update({f"{a}_{k}_{b}": ops[k] for k in kinds})
    return df.withColumns(made)


def polynomial_features(df: DataFrame, cols=None, limit: int = 3) -> DataFrame:
    made = {}
    for c in numeric_cols(df, cols)[:limit]:
        made[f"{c}_squared"] = F.col(c) * F.col(c)
        made[f"{c}_sqrt"] = F.sqrt(F.abs(F.col(c)))
    return df.withColumns(made)


def row_stats(df: DataFrame, cols=None) -> DataFrame:
    """Row-wise sum, mean and sample deviation over the non-null numeric columns."""
    present = F.filter(F.array(*[F.col(c).cast("double") for c in numeric_cols(df, cols)]), lambda v: v.isNotNull())
    out = df.withColumn("_v", present)
    n = F.size("_v")
    out = out.withColumn("numeric_sum", F.aggregate("_v", F.lit(0.0), lambda a, v: a + v))
    out = out.withColumn("numeric_mean", F.try_divide("numeric_sum", n))
    squares = F.aggregate("_v", F.lit(0.0), lambda a, v: a + (v - F.col("numeric_mean")) * (v - F.col("numeric_mean")))
    return out.withColumn("numeric_std", F.when(n > 1, F.sqrt(squares / F.nullif(n - 1, F.lit(0))))).drop("_v")


def auto_features(df: DataFrame, cols=None) -> DataFrame:
    """Products and ratios, squares and roots of the first three numeric columns, and row statistics of all."""
    numbers = numeric_cols(df, cols)
    out = interaction_features(df, numbers, 3, ("x", "div"))
    out = polynomial_features(out, numbers, 3)
    return row_stats(out, numbers)


def transform_columns(df: DataFrame, cols) -> DataFrame:
    """log1p for skewed columns, standardised numbers, label codes for texts."""
    numbers = numeric_cols(df, cols)
    out = df
    if numbers:
        row = df.agg(*[sample_skewness(c).alias(f"g{i}") for i, c in enumerate(numbers)]).first()
        skewed = [c for i, c in enumerate(numbers) if row[f"g{i}"] is not None and row[f"g{i}"] > 1]
        out = zscore(out, numbers).withColumnsRenamed({f"{c}_zscore": f"{c}_standardized" for c in numbers})
        out = out.withColumns({f"{c}_log": F.log1p(c) for c in skewed})
    for c in text_cols(df, cols):
        out = label_encode(out, c, name=f"{c}_encoded")
    return out


def group_ratio(df: DataFrame, by: str, col: str, name: str | None = None) -> DataFrame:
    """Value over its group's mean.  Means are aggregated first and joined back, so hot groups stay split."""
    means = df.groupBy(by).agg(F.avg(col).alias("_mean"))
    return join_on(df, means, by, "left").withColumn(name or f"{col}_to_{by}_mean", X.safe_ratio(col, "_mean")).drop("_mean")


def group_stat_features(df: DataFrame, by=None, cols=None, limit: int = 3) -> DataFrame:
    """Mean, deviation and count of numbers per category attached to every row, 0 where missing."""
    groups, numbers = text_cols(df, by)[:limit], numeric_cols(df, cols)[:limit]
    out = df
    for g in groups:
        aggs = []
        for c in numbers:
            aggs += [F.avg(c).alias(f"{g}_{c}_mean"), F.stddev_samp(c).alias(f"{g}_{c}_std"), F.count(c).alias(f"{g}_{c}_count")]
        stats = df.where(F.col(g).isNotNull()).groupBy(g).agg(*aggs)
        out = join_on(out, stats, g, "left").na.fill(0, [n for c in numbers for n in (f"{g}_{c}_mean", f"{g}_{c}_std", f"{g}_{c}_count")])
    return out


def spec_features(df: DataFrame, specs) -> DataFrame:
    """Features from (name, column, column): a ratio of two numbers, or a number over its group's mean."""
    numbers, out = set(numeric_cols(df)), df
    for name, a, b in specs:
        if a in numbers and b in numbers:
            out = out.withColumn(name, X.safe_ratio(a, b))
        elif a in numbers:
            out = group_ratio(out, b, a, name)
    return out


def text_features(df: DataFrame, cols=None) -> DataFrame:
    """Word, character, sentence and symbol counts; a null text counts 0 everywhere."""
    out = df
    for c in text_cols(df, cols):
        t = F.coalesce(F.col(c), F.lit(""))
        out = out.withColumn("_w", X.words(t))
        n = F.size("_w")
        letters = F.aggregate("_w", F.lit(0), lambda a, w: a + F.length(w))
        out = out.withColumns(
            {
                f"{c}_word_count": n,
                f"{c}_char_count": F.length(t),
                f"{c}_unique_words": F.size(F.array_distinct("_w")),
                f"{c}_avg_word_length": F.when(n > 0, letters / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0)),
                f"{c}_exclamation_count": F.regexp_count(t, F.lit("!")),
                f"{c}_question_count": F.regexp_count(t, F.lit(r"\?")),
                f"{c}_uppercase_count": F.regexp_count(t, F.lit("[A-Z]")),
                f"{c}_digit_count": F.regexp_count(t, F.lit("[0-9]")),
                f"{c}_sentence_count": F.regexp_count(t, F.lit("[.!?]+")),
            }
        ).drop("_w")
    return out


def scale_standard(df: DataFrame, cols) -> DataFrame:
    """(x - mean) / population deviation; 0 when the deviation is 0."""
    cols = as_list(cols)
    row = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(cols) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    made = {}
    for i, c in enumerate(cols):
        mean, dev = row[f"m{i}"], row[f"s{i}"]
        made[f"{c}_scaled"] = (F.col(c) - F.lit(mean)) / F.lit(dev if dev else 1.0)
    return df.withColumns(made)


def build_features(df: DataFrame, cols, kinds, order_by=None) -> DataFrame:
    """Run the chosen feature families over the given columns, in a fixed order."""
    families = {
        "statistical": lambda d: statistical_features(d, numeric_cols(df, cols), order_by),
        "temporal": lambda d: temporal_features(d, datetime_cols(df, cols)),
        "categorical": lambda d: categorical_features(d, text_cols(df, cols)),
        "interaction": lambda d: interaction_features(d, numeric_cols(df, cols)),
        "text": lambda d: text_features(d, text_cols(df, cols)),
        "aggregation": lambda d: group_stat_features(d, text_cols(df, cols), numeric_cols(df, cols)),
    }
    out = df
    for name, build in families.items():
        if name in kinds:
            out = build(out)
    return out


def feature_list(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names and types of the columns that were added."""
    known = set(before.columns)
    rows = [(f.name, f.dataType.simpleString()) for f in after.schema.fields if f.name not in known]
    return after.sparkSession.createDataFrame(rows, "feature_name string, data_type string")
