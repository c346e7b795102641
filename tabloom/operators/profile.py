"""Column and table profiles.  One wide aggregate pass, then one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.columns import as_list, kind_of, long_rows, numeric_cols, text_cols, total
from tabloom.operators.moments import correlations
from tabloom.operators.quantiles import exact_quantiles

_CHUNK = 60
_cell_hash = F.xxhash64


def pct(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * F.try_divide(part.cast("double"), whole.cast("double"))


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def _fields(df: DataFrame, cols=None):
    fields = {f.name: f for f in df.schema.fields}
    return [fields[c] for c in (df.columns if cols is None else as_list(cols))]


def _chunks(items):
    return [items[i : i + _CHUNK] for i in range(0, len(items), _CHUNK)] or [[]]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def distinct_counts(df: DataFrame, cols) -> dict[str, int]:
    """Exact number of distinct non-null values of each column, all in one pass.

    Values are counted as (column number, hash), which is combined in the tasks.  A second hash tells
    whether different values share a first one; such columns are counted again by their values.
    """
    cols, found = as_list(cols), {}
    for chunk in _chunks(cols):
        if not chunk:
            continue
        named = [F.col(f"`{c}`") for c in chunk]
        cells = [F.struct(F.lit(i).alias("no"), F.when(c.isNotNull(), _cell_hash(c)).alias("h"), F.xxhash64(F.lit(1), c).alias("g")) for i, c in enumerate(named)]
        values = df.select(F.inline(F.array(*cells))).where(F.col("h").isNotNull())
        once = values.groupBy("no", "h").agg(F.min("g").alias("low"), F.max("g").alias("high"))
        counts = once.groupBy("no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("low") != F.col("high")).alias("shared")).collect()
        found |= dict.fromkeys(chunk, 0)
        for r in counts:
            again = r["shared"] > 0
            found[chunk[r["no"]]] = df.select(named[r["no"]].alias("v")).where(F.col("v").isNotNull()).distinct().count() if again else r["n"]
    return found


def column_facts(df: DataFrame, cols=None, distinct: bool = True, approx: bool = False) -> DataFrame:
    """One row per column with every cheap fact the reports below need.

    Wide tables are cut into chunks of columns so that the generated aggregate stays compilable.
    """
    parts = []
    known = distinct_counts(df, [f.name for f in _fields(df, cols)]) if distinct and not approx else {}
    for chunk in _chunks(_fields(df, cols)):
        aggs, rows = [F.count(F.lit(1)).alias("n")], []
        for i, f in enumerate(chunk):
            c, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
            aggs.append(F.count(c).alias(f"c{i}"))
            if distinct and approx:
                aggs.append(F.approx_count_distinct(c).alias(f"u{i}"))
            if kind == "numeric":
                aggs += [F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")]
            if kind == "text":
                aggs += [F.avg(F.length(c)).alias(f"len{i}"), F.sum((c == F.lower(c)).cast("bigint")).alias(f"low{i}")]
                aggs += [F.max(c.contains("@")).alias(f"at{i}"), F.max(c.rlike("[0-9]")).alias(f"dig{i}")]

            def pick(prefix, wanted, dtype, i=i, kind=kind):
                return (F.col(f"{prefix}{i}") if kind == wanted else F.lit(None)).cast(dtype)

            rows.append(
                F.struct(
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    F.lit(kind).alias("kind"),
                    F.col("n").alias("row_count"),
                    (F.col("n") - F.col(f"c{i}")).alias("missing_count"),
                    F.coalesce(pct(F.col("n") - F.col(f"c{i}"), F.col("n")), F.lit(0.0)).alias("missing_pct"),
                    (F.col(f"u{i}") if distinct and approx else F.lit(known.get(f.name)).cast("bigint")).alias("unique_count"),
                    pick("lo", "numeric", "double").alias("min_value"),
                    pick("hi", "numeric", "double").alias("max_value"),
                    pick("m", "numeric", "double").alias("mean_value"),
                    pick("s", "numeric", "double").alias("std_value"),
                    pick("len", "text", "double").alias("avg_length"),
                    pick("low", "text", "bigint").alias("lower_count"),
                    pick("at", "text", "boolean").alias("has_at"),
                    pick("dig", "text", "boolean").alias("has_digit"),
                )
            )
        parts.append(long_rows(df.agg(*aggs), rows))
    return _union(parts)


def duplicate_rows(df: DataFrame, subset=None) -> DataFrame:
    """Rows that repeat an earlier row (nulls count as equal).  One row: rows, duplicate_rows."""
    keys = as_list(subset) if subset is not None else df.columns
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def table_totals(df: DataFrame, cols=None) -> dict:
    """Rows, missing cells, duplicates and text length of a table as plain numbers."""
    cols = df.columns if cols is None else as_list(cols)
    texts = text_cols(df, cols)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)],
        *[F.avg(F.coalesce(F.length(c), F.lit(0))).alias(f"t{i}") for i, c in enumerate(texts)],
    ).first()
    present = [row[f"c{i}"] for i in range(len(cols))]
    lengths = [row[f"t{i}"] or 0.0 for i in range(len(texts))]
    return {
        "rows": row["n"],
        "columns": len(cols),
        "missing": row["n"] * len(cols) - sum(present),
        "columns_with_missing": sum(1 for p in present if p < row["n"]),
        "duplicates": duplicate_rows(df).first()["duplicate_rows"],
        "text_length": sum(lengths) / len(lengths) if lengths else None,
    }


def table_info(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, column kinds and duplicate rows.  One row."""
    cells = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    known = total([F.col(f"c{i}") for i in range(len(df.columns))])
    facts = cells.select(
        F.col("n").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        (F.col("n") * len(df.columns) - known).alias("missing_cells"),
        F.lit(len(numeric_cols(df))).alias("numeric_columns"),
        F.lit(len(text_cols(df))).alias("text_columns"),
    )
    return facts.withColumn("duplicate_rows", F.lit(duplicate_rows(df).first()["duplicate_rows"]).cast("bigint"))


def missing_report(df: DataFrame, cols=None) -> DataFrame:
    return column_facts(df, cols, distinct=False).select("column_name", "data_type", "missing_count", "missing_pct")


def missing_patterns(df: DataFrame, cols) -> DataFrame:
    """How often each combination of null / present columns occurs."""
    marks = [F.col(c).isNull().alias(f"{c}_missing") for c in as_list(cols)]
    return df.groupBy(*marks).agg(F.count(F.lit(1)).alias("row_count"))


def unique_report(df: DataFrame, cols=None, approx: bool = False) -> DataFrame:
    return column_facts(df, cols, approx=approx).select("column_name", "unique_count")


def numeric_profile(df: DataFrame, cols=None) -> DataFrame:
    """count, min, max, mean, median and sample deviation per numeric column."""
    cols = numeric_cols(df, cols)
    medians = {c: q[0] for c, q in exact_quantiles(df, cols, [0.5]).items()}
    aggs, rows = [], []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")]
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"n{i}").alias("value_count"),
                F.col(f"lo{i}").alias("min_value"),
                F.col(f"hi{i}").alias("max_value"),
                F.col(f"m{i}").alias("mean_value"),
                F.lit(medians[c]).cast("double").alias("median_value"),
                F.col(f"s{i}").alias("std_value"),
            )
        )
    return long_rows(df.agg(*aggs), rows)


def top_values(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """The k most frequent non-null values; ties go to the smaller value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("value_count"))
    return counts.orderBy(F.desc("value_count"), "value").limit(k)


def count_map(df: DataFrame, col: str) -> DataFrame:
    """Value -> count as (value, count) rows; a map column would put every value into one row."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("value_count"))


def datetime_profile(df: DataFrame, col: str) -> DataFrame:
    return df.agg(
        F.lit(col).alias("column_name"),
        F.min(col).alias("min_value"),
        F.max(col).alias("max_value"),
        F.datediff(F.max(col), F.min(col)).alias("range_days"),
    )


def mode_of(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value, ties to the smallest.  Counts first, so no task holds all values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("mode_value")).agg(F.count(F.lit(1)).alias("value_count"))
    return counts.orderBy(F.desc("value_count"), "mode_value").limit(1)


def modes(df: DataFrame, cols) -> dict:
    """Mode of several columns as plain values."""
    out = {}
    for c in as_list(cols):
        row = mode_of(df, c).first()
        out[c] = row["mode_value"] if row else None
    return out


def iqr_table(df: DataFrame, cols, k: float = 1.5) -> dict[str, dict]:
    """{column: q1, q3, iqr, lower, upper} as plain numbers."""
    out = {}
    for c, (q1, q3) in exact_quantiles(df, cols, [0.25, 0.75]).items():
        if q1 is None:
            out[c] = dict.fromkeys(("q1", "q3", "iqr", "lower", "upper"))
        else:
            iqr = q3 - q1
            out[c] = {"q1": q1, "q3": q3, "iqr": iqr, "lower": q1 - k * iqr, "upper": q3 + k * iqr}
    return out


def iqr_bounds(df: DataFrame, cols=None, k: float = 1.5) -> DataFrame:
    bounds = iqr_table(df, numeric_cols(df, cols), k)
    rows = [(c, b["q1"], b["q3"], b["iqr"], b["lower"], b["upper"]) for c, b in bounds.items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, q1 double, q3 double, iqr double, lower_bound double, upper_bound double")


def is_outside(col: str, bounds: dict) -> Column:
    if bounds["lower"] is None:
        return F.lit(False)
    return (F.col(col) < F.lit(bounds["lower"])) | (F.col(col) > F.lit(bounds["upper"]))


def outlier_counts(df: DataFrame, cols, bounds: dict) -> dict:
    """{column: rows outside its bounds}."""
    if not cols:
        return {}
    row = df.agg(*[F.count_if(is_outside(c, bounds[c])).alias(f"o{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"o{i}"] for i, c in enumerate(cols)}


def outlier_report(df: DataFrame, cols=None, k: float = 1.5) -> DataFrame:
    cols = numeric_cols(df, cols)
    bounds = iqr_table(df, cols, k)
    aggs = [F.count(F.lit(1)).alias("n"), *[F.count_if(is_outside(c, bounds[c])).alias(f"o{i}") for i, c in enumerate(cols)]]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"o{i}").alias("outlier_count"),
            pct(F.col(f"o{i}"), F.col("n")).alias("outlier_pct"),
            F.lit(bounds[c]["lower"]).cast("double").alias("lower_bound"),
            F.lit(bounds[c]["upper"]).cast("double").alias("upper_bound"),
        )
        for i, c in enumerate(cols)
    ]
    return long_rows(df.agg(*aggs), rows)


def sample_skewness(c) -> Column:
    """Bias-corrected skewness from Spark's population skewness."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(c) -> Column:
    """Bias-corrected excess kurtosis from Spark's population value."""
    n = F.count(c).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n > 3, scale * ((n + 1) * F.kurtosis(c) + 6))


def distribution_report(df: DataFrame, cols=None) -> DataFrame:
    cols = numeric_cols(df, cols)
    medians = {c: q[0] for c, q in exact_quantiles(df, cols, [0.5]).items()}
    aggs, rows = [], []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"), sample_skewness(c).alias(f"g{i}"), sample_kurtosis(c).alias(f"k{i}")]
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"m{i}").alias("mean_value"),
                F.lit(medians[c]).cast("double").alias("median_value"),
                F.col(f"s{i}").alias("std_value"),
                F.col(f"g{i}").alias("skewness"),
                F.col(f"k{i}").alias("kurtosis"),
            )
        )
    return long_rows(df.agg(*aggs), rows)


def bin_of(col: str, low: float, high: float, bins: int) -> Column:
    """0-based equal-width bin; the maximum falls into the last bin."""
    if low is None or high <= low:
        return F.when(F.col(col).isNotNull(), F.lit(0)).cast("bigint")
    raw = F.floor((F.col(col) - F.lit(low)) * F.lit(bins) / F.lit(high - low))
    return F.least(raw, F.lit(bins - 1)).cast("bigint")


def _range(df: DataFrame, col: str):
    row = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    return row["lo"], row["hi"]


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Non-empty equal-width bins over min..max with their edges and counts."""
    low, high = _range(df, col)
    width = 0.0 if low is None else (high - low) / bins
    counts = df.where(F.col(col).isNotNull()).groupBy(bin_of(col, low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("value_count"))
    left = F.lit(low).cast("double") + F.col("bin") * F.lit(width)
    return counts.select("bin", left.alias("bin_start"), (left + F.lit(width)).alias("bin_end"), "value_count")


def five_number(df: DataFrame, cols, by: str | None = None) -> DataFrame:
    """Minimum, quartiles and maximum per column, optionally per group."""
    from tabloom.operators.quantiles import quantiles_by

    cols, probs = as_list(cols), [0.0, 0.25, 0.5, 0.75, 1.0]
    names = ["min_value", "q1", "median_value", "q3", "max_value"]
    if by is None:
        rows = [(c, *q) for c, q in exact_quantiles(df, cols, probs).items()]
        return df.sparkSession.createDataFrame(rows, "column_name string, " + ", ".join(f"{n} double" for n in names))
    return _union([quantiles_by(df, by, c, probs, names).select(F.lit(c).alias("column_name"), by, *names) for c in cols])


def correlation_matrix(df: DataFrame, cols=None) -> DataFrame:
    """Pearson correlation of every pair (both orders and the diagonal), pairwise complete."""
    cols = numeric_cols(df, cols)
    return _named_pairs(df, cols)


def _named_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in cols]) if cols else F.array().cast("array<string>")
    return correlations(df, cols).select(F.get(names, F.col("i")).alias("column_1"), F.get(names, F.col("j")).alias("column_2"), "correlation")


def strong_pairs(df: DataFrame, cols=None, threshold: float = 0.7) -> DataFrame:
    cols = numeric_cols(df, cols)
    place = F.array(*[F.lit(c) for c in cols]) if cols else F.array().cast("array<string>")
    ordered = F.array_position(place, F.col("column_1")) < F.array_position(place, F.col("column_2"))
    return _named_pairs(df, cols).where(ordered & (F.abs("correlation") > threshold))


def variance_rank(df: DataFrame, cols=None) -> DataFrame:
    """Variance of each numeric column, and divided by its maximum (0 if the maximum is 0)."""
    cols = numeric_cols(df, cols)
    wide = df.agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(cols)], *[F.max(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"v{i}").alias("variance_score"),
            F.coalesce(F.try_divide(F.col(f"v{i}"), F.col(f"x{i}")), F.lit(0.0)).alias("normalized_score"),
        )
        for i, c in enumerate(cols)
    ]
    return long_rows(wide, rows).orderBy(F.desc("variance_score"))


def _one_row(df: DataFrame, **values) -> DataFrame:
    """A one-row report of plain numbers and texts."""
    types = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    schema = ", ".join(f"{k} {types.get(type(v), 'double')}" for k, v in values.items())
    return df.sparkSession.createDataFrame([tuple(values.values())], schema)


def quality_from_totals(t: dict) -> float | None:
    if not t["rows"]:
        return None
    score = 100 - 50 * t["missing"] / (t["rows"] * t["columns"]) - 30 * t["duplicates"] / t["rows"]
    return max(0.0, min(100.0, score))


def quality_score(df: DataFrame) -> DataFrame:
    t = table_totals(df)
    return _one_row(
        df,
        quality_score=quality_from_totals(t),
        missing_values=t["missing"],
        duplicate_rows=t["duplicates"],
        completeness_pct=100.0 * (1 - t["missing"] / (t["rows"] * t["columns"])),
        consistency_pct=100.0 * (1 - t["duplicates"] / t["rows"]),
    )


def matching_quality(df: DataFrame) -> DataFrame:
    """Weights 0.4 completeness, 0.3 uniqueness of rows, 0.3 text length (20 characters = full)."""
    t = table_totals(df)
    text = min(1.0, t["text_length"] / 20) if t["text_length"] is not None else 0.0
    score = 0.4 * (1 - t["missing"] / (t["rows"] * t["columns"])) + 0.3 * (1 - t["duplicates"] / t["rows"]) + 0.3 * text
    return _one_row(df, matching_quality=100.0 * max(0.0, min(1.0, score)))


def completeness_consistency(df: DataFrame, subset=None) -> DataFrame:
    """Completeness of the subset's cells, share of non-repeated rows, their mean and its level."""
    part = df.select(*as_list(subset)) if subset is not None else df
    t = table_totals(part)
    completeness = 100.0 * (1 - t["missing"] / (t["rows"] * t["columns"]))
    consistency = max(0.0, 100.0 - 100.0 * t["duplicates"] / t["rows"])
    overall = (completeness + consistency) / 2
    level = "Excellent" if overall >= 90 else "Good" if overall >= 70 else "Fair"
    return _one_row(
        df,
        overall_score=overall,
        completeness_score=completeness,
        consistency_score=consistency,
        missing_values=t["missing"],
        columns_with_missing=t["columns_with_missing"],
        duplicate_rows=t["duplicates"],
        quality_level=level,
    )


def column_quality(df: DataFrame, cols=None) -> DataFrame:
    """Completeness, consistency, validity, uniqueness and score per column, with issues and flags."""
    cols = df.columns if cols is None else as_list(cols)
    numbers = numeric_cols(df, cols)
    bounds = iqr_table(df, numbers)
    outside = outlier_counts(df, numbers, bounds)
    facts = column_facts(df, cols)
    outlier_map = F.create_map(*[x for c, v in outside.items() for x in (F.lit(c), F.lit(v))]) if outside else None
    n = F.col("row_count")
    outliers = pct(outlier_map[F.col("column_name")], n) if outside else F.lit(None).cast("double")
    is_num, is_text = F.col("kind") == "numeric", F.col("kind") == "text"
    scored = facts.select(
        "column_name",
        F.col("missing_pct"),
        F.greatest(F.lit(0.0), 100 - F.col("missing_pct")).alias("completeness"),
        F.when(is_text, pct(F.col("lower_count"), n - F.col("missing_count"))).otherwise(F.lit(95.0)).alias("consistency"),
        F.when(is_num, F.greatest(F.lit(0.0), 100 - 2 * outliers)).otherwise(F.lit(90.0)).alias("validity"),
        pct(F.col("unique_count"), n).alias("uniqueness"),
        F.when(is_num, outliers).alias("outlier_pct"),
        is_text.alias("is_text"),
    ).withColumn("overall_score", (F.col("completeness") + F.col("consistency") + F.col("validity")) / 3)
    rules = [
        (F.col("missing_pct") > 20, "High missing values", "Data Quality Risk"),
        (F.col("is_text") & (F.col("consistency") < 80), "Inconsistent text formatting", "Standardization Required"),
        (F.col("outlier_pct") > 5, "High outlier rate", "Outlier Management Needed"),
        (F.lower("column_name").contains("id") & (F.col("uniqueness") < 95), "ID column not sufficiently unique", "Identity Integrity Risk"),
    ]

    def joined(position):
        return F.concat_ws(", ", *[F.when(r[0], F.lit(r[position])) for r in rules])

    return scored.select(
        "column_name", "completeness", "consistency", "validity", "uniqueness", "overall_score",
        joined(1).alias("issues"), joined(2).alias("governance_flags"),
    )


def group_stats(df: DataFrame, by, cols) -> DataFrame:
    aggs = []
    for c in as_list(cols):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_count")]
    return df.groupBy(*as_list(by)).agg(*aggs)


def cluster_profile(df: DataFrame, label: str, cols, k: int = 3) -> DataFrame:
    """Per label and column: size, share, mean/std/min/max of numbers, top-k values of texts; noise (-1) is left out."""
    cols = as_list(cols)
    n = df.count()
    kept = df.where(F.col(label) != -1)
    numbers, texts = numeric_cols(df, cols), text_cols(df, cols)
    aggs, rows = [F.count(F.lit(1)).alias("_n")], []
    for i, c in enumerate(numbers):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"), F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}")]
    none = F.lit(None).cast("double")
    for c in cols:
        i = numbers.index(c) if c in numbers else None
        vals = [F.col(f"{p}{i}") if i is not None else none for p in ("m", "s", "lo", "hi")]
        names = ("mean_value", "std_value", "min_value", "max_value")
        rows.append(F.struct(F.lit(c).alias("column_name"), *[v.alias(a) for v, a in zip(vals, names)]))
    wide = kept.groupBy(label).agg(*aggs)
    report = wide.select(
        label, F.col("_n").alias("cluster_size"), pct(F.col("_n"), F.lit(n)).alias("cluster_pct"), F.inline(F.array(*rows))
    )
    if not texts:
        return report.withColumn("top_values", F.lit(None).cast("string"))
    long = kept.select(label, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in texts])))
    counts = long.where(F.col("value").isNotNull()).groupBy(label, "column_name", "value").agg(F.count(F.lit(1)).alias("c"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(label, "column_name").orderBy(F.desc("c"), "value"))).where(F.col("r") <= k)
    tops = ranked.groupBy(label, "column_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "value", "c"))), lambda s: F.concat(s["value"], F.lit("="), s["c"].cast("string"))), ", ").alias("top_values")
    )
    return report.join(tops, [label, "column_name"], "left")


def cv_risk(df: DataFrame, cols=None) -> DataFrame:
    """Sample deviation over mean: above 1 High, above 0.5 Medium."""
    cols = numeric_cols(df, cols)
    wide = df.agg(*[F.coalesce(F.try_divide(F.stddev_samp(c), F.avg(c)), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("cv")) for i, c in enumerate(cols)]
    return long_rows(wide, rows).withColumn("drift_risk", F.when(F.col("cv") > 1, "High").when(F.col("cv") > 0.5, "Medium").otherwise("Low"))


def dataset_anomalies(df: DataFrame) -> DataFrame:
    """Rows for columns over half missing, duplicate rows, over 5 % outliers and constant columns."""
    facts = column_facts(df)
    t_dup = duplicate_rows(df)
    high_missing = facts.where(F.col("missing_pct") > 50).select(
        F.lit("High Missing Values").alias("anomaly_type"), "column_name", F.col("missing_count").alias("affected"), F.lit(95).alias("confidence")
    )
    dups = t_dup.where(F.col("duplicate_rows") > 0).select(
        F.lit("Duplicate Rows Detected").alias("anomaly_type"), F.lit(None).cast("string").alias("column_name"), F.col("duplicate_rows").alias("affected"), F.lit(100).alias("confidence")
    )
    constant = facts.where(F.col("unique_count") == 1).select(
        F.lit("Constant Column").alias("anomaly_type"), "column_name", F.col("row_count").alias("affected"), F.lit(100).alias("confidence")
    )
    out = high_missing.unionByName(dups).unionByName(constant)
    if numeric_cols(df):
        outliers = outlier_report(df).where(F.col("outlier_pct") > 5).select(
            F.lit("Statistical Outliers").alias("anomaly_type"), "column_name", F.col("outlier_count").alias("affected"), F.lit(80).alias("confidence")
        )
        out = out.unionByName(outliers)
    return out


def column_notes(df: DataFrame, cols=None) -> DataFrame:
    """A summary text and one piece of advice per column."""
    u, n, miss = F.col("unique_count"), F.col("row_count"), F.col("missing_pct")
    summary = (
        F.when(F.col("kind") == "numeric", F.format_string("Numeric column with %d unique values. Range: %.2f to %.2f", u, "min_value", "max_value"))
        .when(F.col("kind") == "text", F.format_string("Categorical column with %d unique values", u))
        .otherwise(F.format_string("Column of type %s with %d unique values", "data_type", u))
    )
    advice = (
        F.when(
            F.col("kind") == "numeric",
            F.when(miss < 5, "Good quality numeric data. Consider for statistical analysis.")
            .when(miss < 20, "Some missing values. Consider for imputation strategies.")
            .otherwise("High missing values. Investigate data collection process."),
        )
        .when(
            F.col("kind") == "text",
            F.when(F.try_divide(u, n) > 0.8, "High cardinality. Consider grouping or encoding strategies.")
            .when(u < 10, "Low cardinality. Good for categorical analysis.")
            .otherwise("Medium cardinality. Suitable for most analyses."),
        )
        .otherwise("Review data type and consider appropriate preprocessing.")
    )
    return column_facts(df, cols).select("column_name", "data_type", summary.alias("summary"), advice.alias("recommendation"))


def top_values_all(df: DataFrame, cols, k: int = 3) -> DataFrame:
    """Top-k values of several text columns in one pass, joined to one text per column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in as_list(cols)])))
    counts = long.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c"))
    from tabloom.operators.shape import top_k_per_group

    best = top_k_per_group(counts, "column_name", "c", k, ["value"], "r")
    return best.groupBy("column_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]), ", ").alias("top_values")
    )


def data_dictionary(df: DataFrame, cols=None, k: int = 3) -> DataFrame:
    """Type, missing, unique and range or top values of each column."""
    facts = column_facts(df, cols).select(
        "column_name", "data_type", "missing_count", "missing_pct", "unique_count", "min_value", "max_value", "mean_value"
    )
    texts = text_cols(df, cols)
    if not texts:
        return facts.withColumn("top_values", F.lit(None).cast("string"))
    return facts.join(top_values_all(df, texts, k), "column_name", "left")


def dictionary_markdown(dictionary: DataFrame) -> DataFrame:
    """One Markdown paragraph per column of a data dictionary."""
    lines = [
        F.format_string("### %s", "column_name"),
        F.format_string("- **Type**: %s", "data_type"),
        F.format_string("- **Missing**: %d (%.1f%%)", "missing_count", "missing_pct"),
        F.format_string("- **Unique Values**: %d", "unique_count"),
        F.when(F.col("min_value").isNotNull(), F.format_string("- **Range**: %.2f to %.2f", "min_value", "max_value")),
        F.when(F.col("top_values").isNotNull(), F.concat(F.lit("- **Top Values**: "), F.col("top_values"))),
    ]
    return dictionary.select("column_name", F.concat_ws("\n", *lines).alias("markdown"))


def quality_issues(df: DataFrame, cols=None) -> DataFrame:
    """Columns over 20 % missing, and text columns with more than 80 % distinct values."""
    facts = column_facts(df, cols)
    ratio = F.try_divide(F.col("unique_count"), F.col("row_count"))
    missing = facts.where(F.col("missing_pct") > 20).select("column_name", F.lit("missing values").alias("issue"), F.col("missing_pct").alias("issue_pct"))
    cardinal = facts.where((F.col("kind") == "text") & (ratio > 0.8)).select("column_name", F.lit("high cardinality").alias("issue"), (100 * ratio).alias("issue_pct"))
    return missing.unionByName(cardinal)


def enrichment_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Column counts, added ratio, missing cells before and after, retention and improvement."""

    def sizes(df):
        row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
        return row["n"], row["n"] * len(df.columns) - sum(row[f"c{i}"] for i in range(len(df.columns)))

    (n0, m0), (n1, m1) = sizes(before), sizes(after)
    added = len(after.columns) - len(before.columns)
    return _one_row(
        before,
        original_columns=len(before.columns),
        enriched_columns=len(after.columns),
        new_columns_added=added,
        enrichment_ratio=added / len(before.columns),
        original_missing_values=m0,
        enriched_missing_values=m1,
        data_quality_improvement=100.0 * (m0 - m1) / m0 if m0 else 0.0,
        retention_pct=100.0 * n1 / n0 if n0 else 0.0,
    )


def modeling_overview(df: DataFrame) -> DataFrame:
    """Advice rows: missing > 10 %, duplicates > 5 %, interactions, texts with more than 50 values."""
    t = table_totals(df)
    cells = t["rows"] * t["columns"]
    missing, dup = 100.0 * t["missing"] / cells, 100.0 * t["duplicates"] / t["rows"]
    texts = text_cols(df)
    wide = 0
    if texts:
        unique = distinct_counts(df, texts)
        wide = sum(1 for v in unique.values() if v > 50)
    advice = [("data_quality", "overview", "Missing Percentage", missing), ("data_quality", "overview", "Duplicate Percentage", dup)]
    if missing > 10:
        advice.append(("data_quality", "high", "Handle Missing Values", missing))
    if dup > 5:
        advice.append(("data_quality", "medium", "Remove Duplicates", dup))
    if len(numeric_cols(df)) > 1:
        advice.append(("feature_engineering", "medium", "Feature Interactions", float(len(numeric_cols(df)))))
    if wide:
        advice.append(("preprocessing", "high", "High Cardinality Features", float(wide)))
    return df.sparkSession.createDataFrame(advice, "category string, priority string, title string, value double")
