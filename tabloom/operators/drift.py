"""Distribution drift between a reference and a current table.

Numeric columns are cut into brackets by a quantile sketch.  The counts of the brackets give the two
distributions exactly at every cut, and bound their gap in between; values are ordered only in the brackets
whose bound exceeds the largest gap at a cut.  All text columns share one count table.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.columns import as_list, numeric_cols
from tabloom.functions.stats import chi2_pvalue, ks_pvalue
from tabloom.operators.joins import align_counts
from tabloom.operators.ordered import split_by_order, split_random
from tabloom.operators.profile import bin_of, numeric_profile

#: Brackets of a numeric column.
BRACKETS = 500
# fixed values: weight of a column's score by its magnitude
MAGNITUDE_WEIGHTS = {"High": 1.0, "Medium": 0.6, "Low": 0.3, "Minimal": 0.1}


def _sides(reference: DataFrame, current: DataFrame, cols, cast: str) -> DataFrame:
    """(column_name, value, reference_count, current_count) for every distinct non-null value."""

    def long(df, side):
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(cast).alias("value")) for c in cols])
        return df.select(F.inline(F.filter(cells, lambda s: s["value"].isNotNull()))).withColumn("_cur", F.lit(side))

    both = long(reference, 0).unionByName(long(current, 1))
    return both.groupBy("column_name", "value").agg(
        F.sum(1 - F.col("_cur")).alias("reference_count"), F.sum("_cur").alias("current_count")
    )


def _bracketed(reference: DataFrame, current: DataFrame, cols: list[str], brackets: int) -> DataFrame:
    """(column_name, bracket, value, _cur) of every non-null value; not-a-number comes last."""
    names = [f"c{i}" for i in range(len(cols))]

    def side(df, cur):
        return df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names)], F.lit(cur).alias("_cur"))

    both = side(reference, 0).unionByName(side(current, 1))
    probs = [i / brackets for i in range(1, brackets)]
    sketch = both.agg(*[F.percentile_approx(F.when(~F.isnan(n), F.col(n)), probs, 10 * brackets).alias(n) for n in names]).first()
    cuts = [sorted({v for v in sketch[n] or [] if math.isfinite(v)}) or [0.0] for n in names]
    splits = [[-math.inf, *c, math.inf] for c in cuts]
    placed = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"b{n}" for n in names], handleInvalid="keep").transform(both)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"b{n}").cast("int").alias("bracket"), F.col(n).alias("value")) for c, n in zip(cols, names)])
    return placed.select("_cur", F.inline(F.filter(cells, lambda x: x["value"].isNotNull())))


def _open_brackets(counts) -> tuple[dict, list]:
    """({column: (largest gap at a cut, reference rows, current rows)}, the brackets that may hold a larger one).

    ``counts`` are (column, bracket, reference rows, current rows): at most one row per column and bracket.
    """
    by_column = defaultdict(list)
    for column, bracket, a, b in counts:
        by_column[column].append((bracket, a, b))
    known, still = {}, []
    for column, rows in by_column.items():
        rows.sort()
        n, m = sum(r[1] for r in rows), sum(r[2] for r in rows)
        if not n or not m:
            known[column] = (None, n, m)
            continue
        best, a, b, spans = 0.0, 0, 0, []
        for bracket, da, db in rows:
            spans.append((max((a + da) / n - b / m, (b + db) / m - a / n), bracket, a, b))
            a, b = a + da, b + db
            best = max(best, abs(a / n - b / m))
        known[column] = (best, n, m)
        still += [(column, bracket, a, b) for most, bracket, a, b in spans if most > best]
    return known, still


def drift_ks(reference: DataFrame, current: DataFrame, cols, brackets: int = BRACKETS) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and p-value per numeric column; exact."""
    spark, rows = reference.sparkSession, _bracketed(reference, current, as_list(cols), brackets)
    counts = rows.groupBy("column_name", "bracket").agg(F.sum(1 - F.col("_cur")).alias("a"), F.sum("_cur").alias("b")).collect()
    known, still = _open_brackets(counts)
    told = spark.createDataFrame([(c, *k) for c, k in known.items()], "column_name string, _cut double, reference_n long, current_n long")
    # at most one row per column and bracket
    open_ = F.broadcast(spark.createDataFrame(still, "column_name string, bracket int, _a0 long, _b0 long"))
    inside = rows.join(open_, ["column_name", "bracket"]).groupBy("column_name", "bracket", "_a0", "_b0", "value").agg(F.sum(1 - F.col("_cur")).alias("a"), F.sum("_cur").alias("b"))
    upto = Window.partitionBy("column_name", "bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    run = inside.withColumns({"a": F.col("_a0") + F.sum("a").over(upto), "b": F.col("_b0") + F.sum("b").over(upto)}).join(F.broadcast(told), "column_name")
    gaps = run.groupBy("column_name").agg(F.max(F.abs(F.col("a") / F.col("reference_n") - F.col("b") / F.col("current_n"))).alias("_in"))
    out = told.join(gaps, "column_name", "left").withColumn("statistic", F.greatest("_cut", "_in"))
    return out.select(
        "column_name", "statistic", ks_pvalue(F.col("statistic"), F.col("reference_n"), F.col("current_n")).alias("p_value"), "reference_n", "current_n"
    )


def drift_chi2(reference: DataFrame, current: DataFrame, cols) -> DataFrame:
    """Chi-square of the 2 x k count table per text column; Yates' correction when k = 2."""
    counts = _sides(reference, current, as_list(cols), "string")
    a, b = F.col("reference_count").cast("double"), F.col("current_count").cast("double")
    sums = counts.groupBy("column_name").agg(
        F.sum("reference_count").alias("reference_n"),
        F.sum("current_count").alias("current_n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(a * a / (a + b)).alias("_sa"),
        F.sum(b * b / (a + b)).alias("_sb"),
        F.max(F.struct(a.alias("a"), b.alias("b"))).alias("_x"),
        F.min(F.struct(a.alias("a"), b.alias("b"))).alias("_y"),
    )
    ra, rb = F.col("reference_n").cast("double"), F.col("current_n").cast("double")
    n = ra + rb
    plain = n * (F.try_divide("_sa", ra) + F.try_divide("_sb", rb) - 1)
    x, y = F.col("_x"), F.col("_y")
    cross = F.greatest(F.lit(0.0), F.abs(x["a"] * y["b"] - x["b"] * y["a"]) - n / 2)
    yates = F.try_divide(n * cross * cross, ra * rb * (x["a"] + x["b"]) * (y["a"] + y["b"]))
    stat = F.when(F.col("k") == 1, F.lit(0.0)).when(F.col("k") == 2, yates).otherwise(F.greatest(F.lit(0.0), plain))
    out = sums.select("column_name", stat.alias("statistic"), (F.col("k") - 1).alias("dof"), "reference_n", "current_n")
    return out.withColumn("p_value", chi2_pvalue(F.col("statistic"), F.col("dof")))


def drift_proportion(reference: DataFrame, current: DataFrame, col: str) -> DataFrame:
    """Difference of the numbers of distinct values over the larger one."""
    counts = align_counts(reference, current, col).agg(
        F.count_if(F.col("reference_count") > 0).alias("a"), F.count_if(F.col("current_count") > 0).alias("b")
    )
    score = F.abs(F.col("a") - F.col("b")) / F.greatest("a", "b", F.lit(1))
    return counts.select(F.lit(col).alias("column_name"), score.alias("drift_score"), F.when(score > 0.1, 0.5).otherwise(0.8).alias("p_value"))


def magnitude(score: Column) -> Column:
    return F.when(score > 0.3, "High").when(score > 0.1, "Medium").when(score > 0.05, "Low").otherwise("Minimal")


def detect_column_drift(reference: DataFrame, current: DataFrame, cols, alpha: float = 0.05) -> DataFrame:
    """One row per column: test, score, p-value, magnitude, decision.  A column without data is neutral."""
    cols = as_list(cols)
    numbers = numeric_cols(reference, cols)
    others = [c for c in cols if c not in numbers]
    parts = []
    if numbers:
        ks = drift_ks(reference, current, numbers)
        parts.append(ks.select("column_name", F.lit("Kolmogorov-Smirnov").alias("test_used"), F.col("statistic").alias("drift_score"), "p_value", "reference_n", "current_n"))
    if others:
        chi = drift_chi2(reference, current, others)
        parts.append(chi.select("column_name", F.lit("Chi-square").alias("test_used"), F.least(F.lit(1.0), F.col("statistic") / 100).alias("drift_score"), "p_value", "reference_n", "current_n"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = found.where((F.col("reference_n") > 0) & (F.col("current_n") > 0)).drop("reference_n", "current_n")
    names = reference.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    known = F.col("test_used").isNotNull()
    return names.join(found, "column_name", "left").select(
        "column_name",
        F.coalesce("test_used", F.lit("No valid data")).alias("test_used"),
        F.coalesce("drift_score", F.lit(0.0)).alias("drift_score"),
        F.coalesce("p_value", F.lit(1.0)).alias("p_value"),
        F.when(known, magnitude(F.col("drift_score"))).otherwise("None").alias("drift_magnitude"),
        F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("drift_detected"),
    )


def drift_stats(reference: DataFrame, current: DataFrame, cols) -> DataFrame:
    """Numeric profile of both periods."""
    a = numeric_profile(reference, cols).withColumn("period", F.lit("Reference"))
    return a.unionByName(numeric_profile(current, cols).withColumn("period", F.lit("Current")))


def overall_drift(results: DataFrame) -> DataFrame:
    """Mean of the column scores weighted by magnitude.  One row."""
    weight = F.lit(0.1)
    for name, w in MAGNITUDE_WEIGHTS.items():
        weight = F.when(F.col("drift_magnitude") == name, F.lit(w)).otherwise(weight)
    return results.agg(F.coalesce(F.try_divide(F.sum(F.col("drift_score") * weight), F.sum(weight)), F.lit(0.0)).alias("overall_drift_score"))


def drift_summary(reference: DataFrame, current: DataFrame, cols) -> DataFrame:
    """Rows and missing cells of both periods, and the change in rows."""
    cols = as_list(cols)

    def side(df, name):
        miss = sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull()))
        return df.agg(F.count(F.lit(1)).alias(f"{name}_rows"), miss.alias(f"{name}_missing")).first()

    a, b = side(reference, "r"), side(current, "c")
    n0, n1 = a["r_rows"], b["c_rows"]
    row = (n0, a["r_missing"], n1, b["c_missing"], n1 - n0, 100.0 * (n1 - n0) / n0 if n0 else 0.0)
    return reference.sparkSession.createDataFrame(
        [row], "reference_rows bigint, reference_missing bigint, current_rows bigint, current_missing bigint, row_count_change bigint, row_count_change_pct double"
    )


def drift_histograms(reference: DataFrame, current: DataFrame, col: str, bins: int = 30, k: int = 10) -> DataFrame:
    """Numbers: bin counts of each period over its own range.  Texts: counts of each period's top-k values."""
    if numeric_cols(reference, [col]):
        parts = []
        for df, name in ((reference, "Reference"), (current, "Current")):
            lo_hi = df.agg(F.min(col).cast("double").alias("a"), F.max(col).cast("double").alias("b")).first()
            binned = df.where(F.col(col).isNotNull()).groupBy(bin_of(col, lo_hi["a"], lo_hi["b"], bins).alias("bin"))
            parts.append(binned.agg(F.count(F.lit(1)).alias("value_count")).withColumn("period", F.lit(name)))
        return parts[0].unionByName(parts[1])
    aligned = align_counts(reference, current, col)
    tops = [aligned.where(F.col(n) > 0).orderBy(F.desc(n), col).limit(k).select(col, n) for n in ("reference_count", "current_count")]
    return tops[0].join(tops[1], col, "full").select(col, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("reference_count", "current_count")])


def annotate_drift(df: DataFrame, results: DataFrame, order_by, ratio: float = 0.7) -> DataFrame:
    """Mark each row's period and attach each column's score and decision (one result row per column)."""
    marked = split_by_order(df, order_by, ratio, "drift_period")
    made = {}
    for r in results.select("column_name", "drift_score", "drift_detected").collect():
        made[f"{r['column_name']}_drift_score"] = F.lit(r["drift_score"])
        made[f"{r['column_name']}_drift_detected"] = F.lit(r["drift_detected"])
    return marked.withColumns(made)


def split_periods(df: DataFrame, order_by, ratio: float = 0.7, how: str = "temporal", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    if how == "random":
        marked = split_random(df, order_by, ratio, seed, name="drift_period")
        return marked.where("drift_period = 'test'").drop("drift_period"), marked.where("drift_period = 'train'").drop("drift_period")
    marked = split_by_order(df, order_by, ratio, "drift_period")
    return marked.where("drift_period = 'Reference'").drop("drift_period"), marked.where("drift_period = 'Current'").drop("drift_period")
