"""Monitoring of an event table: the same window aggregates run on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.columns import as_list, total
from tabloom.functions.stats import ks_pvalue
from tabloom.operators.drift import detect_column_drift
from tabloom.operators.ordered import running_total
from tabloom.operators.profile import is_outside
from tabloom.session import cut_lineage

# fixed values: alert thresholds of quality scores and drift p-values
QUALITY_WARNING, QUALITY_CRITICAL = 75.0, 60.0
DRIFT_WARNING, DRIFT_CRITICAL = 0.03, 0.01


def _status(value: Column, warning: float, critical: float) -> Column:
    return F.when(value < critical, "critical").when(value < warning, "warning").otherwise("ok")


def window_quality(df: DataFrame, ts: str, cols, bounds: dict, window: str = "1 day", warning: float = QUALITY_WARNING, critical: float = QUALITY_CRITICAL, watermark: str | None = None) -> DataFrame:
    """Completeness, outlier share and status of each time window.

    ``bounds`` ({column: {lower, upper}}) come from a reference table, because exact quantiles do not
    stream.  With ``watermark`` the frame may be a stream; late rows are dropped after that delay.
    """
    cols = as_list(cols)
    zoneless = dict(df.dtypes)[ts] == "timestamp_ntz"
    if watermark:
        if zoneless:
            # a watermark needs a time-zoned column: keep the wall-clock time as UTC, so days stay days
            df = df.withColumn(ts, F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))
        df = df.withWatermark(ts, watermark)
    cells = F.lit(len(cols))
    present = total([F.count(c) for c in cols])
    out = total([F.count_if(is_outside(c, b)) for c, b in bounds.items()])
    checked = total([F.count(c) for c in bounds])
    agg = df.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("row_count"), (100.0 * present / (F.count(F.lit(1)) * cells)).alias("completeness_pct"), F.coalesce(100.0 * F.try_divide(out, checked), F.lit(0.0)).alias("outlier_pct")
    )
    score = F.col("completeness_pct") - F.col("outlier_pct")

    def edge(name):
        c = F.col(f"w.{name}")
        return F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz") if watermark and zoneless else c

    return agg.select(
        edge("start").alias("window_start"), edge("end").alias("window_end"), "row_count", "completeness_pct", "outlier_pct",
        score.alias("quality_score"), _status(score, warning, critical).alias("status"),
    )


def _value_counts(df: DataFrame, ts: str, col: str, window: str) -> DataFrame:
    """(window_start, value, n): a window's values, combined before they move."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.window(ts, window).alias("w"), F.col(col).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "value", "n")


def counts_drift(counts: DataFrame, reference: DataFrame, warning: float = DRIFT_WARNING, critical: float = DRIFT_CRITICAL) -> DataFrame:
    """Each window of ``counts`` (window_start, value, n) against the ``reference`` counts (value, n).

    The gap of two step functions is largest at a value of the window, or just below one, so the reference
    is ordered once for all windows and never repeated.
    """
    windows = counts.withColumn("_r", F.lit(0).cast("long"))
    values = windows.select("value", "_r").unionByName(reference.select("value", F.col("n").alias("_r"))).groupBy("value").agg(F.sum("_r").alias("_r"))
    known = running_total(values, "value", {"_upto": ("_r", "sum")})
    total_n = reference.agg(F.sum("n").alias("reference_n"))
    run = running_total(counts, "value", {"_own": ("n", "sum")}, partition_by="window_start")
    sizes = counts.groupBy("window_start").agg(F.sum("n").alias("current_n"))
    both = run.join(known, "value").join(sizes, "window_start").join(F.broadcast(total_n))  # one row
    at = F.abs(F.col("_own") / F.col("current_n") - F.col("_upto") / F.col("reference_n"))
    below = F.abs((F.col("_own") - F.col("n")) / F.col("current_n") - (F.col("_upto") - F.col("_r")) / F.col("reference_n"))
    ks = both.groupBy("window_start", "reference_n", "current_n").agg(F.max(F.greatest(at, below)).alias("statistic"))
    p = ks_pvalue(F.col("statistic"), F.col("reference_n"), F.col("current_n"))
    return ks.withColumn("p_value", p).select("window_start", "statistic", "p_value", F.col("current_n").alias("row_count"), _status(F.col("p_value"), warning, critical).alias("status"))


def window_drift(df: DataFrame, ts: str, col: str, window: str = "7 days", warning: float = DRIFT_WARNING, critical: float = DRIFT_CRITICAL) -> DataFrame:
    """Each later window against the first one by the Kolmogorov-Smirnov test."""
    counts = cut_lineage(_value_counts(df, ts, col, window))
    first = df.agg(F.min(F.window(ts, window)["start"]).alias("window_start"))  # one row
    reference = counts.join(F.broadcast(first), "window_start").select("value", "n")
    later = counts.join(F.broadcast(first.withColumnRenamed("window_start", "_first"))).where("window_start > _first").drop("_first")
    return counts_drift(later, reference, warning, critical)


def start_window_drift(stream: DataFrame, reference: DataFrame, path: str, ts: str, col: str, window: str = "7 days", watermark: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Test each window of a stream once it is closed, against the table ``reference``.

    The state is the counts of each open window's values, keyed by both; a closed window leaves it as a whole,
    so one micro-batch holds all of its counts.  A replayed batch overwrites its own folder.
    """
    zoneless = dict(stream.dtypes)[ts] == "timestamp_ntz"
    if zoneless:
        # a watermark needs a time-zoned column: keep the wall-clock time as UTC, so windows stay the same
        stream = stream.withColumn(ts, F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))
    known = cut_lineage(reference.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")))

    def check(batch: DataFrame, batch_id: int) -> None:
        if zoneless:
            batch = batch.withColumn("window_start", F.to_utc_timestamp("window_start", F.current_timezone()).cast("timestamp_ntz"))
        counts_drift(cut_lineage(batch), known).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    counts = _value_counts(stream.withWatermark(ts, watermark), ts, col, window)
    writer = counts.writeStream.outputMode("append").foreachBatch(check).option("checkpointLocation", f"{path}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def start_quality_monitor(stream: DataFrame, path: str, ts: str, cols, bounds: dict, window: str = "1 day", watermark: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Write each closed window once to ``path``/rows; offsets and state live in ``path``/state."""
    report = window_quality(stream, ts, cols, bounds, window, watermark=watermark)
    writer = report.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def start_drift_monitor(stream: DataFrame, reference: DataFrame, path: str, cols, alpha: float = 0.05, trigger: dict | None = None) -> StreamingQuery:
    """Test every micro-batch against the stored reference table; a replayed batch overwrites its own folder."""

    def check(batch: DataFrame, batch_id: int) -> None:
        found = detect_column_drift(reference, batch, cols, alpha).withColumn("batch_id", F.lit(batch_id))
        found.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(check).option("checkpointLocation", f"{path}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
