"""Linear-trend forecasting of many series at once.

A series is identified by ``series`` key columns; its rows are numbered by time with the block-wise
row index, so one very long series is never gathered in one task.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.columns import as_list, datetime_cols, join_on
from tabloom.operators.ordered import BLOCK_ROWS, POS, index_positions, positioned, step_positions
from tabloom.operators.quantiles import quantiles_by
from tabloom.operators.shape import append_rows, datetime_or_null, numeric_or_null

DAY = 86_400


def z_value(ci: float) -> float:
    return NormalDist().inv_cdf((1 + ci) / 2) if 0 < ci < 1 else 1.96


def ts_prepare(df: DataFrame, ts: str, y: str, series=()) -> DataFrame:
    """Series keys, timestamp and numeric value; rows that do not parse are dropped."""
    when = F.col(ts).cast("timestamp_ntz") if datetime_cols(df, [ts]) else datetime_or_null(ts)
    return df.select(*as_list(series), when.alias("ts"), numeric_or_null(y).alias("y")).na.drop(subset=["ts", "y"])


def indexed(prepared: DataFrame, series=(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``t`` (0-based position in the series) and ``step`` (seconds since the row before)."""
    series = as_list(series)
    pos = positioned(prepared, ["ts", "y"], series)
    stepped = step_positions(pos, "ts", series, "step", block_rows)
    return index_positions(stepped, series, "t").drop(POS)


def _group(df: DataFrame, series):
    return df.groupBy(*as_list(series))


def _modal_step(ix: DataFrame, series) -> DataFrame:
    """Most frequent step per series, ties to the smallest."""
    series = as_list(series)
    counts = _group(ix.where(F.col("step").isNotNull()), [*series, "step"]).agg(F.count(F.lit(1)).alias("_c"))
    return _group(counts, series).agg(F.max_by("step", F.struct("_c", -F.col("step"))).alias("modal_step"))


def frequency_label(step: Column) -> Column:
    cuts = ((1, "Daily"), (7, "Weekly"), (31, "Monthly"), (92, "Quarterly"), (366, "Yearly"))
    out = F.when(step.isNull(), "Unknown")
    for days, label in cuts:
        out = out.when(step <= days * DAY, label)
    return out.otherwise("Irregular")


def detect_frequency(prepared: DataFrame, series=()) -> DataFrame:
    return _modal_step(indexed(prepared, series), series).select(*as_list(series), "modal_step", frequency_label(F.col("modal_step")).alias("frequency"))


def fit_trend(ix: DataFrame, series=()) -> DataFrame:
    """Least-squares line on the position, its error, and what the forecast dates need.  One row per series."""
    degenerate = F.count("y") < 2
    slope = F.when(degenerate, F.lit(0.0)).otherwise(F.regr_slope("y", "t"))
    fit = _group(ix, series).agg(
        F.count("y").alias("n"),
        slope.alias("slope"),
        F.avg("y").alias("mean_y"),
        F.avg("t").alias("mean_t"),
        F.stddev_pop("y").alias("std_y"),
        F.when(degenerate, F.lit(0.0)).otherwise(F.regr_syy("y", "t") - F.regr_slope("y", "t") * F.regr_sxy("y", "t")).alias("_rss"),
        F.max("ts").alias("last_ts"),
        F.max_by("step", "t").alias("_step"),
    )
    n = F.col("n")
    step = F.when(F.col("_step") > 0, F.col("_step")).otherwise(F.lit(DAY))
    fit = fit.withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_t"))
    base = F.col("mean_y")
    single = F.when(base != 0, F.abs(base) * 0.1).otherwise(F.lit(1.0))
    error = F.when(n < 2, single).otherwise(F.sqrt(F.greatest(F.greatest(F.col("_rss"), F.lit(0.0)) / n, F.lit(1e-10))))
    return fit.withColumns(
        {"std_error": error, "step_seconds": step, "model_type": F.when(n < 2, "Constant Forecast").otherwise("Linear Trend")}
    ).drop("_rss", "_step", "mean_t")


def linear_trend(prepared: DataFrame, series=()) -> DataFrame:
    """Fitted value and residual of every observation."""
    ix = indexed(prepared, series)
    return _fitted(ix, fit_trend(ix, series), series)


def _fitted(ix, fit, series):
    series = as_list(series)
    line = fit.select(*series, "slope", "intercept")
    both = join_on(ix, line, series, "inner") if series else _attach_one(ix, line)
    fitted = F.col("slope") * F.col("t") + F.col("intercept")
    return both.select(*series, "ts", "y", "t", fitted.alias("fitted_value"), (F.col("y") - fitted).alias("residual"))


def _attach_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the values of a one-row frame as constants."""
    row = one_row.first()
    types = dict(one_row.dtypes)
    return df.withColumns({c: F.lit(row[c] if row else None).cast(types[c]) for c in one_row.columns})


def add_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds)


def _horizon(fit: DataFrame, series, h: int, ci: float, value: Column, error: Column) -> DataFrame:
    i = F.col("forecast_period")
    z = F.when(F.col("model_type") == "Constant Forecast", F.lit(1.96)).otherwise(F.lit(z_value(ci)))
    rows = fit.withColumn("forecast_period", F.explode(F.sequence(F.lit(1), F.lit(h))))
    return rows.select(
        *as_list(series),
        add_seconds(F.col("last_ts"), i * F.col("step_seconds")).alias("ts"),
        value.alias("forecast"),
        (value - z * error).alias("lower_bound"),
        (value + z * error).alias("upper_bound"),
        "forecast_period",
        "model_type",
    )


def _forecast_from(fit, series, h, ci):
    t = F.col("n") - 1 + F.col("forecast_period")
    return _horizon(fit, series, h, ci, F.col("slope") * t + F.col("intercept"), F.col("std_error"))


def forecast(prepared: DataFrame, h: int, ci: float = 0.95, series=()) -> DataFrame:
    """h future values per series with bounds; a one-point series repeats its value."""
    return _forecast_from(fit_trend(indexed(prepared, series), series), series, h, ci)


def forecast_mean(prepared: DataFrame, h: int, ci: float = 0.95, series=()) -> DataFrame:
    """Mean of the series with bounds from its population deviation."""
    fit = fit_trend(indexed(prepared, series), series).withColumn("model_type", F.lit("Mean Forecast"))
    spread = F.when(F.col("std_y") > 0, F.col("std_y")).otherwise(F.greatest(F.abs("mean_y") * 0.1, F.lit(1.0)))
    return _horizon(fit, series, h, ci, F.col("mean_y"), spread)


def forecast_constant(prepared: DataFrame, h: int, series=()) -> DataFrame:
    """The last value of the series, +- 1.96 times a tenth of it."""
    ix = indexed(prepared, series)
    last = _group(ix, series).agg(F.max_by("y", "t").alias("_last"))
    fit = fit_trend(ix, series).withColumn("model_type", F.lit("Constant Forecast"))
    fit = join_on(fit, last, series, "inner") if as_list(series) else _attach_one(fit, last)
    base = F.col("_last")
    return _horizon(fit, series, h, 0.95, base, F.when(base != 0, F.abs(base) * 0.1).otherwise(F.lit(1.0)))


def future_dates(prepared: DataFrame, h: int, series=()) -> DataFrame:
    """Last date plus multiples of the last step (one day if there is none)."""
    fit = fit_trend(indexed(prepared, series), series)
    return _forecast_from(fit, series, h, 0.95).select(*as_list(series), "ts", "forecast_period")


def forecast_table(prepared: DataFrame, h: int, ci: float = 0.95, series=()) -> DataFrame:
    """History with fitted values and residuals, followed by the forecast rows."""
    series = as_list(series)
    ix = indexed(prepared, series)
    fit = fit_trend(ix, series)
    history = _fitted(ix, fit, series).drop("t").withColumn("is_forecast", F.lit(False))
    future = _forecast_from(fit, series, h, ci).drop("model_type").withColumnRenamed("forecast", "y")
    future = future.withColumns({"fitted_value": F.col("y"), "is_forecast": F.lit(True)})
    return append_rows(history, future)


def _metrics(ix, fit, series, h, ci):
    series = as_list(series)
    y, e = F.col("y"), F.col("residual")
    big = F.abs(y) > 1e-10
    hist = _group(_fitted(ix, fit, series), series).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.coalesce(100 * F.avg(F.when(big, F.abs(e / y))), F.lit(0.0)).alias("mape"),
        F.sum(e * e).alias("_res"),
        (F.var_pop("y") * F.count("y")).alias("_tot"),
    )
    hist = hist.withColumns(
        {
            "rmse": F.sqrt(F.greatest("mse", F.lit(1e-10))),
            "r_squared": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_res") / F.greatest("_tot", F.lit(1e-10)))),
        }
    ).drop("_res", "_tot")
    v = F.col("forecast")
    slope = F.lit(0.0) if h < 2 else (F.max_by(v, "forecast_period") - F.min_by(v, "forecast_period")) / (h - 1)
    ahead = _group(_forecast_from(fit, series, h, ci), [*series, "model_type"]).agg(
        F.avg(v).alias("forecast_mean"), F.stddev_pop(v).alias("forecast_std"), F.min(v).alias("forecast_min"), F.max(v).alias("forecast_max"), slope.alias("trend_slope")
    )
    s = F.col("trend_slope")
    direction = F.lit("Unknown") if h < 2 else F.when(s > 0.01, "Increasing").when(s < -0.01, "Decreasing").otherwise("Stable")
    ahead = ahead.withColumn("trend_direction", direction)
    return join_on(hist, ahead, series, "inner") if series else _attach_one(hist, ahead)


def ts_metrics(prepared: DataFrame, h: int, ci: float = 0.95, series=()) -> DataFrame:
    ix = indexed(prepared, series)
    return _metrics(ix, fit_trend(ix, series), series, h, ci)


def _quality(ix, prepared_all, series):
    """Missing share, outlier share, irregular gaps and the score made of them."""
    series = as_list(series)

    def attach(a, b):
        return join_on(a, b, series, "left") if series else _attach_one(a, b)

    sizes = _group(prepared_all, series).agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("y").isNull()).alias("missing_values"))
    bounds = quantiles_by(ix, series, "y", [0.25, 0.75], ["_q1", "_q3"])
    rows = attach(attach(ix, bounds), _modal_step(ix, series))
    iqr = F.col("_q3") - F.col("_q1")
    out = (iqr > 1e-10) & ((F.col("y") < F.col("_q1") - 1.5 * iqr) | (F.col("y") > F.col("_q3") + 1.5 * iqr))
    gap = (F.col("modal_step") > 0) & (F.col("step") > 2 * F.col("modal_step"))
    agg = _group(rows, series).agg(F.count(F.lit(1)).alias("data_points"), F.count_if(out).alias("_out"), F.count_if(gap).alias("irregular_gaps"))
    agg = attach(agg, sizes)
    n = F.col("data_points")
    outliers = F.when(n > 4, F.col("_out")).otherwise(F.lit(0))
    agg = agg.withColumn("outlier_count", outliers).withColumn("outlier_pct", 100.0 * F.col("outlier_count") / n)
    agg = agg.withColumn("missing_pct", F.coalesce(100.0 * F.col("missing_values") / F.col("_all"), F.lit(0.0)))
    score = 100 - 2 * F.col("missing_pct") - F.col("outlier_pct") - 50.0 * F.col("irregular_gaps") / n
    agg = agg.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    q = F.col("quality_score")
    level = F.when(q >= 90, "Excellent").when(q >= 70, "Good").when(q >= 50, "Fair").otherwise("Poor")
    return agg.withColumn("quality_level", level).select(
        *series, "data_points", "missing_values", "missing_pct", "outlier_count", "outlier_pct", "irregular_gaps", "quality_score", "quality_level"
    )


def ts_quality(df: DataFrame, series=()) -> DataFrame:
    """``df`` has columns ts and y; y may hold nulls, which count as missing."""
    return _quality(indexed(df.na.drop(subset=["ts", "y"]), series), df, series)


def forecast_report(df: DataFrame, h: int = 12, ci: float = 0.95, series=()) -> DataFrame:
    """Frequency, model, metrics and data quality of each series, from one ordering of the data."""
    series = as_list(series)
    ix = indexed(df.na.drop(subset=["ts", "y"]), series)
    fit = fit_trend(ix, series)
    freq = _modal_step(ix, series).select(*series, frequency_label(F.col("modal_step")).alias("frequency"))
    metrics, quality = _metrics(ix, fit, series, h, ci), _quality(ix, df, series)
    if series:
        return join_on(join_on(metrics, freq, series, "left"), quality, series, "left")
    return _attach_one(_attach_one(metrics, freq), quality)
