"""Drift between two periods, and forecasting."""

from statistics import NormalDist

from pyspark.sql import functions as F

from tabloom.operators import drift as D
from tabloom.operators import forecast as X
from workload.registry import query, union_all

SPLIT = "(SELECT *, row_number() OVER (ORDER BY ts, event_id) <= CAST(floor(count(*) OVER () * 0.7) AS BIGINT) AS is_ref FROM events)"
ORDER = ["ts", "event_id"]


def periods(t):
    return D.split_periods(t.events.select("event_id", "ts", "user_id", "event_type", "value"), ORDER, 0.7)


def ks_sql(src, c, ref="is_ref"):
    """D, sample sizes and the p-value of one column."""
    return (
        f"SELECT '{c}' AS column_name, d AS statistic, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * k * k * lam * lam))))) END AS p_value, "
        "n1 AS reference_n, n2 AS current_n FROM (SELECT *, (en + 0.12 + 0.11 / en) * d AS lam FROM (SELECT max(abs(fa - fb)) AS d, max(n1) AS n1, max(n2) AS n2, sqrt(max(n1) * max(n2) / (max(n1) + max(n2))) AS en FROM ("
        f"SELECT sum(a) OVER w / (sum(a) OVER ()) AS fa, sum(b) OVER w / (sum(b) OVER ()) AS fb, CAST(sum(a) OVER () AS BIGINT) AS n1, CAST(sum(b) OVER () AS BIGINT) AS n2 FROM "
        f"(SELECT {c} AS v, count(*) FILTER ({ref}) AS a, count(*) FILTER (NOT {ref}) AS b FROM {src} s WHERE {c} IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY v))))"
    )


def chi2_sql(src, c, ref="is_ref"):
    return (
        f"SELECT '{c}' AS column_name, CASE WHEN k = 1 THEN 0 WHEN k = 2 THEN sum(pow(greatest(0, abs(a - n1 * (a + b) / (n1 + n2)) - 0.5), 2) / (n1 * (a + b) / (n1 + n2)) + pow(greatest(0, abs(b - n2 * (a + b) / (n1 + n2)) - 0.5), 2) / (n2 * (a + b) / (n1 + n2))) "
        "ELSE sum(pow(a - n1 * (a + b) / (n1 + n2), 2) / (n1 * (a + b) / (n1 + n2)) + pow(b - n2 * (a + b) / (n1 + n2), 2) / (n2 * (a + b) / (n1 + n2))) END AS statistic, k - 1 AS dof, n1 AS reference_n, n2 AS current_n FROM "
        f"(SELECT *, CAST(sum(a) OVER () AS BIGINT) AS n1, CAST(sum(b) OVER () AS BIGINT) AS n2, count(*) OVER () AS k FROM (SELECT {c} AS v, count(*) FILTER ({ref}) AS a, count(*) FILTER (NOT {ref}) AS b FROM {src} s WHERE {c} IS NOT NULL GROUP BY 1)) GROUP BY k, n1, n2"
    )


@query("drift_ks", union_all([ks_sql(SPLIT, "value"), ks_sql(SPLIT, "user_id")]), rnd={9: "statistic p_value"})
def _(t):
    return D.drift_ks(*periods(t), ["value", "user_id"])


@query("drift_chi2", chi2_sql(SPLIT, "event_type"), rnd={6: "statistic"})
def _(t):
    return D.drift_chi2(*periods(t), ["event_type"]).drop("p_value")


@query(
    "drift_chi2_two_categories",
    chi2_sql(f"(SELECT is_ref, CASE WHEN event_type < 'm' THEN 'a' ELSE 'b' END AS half FROM {SPLIT} e)", "half"),
    rnd={6: "statistic"},
)
def _(t):
    ref, cur = [p.select(F.when(F.col("event_type") < "m", "a").otherwise("b").alias("half")) for p in periods(t)]
    return D.drift_chi2(ref, cur, ["half"]).drop("p_value")


@query(
    "drift_proportion",
    f"SELECT 'user_id' AS column_name, s AS drift_score, CASE WHEN s > 0.1 THEN 0.5::DOUBLE ELSE 0.8 END AS p_value FROM (SELECT abs(a - b) / greatest(a, b, 1) AS s FROM (SELECT count(DISTINCT user_id) FILTER (is_ref) AS a, count(DISTINCT user_id) FILTER (NOT is_ref) AS b FROM {SPLIT} s))",
    rnd={9: "drift_score"},
)
def _(t):
    return D.drift_proportion(*periods(t), "user_id")


_MAG = "CASE WHEN drift_score > 0.3 THEN 'High' WHEN drift_score > 0.1 THEN 'Medium' WHEN drift_score > 0.05 THEN 'Low' ELSE 'Minimal' END"
# 5 event types: 4 degrees of freedom, for which the tail has a closed form
_RESULTS = (
    f"SELECT *, {_MAG} AS drift_magnitude, p_value < 0.05 AS drift_detected FROM (SELECT column_name, 'Kolmogorov-Smirnov' AS test_used, statistic AS drift_score, p_value FROM ({union_all([ks_sql(SPLIT, 'value'), ks_sql(SPLIT, 'user_id')])}) "
    f"UNION ALL SELECT column_name, 'Chi-square', least(1.0, statistic / 100), exp(-statistic / 2) * (1 + statistic / 2) FROM ({chi2_sql(SPLIT, 'event_type')}))"
)
_W = "CASE drift_magnitude WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.6 WHEN 'Low' THEN 0.3 ELSE 0.1 END"
COLS = ["value", "user_id", "event_type"]


def results(t):
    return D.detect_column_drift(*periods(t), COLS)


@query("detect_column_drift", _RESULTS, rnd={8: "drift_score p_value"})
def _(t):
    return results(t)


@query(
    "drift_stats",
    union_all(
        f"SELECT 'value' AS column_name, count(value) AS value_count, min(value) AS min_value, max(value) AS max_value, avg(value) AS mean_value, quantile_cont(value, 0.5) AS median_value, stddev_samp(value) AS std_value, '{p}' AS period FROM {SPLIT} s WHERE {w}"
        for p, w in (("Reference", "is_ref"), ("Current", "NOT is_ref"))
    ),
    rnd={6: "mean_value median_value std_value"},
)
def _(t):
    return D.drift_stats(*periods(t), ["value"])


@query("overall_drift", f"SELECT sum(drift_score * {_W}) / sum({_W}) AS overall_drift_score FROM ({_RESULTS})", rnd={8: "overall_drift_score"})
def _(t):
    return D.overall_drift(results(t))


@query(
    "drift_summary",
    f"SELECT a AS reference_rows, 0::BIGINT AS reference_missing, b AS current_rows, 0::BIGINT AS current_missing, b - a AS row_count_change, 100.0 * (b - a) / a AS row_count_change_pct FROM (SELECT count(*) FILTER (is_ref) AS a, count(*) FILTER (NOT is_ref) AS b FROM {SPLIT} s)",
    rnd={6: "row_count_change_pct"},
)
def _(t):
    return D.drift_summary(*periods(t), COLS)


@query(
    "drift_histograms_numeric",
    union_all(
        f"SELECT CAST(least(floor((value - lo) * 30 / (hi - lo)), 29) AS BIGINT) AS bin, count(*) AS value_count, '{p}' AS period FROM (SELECT value, min(value) OVER () AS lo, max(value) OVER () AS hi FROM {SPLIT} s WHERE {w}) GROUP BY 1"
        for p, w in (("Reference", "is_ref"), ("Current", "NOT is_ref"))
    ),
)
def _(t):
    return D.drift_histograms(*periods(t), "value")


@query(
    "drift_histograms_text",
    f"SELECT event_type, count(*) FILTER (is_ref) AS reference_count, count(*) FILTER (NOT is_ref) AS current_count FROM {SPLIT} s GROUP BY 1",
)
def _(t):
    return D.drift_histograms(*periods(t), "event_type")


@query(
    "annotate_drift",
    f"SELECT event_id, ts, value, CASE WHEN is_ref THEN 'Reference' ELSE 'Current' END AS drift_period, r.drift_score AS value_drift_score, r.drift_detected AS value_drift_detected FROM {SPLIT} s, (SELECT * FROM ({_RESULTS}) WHERE column_name = 'value') r",
    rnd={8: "value_drift_score"},
)
def _(t):
    df = t.events.select("event_id", "ts", "value")
    ref, cur = D.split_periods(df, ORDER, 0.7)
    return D.annotate_drift(df, D.detect_column_drift(ref, cur, ["value"]), ORDER, 0.7)


# ---- forecasting: monthly order value per priority
SERIES = "(SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2)"
IX = f"(SELECT *, row_number() OVER w - 1 AS t, CAST(epoch(ts) - epoch(lag(ts) OVER w) AS BIGINT) AS step FROM {SERIES} s WINDOW w AS (PARTITION BY series ORDER BY ts, y))"
FIT = (
    "(SELECT series, count(*) AS n, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, avg(y) AS mean_y, stddev_pop(y) AS std_y, max(ts) AS last_ts, arg_max(step, t) AS step, arg_max(y, t) AS last_y, "
    f"sqrt((regr_syy(y, t) - regr_slope(y, t) * regr_sxy(y, t)) / count(*)) AS err FROM {IX} i GROUP BY 1)"
)
Z = repr(NormalDist().inv_cdf(0.975))


def monthly(t):
    df = t.orders.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    return X.ts_prepare(df.withColumnRenamed("o_orderpriority", "series"), "month", "total", "series")


def ahead_sql(value, err, model, z=Z):
    return (
        f"SELECT series, last_ts + to_seconds(CAST(i * step AS BIGINT)) AS ts, {value} AS forecast, {value} - {z} * {err} AS lower_bound, {value} + {z} * {err} AS upper_bound, CAST(i AS INTEGER) AS forecast_period, '{model}' AS model_type "
        f"FROM {FIT} f, range(1, 13) r(i)"
    )


_F = {2: "forecast lower_bound upper_bound"}
_LINE = ahead_sql("(slope * (n - 1 + i) + intercept)", "err", "Linear Trend")


@query("ts_prepare", f"SELECT * FROM {SERIES} s", rnd={2: "y"})
def _(t):
    return monthly(t)


@query("detect_frequency", f"SELECT series, step AS modal_step, 'Monthly' AS frequency FROM (SELECT series, step, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, step) AS r FROM {IX} i WHERE step IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def _(t):
    return X.detect_frequency(monthly(t), "series")


@query(
    "linear_trend",
    f"SELECT series, ts, y, t, slope * t + intercept AS fitted_value, y - (slope * t + intercept) AS residual FROM {IX} i JOIN {FIT} f USING (series)",
    rnd={2: "y fitted_value residual"},
)
def _(t):
    return X.linear_trend(monthly(t), "series")


@query("forecast", _LINE, rnd=_F)
def _(t):
    return X.forecast(monthly(t), 12, 0.95, "series")


@query("forecast_mean", ahead_sql("mean_y", "std_y", "Mean Forecast"), rnd=_F)
def _(t):
    return X.forecast_mean(monthly(t), 12, 0.95, "series")


@query("forecast_constant", ahead_sql("last_y", "(abs(last_y) * 0.1)", "Constant Forecast", "1.96"), rnd=_F)
def _(t):
    return X.forecast_constant(monthly(t), 12, "series")


@query("future_dates", f"SELECT series, ts, forecast_period FROM ({_LINE})")
def _(t):
    return X.future_dates(monthly(t), 12, "series")


@query(
    "forecast_table",
    f"SELECT series, ts, y, slope * t + intercept AS fitted_value, y - (slope * t + intercept) AS residual, false AS is_forecast, NULL::DOUBLE AS lower_bound, NULL::DOUBLE AS upper_bound, NULL::INTEGER AS forecast_period FROM {IX} i JOIN {FIT} f USING (series) "
    f"UNION ALL SELECT series, ts, forecast, forecast, NULL, true, lower_bound, upper_bound, forecast_period FROM ({_LINE})",
    rnd={2: "y fitted_value residual lower_bound upper_bound"},
)
def _(t):
    return X.forecast_table(monthly(t), 12, 0.95, "series")


_METRICS = (
    f"SELECT * FROM (SELECT series, avg(abs(e)) AS mae, avg(e * e) AS mse, 100 * avg(abs(e / y)) AS mape, sqrt(avg(e * e)) AS rmse, greatest(0, least(1, 1 - sum(e * e) / (var_pop(y) * count(*)))) AS r_squared "
    f"FROM (SELECT *, y - (slope * t + intercept) AS e FROM {IX} i JOIN {FIT} f USING (series)) GROUP BY 1) "
    "JOIN (SELECT *, CASE WHEN trend_slope > 0.01 THEN 'Increasing' WHEN trend_slope < -0.01 THEN 'Decreasing' ELSE 'Stable' END AS trend_direction FROM (SELECT series, model_type, avg(forecast) AS forecast_mean, stddev_pop(forecast) AS forecast_std, min(forecast) AS forecast_min, max(forecast) AS forecast_max, "
    f"(arg_max(forecast, forecast_period) - arg_min(forecast, forecast_period)) / 11 AS trend_slope FROM ({_LINE}) GROUP BY 1, 2)) USING (series)"
)
_M = {2: "mae rmse forecast_mean forecast_std forecast_min forecast_max trend_slope", -2: "mse", 6: "mape r_squared"}


@query("ts_metrics", _METRICS, rnd=_M)
def _(t):
    return X.ts_metrics(monthly(t), 12, 0.95, "series")


# daily values, with nulls on some days, leave gaps and outliers
DAILY = "(SELECT o_orderpriority AS series, date_trunc('day', o_orderdate) AS ts, CASE WHEN day(o_orderdate) = 13 THEN NULL ELSE sum(o_totalprice) END AS y FROM orders GROUP BY 1, 2, day(o_orderdate))"
_DIX = f"(SELECT *, CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series ORDER BY ts)) AS BIGINT) AS step FROM (SELECT * FROM {DAILY} d WHERE y IS NOT NULL))"
_QUALITY = (
    f"WITH a AS (SELECT series, count(*) AS total, count(*) - count(y) AS missing_values FROM {DAILY} d GROUP BY 1), ix AS (SELECT * FROM {_DIX}), "
    "q AS (SELECT series, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM ix GROUP BY 1), m AS (SELECT series, step AS ms FROM (SELECT series, step, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, step) AS r FROM ix WHERE step IS NOT NULL GROUP BY 1, 2) WHERE r = 1), "
    "c AS (SELECT series, count(*) AS data_points, any_value(missing_values) AS missing_values, any_value(100.0 * missing_values / total) AS missing_pct, count(*) FILTER (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS outlier_count, count(*) FILTER (step > 2 * ms) AS irregular_gaps "
    "FROM ix JOIN q USING (series) JOIN m USING (series) JOIN a USING (series) GROUP BY 1), "
    "d AS (SELECT *, 100.0 * outlier_count / data_points AS outlier_pct FROM c), e AS (SELECT *, greatest(0, least(100, 100 - 2 * missing_pct - outlier_pct - 50.0 * irregular_gaps / data_points)) AS quality_score FROM d) "
    "SELECT *, CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 70 THEN 'Good' WHEN quality_score >= 50 THEN 'Fair' ELSE 'Poor' END AS quality_level FROM e"
)


def daily(t):
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
    df = t.orders.groupBy(F.col("o_orderpriority").alias("series"), day.alias("ts")).agg(F.sum("o_totalprice").alias("y"))
    return df.withColumn("y", F.when(F.dayofmonth("ts") != 13, F.col("y")))


@query("ts_quality", _QUALITY, rnd={6: "missing_pct outlier_pct quality_score"})
def _(t):
    return X.ts_quality(daily(t), "series")


@query(
    "forecast_report",
    "SELECT * FROM (" + _METRICS + ") JOIN (SELECT DISTINCT series, 'Monthly' AS frequency FROM " + SERIES + " s) USING (series) JOIN ("
    + _QUALITY.replace(_DIX, IX).replace(DAILY, SERIES) + ") USING (series)",
    rnd={**_M, 6: "mape r_squared missing_pct outlier_pct quality_score"},
)
def _(t):
    return X.forecast_report(monthly(t), 12, 0.95, "series")


@query(
    "forecast_single_series",
    _LINE.replace("o_orderpriority AS series", "'all' AS series").replace("SELECT series, last_ts", "SELECT last_ts"),
    rnd=_F,
)
def _(t):
    df = t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    return X.forecast(X.ts_prepare(df, "month", "total"), 12, 0.95)
