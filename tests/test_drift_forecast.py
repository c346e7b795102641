import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.stats import chi2_pvalue, ks_pvalue
from tabloom.operators import drift as D
from tabloom.operators import forecast as X
from tabloom.plans import reports
from tabloom.streaming import monitor as S


def test_p_values(spark):
    df = spark.createDataFrame([(3.841459, 1.0), (9.487729, 4.0), (0.0, 3.0), (5.0, 0.0), (300.0, 200.0)], "x double, k double")
    got = [r[0] for r in df.select(chi2_pvalue(F.col("x"), F.col("k"))).collect()]
    assert np.allclose(got[:4], [0.05, 0.05, 1.0, 1.0], atol=1e-6) and 0 < got[4] < 1e-5
    p = spark.range(1).select(ks_pvalue(F.lit(0.0), F.lit(10), F.lit(10)), ks_pvalue(F.lit(1.0), F.lit(100), F.lit(100))).first()
    assert p[0] == 1.0 and p[1] < 1e-12


def test_column_drift_and_neutral_row(spark):
    ref = spark.createDataFrame([(float(i), "a" if i % 2 else "b", None) for i in range(100)], "x double, c string, e double")
    cur = spark.createDataFrame([(float(i + 60), "a", None) for i in range(100)], "x double, c string, e double")
    got = {r["column_name"]: r for r in D.detect_column_drift(ref, cur, ["x", "c", "e"]).collect()}
    assert round(got["x"]["drift_score"], 9) == 0.6 and got["x"]["drift_detected"] and got["x"]["drift_magnitude"] == "High"
    assert got["c"]["test_used"] == "Chi-square" and got["c"]["drift_detected"]
    assert (got["e"]["test_used"], got["e"]["p_value"], got["e"]["drift_magnitude"]) == ("No valid data", 1.0, "None")


def brute_ks(a, b):
    a, b = np.sort(np.array(a)), np.sort(np.array(b))
    points = np.unique(np.concatenate([a, b]))
    return np.abs(np.searchsorted(a, points, "right") / len(a) - np.searchsorted(b, points, "right") / len(b)).max()


@pytest.mark.parametrize("brackets", [2, 7, D.BRACKETS])
def test_distances_by_brackets_are_exact(spark, brackets):
    rng = np.random.default_rng(brackets)
    a = np.stack([rng.normal(0, 1, 900), rng.integers(0, 3, 900) * 1.0, np.where(rng.random(900) < 0.4, 5.0, rng.normal(0, 9, 900)), np.append(rng.normal(0, 1, 890), [np.inf] * 10)], axis=1)
    b = np.stack([rng.normal(0.1, 1, 500), rng.integers(0, 4, 500) * 1.0, np.where(rng.random(500) < 0.3, 5.0, rng.normal(0, 9, 500)), np.append(rng.normal(0, 1, 495), [-np.inf] * 5)], axis=1)
    names = ["normal", "few", "a tie", "ends"]
    ref, cur = (spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None,) * 4], ", ".join(f"`{n}` double" for n in names)).repartition(4) for x in (a, b))
    got = {r["column_name"]: r for r in D.drift_ks(ref, cur, names, brackets).collect()}
    assert {n: got[n]["statistic"] for n in names} == {n: brute_ks(a[:, i], b[:, i]) for i, n in enumerate(names)}
    assert {(r["reference_n"], r["current_n"]) for r in got.values()} == {(900, 500)}
    same = D.drift_ks(ref, ref, ["normal"], brackets).first()
    assert same["statistic"] == 0.0 and same["p_value"] == 1.0


def test_few_brackets_stay_open(spark):
    counts = [("x", b, 10, 5 if b < 50 else 15) for b in range(100)]
    known, still = D._open_brackets(counts)
    assert known["x"] == (0.25, 1000, 1000) and 0 < len(still) < 6


def test_single_category_has_no_chi_square(spark):
    df = spark.createDataFrame([("a",)] * 5, "c string")
    row = D.drift_chi2(df, df, ["c"]).first()
    assert (row["statistic"], row["p_value"]) == (0.0, 1.0)


def test_report_of_unchanged_data_advises_nothing_urgent(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"))
    titles = {r["item"] for r in reports.drift_report(df, ["x"], "id").where("section = 'advice'").collect()}
    assert titles == {"No Significant Drift Detected"}


START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rows = [("line", START + dt.timedelta(days=i), 10.0 + 2 * i) for i in range(20)]
    rows += [("flat", START + dt.timedelta(days=7 * i), 5.0) for i in range(4)]
    rows += [("single", START, 50.0), ("zero", START, 0.0)]
    return spark.createDataFrame(rows, "s string, ts timestamp_ntz, y double")


def test_forecast_branches(series):
    got = {}
    for r in X.forecast(series, 2, 0.95, "s").orderBy("ts").collect():
        got.setdefault(r["s"], []).append(r)
    assert [round(r["forecast"], 6) for r in got["line"]] == [50.0, 52.0]
    assert [r["ts"] for r in got["line"]] == [START + dt.timedelta(days=d) for d in (20, 21)]
    assert [r["ts"] for r in got["flat"]] == [START + dt.timedelta(days=d) for d in (28, 35)]
    assert round(got["single"][0]["upper_bound"], 6) == 59.8 and got["single"][0]["ts"] == START + dt.timedelta(days=1)
    assert round(got["zero"][0]["upper_bound"], 6) == 1.96


def test_frequency_metrics_and_quality(series):
    freq = {r["s"]: r["frequency"] for r in X.detect_frequency(series, "s").collect()}
    assert freq["line"] == "Daily" and freq["flat"] == "Weekly"
    m = {r["s"]: r for r in X.forecast_report(series, 3, 0.95, "s").collect()}
    assert round(m["line"]["r_squared"], 9) == 1.0 and m["line"]["trend_direction"] == "Increasing"
    assert m["flat"]["trend_direction"] == "Stable" and m["single"]["quality_level"] == "Excellent"


def test_history_and_forecast_in_one_table(series):
    out = X.forecast_table(series.where("s = 'line'").drop("s"), 3)
    assert out.where("is_forecast").count() == 3 and out.where("NOT is_forecast").count() == 20
    assert out.where("is_forecast AND lower_bound IS NULL").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(START + dt.timedelta(hours=i), float(i % 24) if i % 5 else None) for i in range(24 * 4)]
    spark.createDataFrame(rows, "ts timestamp_ntz, v double").repartition(3).write.parquet(str(tmp_path / "in"))
    bounds = {"v": {"lower": 2.0, "upper": 20.0}}
    batch = S.window_quality(spark.read.parquet(str(tmp_path / "in")), "ts", ["v"], bounds)
    stream = spark.readStream.schema("ts timestamp_ntz, v double").parquet(str(tmp_path / "in"))
    S.start_quality_monitor(stream, str(tmp_path / "out"), "ts", ["v"], bounds).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect())
    want = sorted(tuple(r) for r in batch.where(f"window_end <= TIMESTAMP_NTZ '{START + dt.timedelta(days=3)}'").collect())
    assert got == want and len(got) == 3


def test_window_drift_equals_brute_force_and_stream(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(START + dt.timedelta(hours=i), float(np.round(rng.normal(i // 200, 2), 1)) if i % 7 else None) for i in range(24 * 40)]
    spark.createDataFrame(rows, "ts timestamp_ntz, v double").repartition(3).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    batch = {r["window_start"]: r for r in S.window_drift(df, "ts", "v", "7 days").collect()}
    weeks = {}
    for ts, v in rows:
        if v is not None:
            weeks.setdefault((ts - dt.datetime(1970, 1, 1)).days // 7, []).append(v)
    first, *later = sorted(weeks)
    start = lambda w: dt.datetime(1970, 1, 1) + dt.timedelta(days=7 * w)
    assert {k: (round(r["statistic"], 12), r["row_count"]) for k, r in batch.items()} == {start(w): (round(brute_ks(weeks[w], weeks[first]), 12), len(weeks[w])) for w in later}
    reference = df.where(F.col("ts") < F.lit(str(start(first + 1))).cast("timestamp_ntz"))
    stream = spark.readStream.schema("ts timestamp_ntz, v double").parquet(str(tmp_path / "in"))
    S.start_window_drift(stream, reference, str(tmp_path / "out"), "ts", "v").awaitTermination()
    got = {r["window_start"]: r for r in spark.read.parquet(str(tmp_path / "out" / "rows")).drop("batch").collect() if r["window_start"] > start(first)}
    closed = [w for w in later if start(w + 1) <= rows[-1][0] - dt.timedelta(hours=1)]
    assert len(closed) > 2 and {k: tuple(r) for k, r in got.items()} == {start(w): tuple(batch[start(w)]) for w in closed}
