import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import scalars as X
from tabloom.operators import clean as C
from tabloom.operators import features as E
from tabloom.operators import joins as J
from tabloom.operators import profile as P
from tabloom.operators import shape as S


@pytest.fixture(scope="module")
def ties(spark):
    return spark.createDataFrame(
        [(1, "b", 1.0), (2, "a", 1.0), (3, "b", 2.0), (4, "a", None), (5, None, 100.0)], "id int, c string, x double"
    )


def test_missing_unique_and_duplicates(ties):
    miss = {r["column_name"]: (r["missing_count"], r["missing_pct"]) for r in P.missing_report(ties).collect()}
    assert miss == {"id": (0, 0.0), "c": (1, 20.0), "x": (1, 20.0)}
    assert {r["column_name"]: r["unique_count"] for r in P.unique_report(ties).collect()} == {"id": 5, "c": 2, "x": 3}
    both = ties.select("c").union(ties.select("c"))
    assert P.duplicate_rows(both).first()["duplicate_rows"] == 7


def test_wide_tables_are_profiled_in_chunks(spark):
    df = spark.range(3).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(130)])
    facts = P.column_facts(df)
    assert facts.count() == 130 and facts.where("unique_count = 3").count() == 130


def test_mode_and_top_values_break_ties_by_value(ties):
    assert P.mode_of(ties, "c").first()["mode_value"] == "a"
    assert [r["value"] for r in P.top_values(ties, "c", 2).collect()] == ["a", "b"]


def test_empty_table_reports(spark):
    empty = spark.createDataFrame([], "x double, c string")
    assert P.duplicate_rows(empty).first()["duplicate_rows"] == 0
    assert P.iqr_bounds(empty).first()["q1"] is None
    assert P.missing_report(empty).where("missing_pct = 0").count() == 2


def test_constant_histogram_has_one_bin(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [(r["bin"], r["value_count"]) for r in P.histogram(df, "x").collect()] == [(0, 2)]


def test_skewness_needs_three_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    row = P.distribution_report(df).first()
    assert row["skewness"] is None and row["kurtosis"] is None


def test_impute_and_confidence(ties):
    out = {r["id"]: r for r in C.impute_with_confidence(ties, ["c", "x"]).collect()}
    assert out[4]["x"] == 1.5 and out[4]["x_imputation_confidence"] == 0.0
    assert out[5]["c"] == "a" and out[1]["c_imputation_confidence"] == 1.0
    assert "id_imputation_confidence" not in C.impute_with_confidence(ties, ["id"]).columns


def test_validation_scores(spark):
    rows = [(1, None), (2, ""), (3, "N/A"), (4, "#x"), (5, "y" * 201), (6, "Fine text"), (7, "?")]
    got = {r["id"]: round(r["t_data_quality"], 6) for r in C.validate_text(spark.createDataFrame(rows, "id int, t string"), ["t"]).collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 0.3, 4: 0.3, 5: 0.7, 6: 1.0, 7: 0.15}


@pytest.mark.parametrize("text, want", [("o'neil mc-donald", "O'Neil Mc-Donald"), ("ab3cd EF", "Ab3Cd Ef"), ("straße", "Straße"), ("", "")])
def test_title_case(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.title_case("t")).first()[0] == want == text.title()


def test_email_phone_date_predicates(spark):
    texts = ["mail a.b@c.org now", "call 555-123-4567", "on 12/31/2020", "nothing", "x5551234567y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(X.contains_email("t"), X.contains_phone("t"), X.contains_date("t")).collect()]
    assert got == [(True, False, False), (False, True, False), (False, False, True), (False,) * 3, (False,) * 3]


def test_date_parsing_order(spark):
    texts = ["2020-01-05", "12/31/2020", "31/12/2020", "2020-01-05 10:00:00", "never"]
    got = [r[0] for r in S.to_datetime(spark.createDataFrame([(t,) for t in texts], "d string"), "d").collect()]
    assert [str(x) for x in got] == ["2020-01-05 00:00:00", "2020-12-31 00:00:00", "2020-12-31 00:00:00", "2020-01-05 10:00:00", "None"]


def test_one_hot_limits_and_nan(ties):
    out = E.one_hot(ties, "c")
    assert {"c_onehot_a", "c_onehot_b", "c_onehot_nan"} <= set(out.columns)
    assert out.where("c_onehot_nan").count() == 1
    assert E.one_hot(ties, "c", max_card=1).columns == ties.columns
    assert "c_onehot_a" not in E.one_hot(ties, "c", drop_first=True).columns


def test_label_encode_counts_null_as_missing(ties):
    got = {r["id"]: r["c_label_encoded"] for r in E.label_encode(ties, "c").collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 2}


def test_row_stats_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, None), (None, None)], "a double, b double")
    got = [(r["numeric_sum"], r["numeric_mean"], None if r["numeric_std"] is None else round(r["numeric_std"], 6)) for r in E.row_stats(df).collect()]
    assert got == [(4.0, 2.0, 1.414214), (2.0, 2.0, None), (0.0, None, None)]


def test_joins_keep_rows_and_fill(spark, ties):
    dim = spark.createDataFrame([("a", 10)], "c string, w int")
    out = J.lookup_join(ties, dim, "c", {"w": 0})
    assert out.count() == 5 and out.where("w = 10").count() == 2
    upd = J.update_by_key(ties, spark.createDataFrame([(1, 9.0)], "id int, x double"), "id", "x")
    assert {r["id"]: r["x"] for r in upd.collect()}[1] == 9.0
    assert J.anti_split(ties, spark.createDataFrame([(1,)], "id int"), "id").count() == 4


def test_json_round_trip(spark, ties):
    texts = S.rows_to_json(ties.withColumn("n", F.lit(float("nan"))))
    back = S.records_from_json(texts, "json", "id int, c string, x double, n double", ["id", "x"])
    assert back.count() == 5 and back.where("n IS NULL").count() == 5
    with pytest.raises(ValueError):
        S.records_from_json(texts, "json", "id int", ["x"])


@pytest.mark.parametrize("collide", [False, True])
def test_distinct_counts_equal_count_distinct_without_expand(spark, monkeypatch, collide):
    if collide:
        monkeypatch.setattr(P, "_cell_hash", lambda c: F.xxhash64(c) % 3)
    rows = [(i % 7, None if i % 5 == 0 else f"t{i % 11}", [0.0, -0.0, float("nan"), 1.5][i % 4], [i % 3, None], None) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, `b.c` string, d double, e array<int>, f string").repartition(5)
    want = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    assert P.distinct_counts(df, df.columns) == dict(zip(df.columns, want))
    assert P.distinct_counts(df.limit(0), ["a"]) == {"a": 0}
    facts = P.column_facts(df)
    assert "Expand" not in facts._jdf.queryExecution().toString()
    assert {r["column_name"]: r["unique_count"] for r in facts.collect()} == dict(zip(df.columns, want))


def test_correlations_of_many_columns_in_one_pass(spark):
    rng = np.random.default_rng(3)
    wide = rng.standard_normal((300, 500)) + rng.standard_normal((300, 1)) + 1e7
    wide[:, 7] = 4.25
    wide[rng.random(wide.shape) < 0.1] = np.nan
    wide[:, 11] = np.nan
    wide[1:, 12] = np.nan
    names = [f"c.{i}" for i in range(500)]
    frame = pd.DataFrame(wide, columns=names)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), ", ".join(f"`{c}` double" for c in names)).repartition(6)
    got = P.correlation_matrix(df)
    assert got._jdf.queryExecution().toString().count("Scan ExistingRDD") <= 8
    found = np.full((500, 500), np.nan)
    place = {c: i for i, c in enumerate(names)}
    for r in got.collect():
        if r["correlation"] is not None:
            found[place[r["column_1"]], place[r["column_2"]]] = r["correlation"]
    want = frame.corr(min_periods=2).to_numpy().copy()
    want[7, :], want[:, 7] = np.nan, np.nan
    assert np.allclose(found, want, atol=1e-7, equal_nan=True)
    strong = {(r["column_1"], r["column_2"]) for r in P.strong_pairs(df, names[:40], 0.55).collect()}
    assert strong == {(names[i], names[j]) for i in range(40) for j in range(i + 1, 40) if abs(want[i, j]) > 0.55}


def test_correlations_with_values_that_are_no_numbers(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, float("nan"), 3.0), (None, 1.0, 2.0), (4.0, 3.0, None)], "a double, b double, c double").repartition(3)
    got = {(r["column_1"], r["column_2"]): r["correlation"] for r in P.correlation_matrix(df).collect()}
    want = {(x, y): df.select(F.corr(x, y)).first()[0] for x in "abc" for y in "abc" if x != y}
    assert {k: str(v) if v is None or v != v else round(v, 9) for k, v in got.items() if k[0] != k[1]} == {k: str(v) if v is None or v != v else round(v, 9) for k, v in want.items()}
    assert P.correlation_matrix(df.limit(0)).where("correlation is not null").count() == 0
