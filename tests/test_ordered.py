import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.operators import ordered as O
from tabloom.operators import quantiles as Q


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, values repeat and some are null."""
    df = spark.range(400).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 2 == 0, "b").otherwise(F.lit(None)).alias("g"),
        F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 101).cast("double")).alias("v"),
    )
    return df.repartition(5).cache()


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


@pytest.mark.parametrize("block", [3, 17, 1000])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_block_windows_equal_plain_windows(skewed, block, by):
    w = Window.partitionBy(*by).orderBy("k")
    plain = skewed.select(
        "k",
        F.lag("v", 1).over(w).alias("v_lag_1"),
        F.lag("v", 2).over(w).alias("v_lag_2"),
        F.round(F.avg("v").over(w.rowsBetween(-2, 0)), 9).alias("m"),
        F.when(F.col("v").isNotNull(), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("v_cumsum"),
        F.when(F.col("v").isNotNull(), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("v_cummax"),
    )
    lagged = O.lags(skewed, "v", "k", (1, 2), by, block)
    rolled = O.rolling_stats(skewed, "v", "k", 3, by, block)
    summed = O.cumulative(skewed, "v", "k", by, block)
    assert rows(lagged, "k", "v_lag_1", "v_lag_2") == rows(plain, "k", "v_lag_1", "v_lag_2")
    assert rows(rolled.withColumn("m", F.round("v_rolling_mean_3", 9)), "k", "m") == rows(plain, "k", "m")
    assert rows(summed, "k", "v_cumsum", "v_cummax") == rows(plain, "k", "v_cumsum", "v_cummax")


def test_row_index_is_gapless_per_group(skewed):
    w = Window.partitionBy("g").orderBy("k")
    plain = skewed.select("k", (F.row_number().over(w) - 1).cast("bigint").alias("row_index"))
    assert rows(O.row_index(skewed, "k", "g"), "k", "row_index") == rows(plain, "k", "row_index")


def test_percentile_rank_averages_ties(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 20.0), (4, None)], "k int, v double")
    got = {r["k"]: r["v_percentile_rank"] for r in O.percentile_rank(df, "v", block_rows=1).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 1.0, 4: None}


def test_constant_column_has_null_zscore(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [r["v_zscore"] for r in O.zscore(df, "v").collect()] == [None, None]


def test_dedupe_keeps_first_and_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "k int, c string")
    assert sorted(r["k"] for r in O.dedupe_first(df, "c", "k").collect()) == [1, 3]


def test_splits_partition_the_table(skewed):
    by_order = O.split_by_order(skewed, "k", 0.7)
    assert by_order.where("drift_period = 'Reference'").count() == 280
    assert by_order.where("drift_period = 'Reference'").agg(F.max("k")).first()[0] == 279
    strat = O.split_random(skewed, "k", 0.25, stratify="g")
    assert strat.count() == 400
    for r in strat.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert r["t"] == -(-r["n"] // 4)


@pytest.mark.parametrize("limit", [1, 7, 50, 100_000])
def test_exact_quantiles_at_every_limit(skewed, limit):
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    values = np.array([r["v"] for r in skewed.where("v IS NOT NULL").collect()])
    got = Q.exact_quantiles(skewed, ["v", "k"], probs, limit)
    assert np.allclose(got["v"], np.quantile(values, probs))
    assert np.allclose(got["k"], np.quantile(np.arange(400), probs))


def test_quantiles_on_wide_values_narrow_and_on_empty_are_null(spark):
    df = spark.range(20_000).select((F.col("id") * F.col("id")).cast("double").alias("v"), F.lit(None).cast("double").alias("e"), F.lit(3.0).alias("c"))
    got = Q.exact_quantiles(df, ["v", "e", "c"], [0.25, 0.5], limit=50)
    assert np.allclose(got["v"], np.quantile(np.arange(20_000.0) ** 2, [0.25, 0.5]))
    assert got["e"] == [None, None] and got["c"] == [3.0, 3.0]


def test_quantiles_by_group(skewed):
    got = {r["g"]: (r["q0"], r["q1"]) for r in Q.quantiles_by(skewed, "g", "v", [0.25, 0.5]).collect()}
    want = skewed.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5))).alias("q")).collect()
    assert got == {r["g"]: tuple(r["q"]) for r in want}


def test_split_with_repeated_keys_keeps_the_exact_share(spark):
    df = spark.createDataFrame([(i // 4, i) for i in range(10)], "k int, v int")
    assert O.split_by_order(df, "k", 0.5).where("drift_period = 'Reference'").count() == 5
    assert O.split_by_order(df, "k", 0.0).where("drift_period = 'Current'").count() == 10
    assert O.split_by_order(df, ["k", "v"], 1.0).where("drift_period = 'Reference'").count() == 10
