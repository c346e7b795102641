"""Model quality from (label, prediction) rows, feature scores and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.columns import as_list, long_rows
from tabloom.functions.scalars import band
from tabloom.operators import boxes
from tabloom.operators.ordered import running_total
from tabloom.session import cut_lineage


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("row_count"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every class; a zero divisor gives 0."""
    counts = confusion_matrix(pred, label, prediction)
    hit = F.col("label") == F.col("prediction")
    by_label = counts.groupBy(F.col("label").alias("class")).agg(F.sum("row_count").alias("support"), F.sum(F.when(hit, F.col("row_count")).otherwise(0)).alias("tp"))
    by_pred = counts.groupBy(F.col("prediction").alias("class")).agg(F.sum("row_count").alias("predicted"))
    both = by_label.join(by_pred, "class", "full").na.fill(0, ["support", "tp", "predicted"])
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    out = both.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1_score", f1).select("class", "precision", "recall", "f1_score", "support")


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1.  One row."""
    per_class = classification_report(pred, label, prediction)
    w = F.col("support")

    def mean(c):
        return F.try_divide(F.sum(F.col(c) * w), F.sum(w))

    # weighted recall is the accuracy: both are hits over rows
    return per_class.agg(mean("recall").alias("accuracy"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("f1_score").alias("f1_score"))


def roc_curve(pred: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One point per distinct score, highest first, and the start point; label is 0/1."""
    counts = pred.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label)).cast("bigint").alias("p"), F.sum(1 - F.col(label)).cast("bigint").alias("n"))
    run = running_total(counts.withColumn("_desc", -F.col("threshold")), "_desc", {"cp": ("p", "sum"), "cn": ("n", "sum")})
    whole = run.agg(F.max("cp").alias("p"), F.max("cn").alias("n")).first()
    points = run.select("threshold", F.try_divide("cn", F.lit(whole["n"])).alias("fpr"), F.try_divide("cp", F.lit(whole["p"])).alias("tpr"))
    start = pred.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.union(points)


def auc(pred: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Area under the ROC curve (trapezoids): each negative counts the positives above it, ties half."""
    counts = pred.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label)).cast("bigint").alias("p"), F.sum(1 - F.col(label)).cast("bigint").alias("n"))
    run = running_total(counts.withColumn("_desc", -F.col("s")), "_desc", {"cp": ("p", "sum")})
    above = F.col("cp") - F.col("p") + F.col("p") / 2
    return run.agg(F.try_divide(F.sum(F.col("n") * above), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    e = F.col(label) - F.col(prediction)
    return pred.agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(label))).alias("r2_score"),
        F.avg(F.abs(e)).alias("mae"),
    )


def residuals(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.withColumn("residual", F.col(label) - F.col(prediction))


def performance_band(value: Column, task: str, strict: bool = False) -> Column:
    # fixed values: accuracy and r2 cuts of the bands
    cuts = [0.9, 0.8, 0.7] if task == "classification" else [0.9, 0.7, 0.5] if strict else [0.8, 0.6, 0.4]
    return band(value, cuts, ["Excellent", "Good", "Fair", "Poor"])


def select_k_best(df: DataFrame, features, target: str, task: str = "classification", k: int = 20) -> DataFrame:
    """F value of each feature against the target (ANOVA or regression), best k."""
    features = as_list(features)
    clean = df.where(F.col(target).isNotNull())
    if task == "regression":
        wide = clean.agg(*[F.corr(c, target).alias(f"r{i}") for i, c in enumerate(features)], *[F.count(F.when(F.col(c).isNotNull(), F.col(target))).alias(f"n{i}") for i, c in enumerate(features)])
        f_values = [F.try_divide(F.col(f"r{i}") ** 2 * (F.col(f"n{i}") - 2), 1 - F.col(f"r{i}") ** 2) for i in range(len(features))]
    else:
        per_class = clean.groupBy(target).agg(
            *[f(c).alias(f"{p}{i}") for i, c in enumerate(features) for p, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
        )
        parts = []
        for i in range(len(features)):
            n, m, v = F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"v{i}")
            parts += [F.sum(n * v).alias(f"w{i}"), F.sum(n).alias(f"t{i}"), F.count_if(n > 0).alias(f"k{i}"), (F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)).alias(f"b{i}")]
        wide = per_class.agg(*parts)
        f_values = [F.try_divide(F.col(f"b{i}") / (F.col(f"k{i}") - 1), F.col(f"w{i}") / (F.col(f"t{i}") - F.col(f"k{i}"))) for i in range(len(features))]
    rows = [F.struct(F.lit(c).alias("feature"), f.alias("f_value")) for c, f in zip(features, f_values)]
    return long_rows(wide, rows).orderBy(F.desc_nulls_last("f_value"), "feature").limit(k)


#: Test rows that one task compares with a leaf, at most about.
_ASKED = 50_000


def _leaf_nearest(d: int, k: int, out: str):
    """Rows in the order of (leaf, salt, kind): a leaf's training points come before the test points."""

    def told(queries: list, neighbours, near, places) -> pa.RecordBatch:
        columns = [pa.array(np.repeat(np.array(queries), places.shape[1] if len(queries) else 0)), neighbours, pa.array(near)]
        return pa.RecordBatch.from_arrays(columns, names=["q", out, "square"])

    def run(batches):
        at, held, points, keys = None, [], None, None
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            spot = np.stack([columns[c].to_numpy() for c in ("leaf", "salt", "kind")]).T
            x = np.stack([columns[f"x{i}"].to_numpy() for i in range(d)], axis=1) if len(spot) else np.zeros((0, d))
            starts = np.flatnonzero(np.append(True, (spot[1:] != spot[:-1]).any(axis=1))) if len(spot) else []
            for start, end in zip(starts, [*starts[1:], len(spot)]):
                if tuple(spot[start][:2]) != at:
                    at, held, points = tuple(spot[start][:2]), [], None
                if spot[start][2] == 0:
                    held.append((x[start:end], columns[out].slice(start, end - start)))
                    continue
                if points is None and held:
                    points, keys = np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
                    order = pc.sort_indices(keys)  # equal distances go to the smaller key
                    points, keys = points[order.to_numpy()], keys.take(order)
                if points is None:
                    continue
                square = np.zeros((end - start, len(points)))
                for i in range(d):
                    step = x[start:end, i, None] - points[None, :, i]
                    square += step * step
                places = np.argsort(square, axis=1, kind="stable")[:, :k]
                near = np.take_along_axis(square, places, axis=1)
                yield told(columns["q"].to_numpy()[start:end], keys.take(pa.array(places.ravel())), near.ravel(), places)

    return run


def _in_leaves(points: DataFrame, asked: DataFrame, d: int, k: int, key_type: str) -> DataFrame:
    """(q, neighbour, square): the k nearest points of its leaf for each (q, leaf) of ``asked``."""
    xs = [f"x{i}" for i in range(d)]
    busy = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / _ASKED).alias("salts"))
    rows = points.join(busy, "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    rows = rows.select("leaf", "salt", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("q"), "neighbour", *xs)
    dealt = asked.join(busy, "leaf").withColumn("salt", F.pmod(F.xxhash64("q"), F.col("salts")))
    dealt = dealt.select("leaf", "salt", F.lit(1).alias("kind"), "q", F.lit(None).cast(key_type).alias("neighbour"), *xs)
    together = rows.unionByName(dealt).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "kind")
    return together.mapInArrow(_leaf_nearest(d, k, "neighbour"), f"q long, neighbour {key_type}, square double")


def nearest_neighbours(train: DataFrame, test: DataFrame, key: str, features, k: int = 3, leaf: int = boxes.LEAF) -> DataFrame:
    """(key, neighbour, distance, rank): the exact k nearest training rows of each test row; ties go to the smaller key.

    Training rows lie in the leaves of a box tree whose depth follows their number.  A test row first meets
    the leaf where it falls itself; the k-th distance there is a radius, and only leaves whose box lies within it are
    searched, too.  So the pairs that are compared per test row don't grow with the table.  Of training
    rows at one point only the first k keys are kept, and test rows at one point are asked once.
    """
    features = as_list(features)
    d, xs = len(features), [f"x{i}" for i in range(len(features))]
    key_type = dict(train.dtypes)[key]
    tr = train.select(F.col(key).alias("neighbour"), *[F.col(c).cast("double").alias(x) for c, x in zip(features, xs)]).na.drop()
    te = test.select(F.col(key).alias("_k"), *[F.col(c).cast("double").alias(x) for c, x in zip(features, xs)]).na.drop()
    first = Window.partitionBy(*xs).orderBy("neighbour")
    tr = tr.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")
    points = tr.withColumn("_train", F.lit(1)).unionByName(te.select(*xs).distinct().select(F.lit(None).cast(key_type).alias("neighbour"), *xs, F.lit(0).alias("_train")))
    placed = running_total(points.withColumn("_z", boxes.curve(points, xs)), ["_z", *xs, "_train", "neighbour"], {"_upto": ("_train", "sum")})
    placed = cut_lineage(placed.withColumn("q", F.monotonically_increasing_id()))
    leaf = max(leaf, k)
    leaves = max((placed.agg(F.max("_upto")).first()[0] or 0) // leaf, 1)
    home = F.least(F.floor(F.greatest(F.col("_upto") - 1, F.lit(0)) / leaf), F.lit(leaves - 1)).cast("long")
    placed = placed.withColumn("leaf", home)
    known, asked = placed.where("_train = 1").select("neighbour", *xs, "leaf"), placed.where("_train = 0").select("q", *xs, "leaf")
    at_home = cut_lineage(_in_leaves(known, asked, d, k, key_type))
    # a leaf holds at least k rows unless the table has fewer than two leaves
    reach = at_home.groupBy("q").agg((F.max("square") * (1 + 1e-9)).alias("reach"), F.count(F.lit(1)).alias("_n"))
    searching = asked.join(reach, "q").select("q", *xs, F.col("leaf").alias("_home"), F.when(F.col("_n") < k, F.lit(float("inf"))).otherwise(F.col("reach")).alias("reach"))
    sides = [f(f"x{i}").alias(f"{e}{i}") for i in range(d) for e, f in (("lo", F.min), ("hi", F.max))]
    tree = boxes.levels(known.groupBy(F.col("leaf").alias("node")).agg(*sides), d)
    away = cut_lineage(boxes.reached_leaves(tree, searching, d).where(F.col("leaf") != F.col("_home")).select("q", *xs, "leaf"))
    found = at_home.unionByName(_in_leaves(known, away, d, k, key_type))
    order = Window.partitionBy("q").orderBy("square", "neighbour")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = asked.select("q", *xs).join(best, "q").drop("q")
    return te.join(named, xs).select(F.col("_k").alias(key), "neighbour", F.sqrt("square").alias("distance"), "rank")


def knn_predict(train: DataFrame, test: DataFrame, key: str, features, target: str, k: int = 3, task: str = "classification", **opts) -> DataFrame:
    """Majority vote (ties to the smaller label) or mean of the k nearest training rows."""
    near = nearest_neighbours(train, test, key, features, k, **opts)
    voted = near.join(train.select(F.col(key).alias("neighbour"), F.col(target).alias("_y")), "neighbour")
    if task == "regression":
        return voted.groupBy(key).agg(F.avg("_y").alias("prediction"))
    votes = voted.groupBy(key, "_y").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(key).orderBy(F.desc("_n"), "_y")
    return votes.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(key, F.col("_y").alias("prediction"))
