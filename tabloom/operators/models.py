"""Training, tuning and scoring with Spark ML.  Preparation and model are one PipelineModel."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, Imputer, IndexToString, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.columns import as_list, numeric_cols, text_cols
from tabloom.operators.evaluate import classification_metrics, performance_band, regression_metrics
from tabloom.operators.features import small_categories
from tabloom.operators.joins import update_by_key
from tabloom.operators.ordered import split_random
from tabloom.sources.tables import bounded_tasks

SEED = 42

# fixed values: model settings per algorithm name
CLASSIFIERS = {
    "Logistic Regression": lambda: LogisticRegression(maxIter=50),
    "Decision Tree": lambda: DecisionTreeClassifier(maxDepth=3, seed=SEED),
    "Naive Bayes": lambda: NaiveBayes(modelType="gaussian"),
    "Random Forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=SEED),
    "Gradient Boosting": lambda: GBTClassifier(maxIter=20, maxDepth=3, seed=SEED),
    "SVM": lambda: LinearSVC(maxIter=100),
    "Neural Network": lambda: MultilayerPerceptronClassifier(maxIter=50, seed=SEED),
}
REGRESSORS = {
    "Linear Regression": lambda: LinearRegression(),
    "Ridge Regression": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0),
    "Lasso Regression": lambda: LinearRegression(regParam=1.0, elasticNetParam=1.0),
    "Decision Tree": lambda: DecisionTreeRegressor(maxDepth=3, seed=SEED),
    "Random Forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=5, seed=SEED),
    "Gradient Boosting": lambda: GBTRegressor(maxIter=20, maxDepth=3, seed=SEED),
}
# fixed values: parameter grids of the search
GRIDS = {
    ("classification", "Logistic Regression"): {"regParam": [0.1, 1.0, 10.0]},
    ("classification", "Random Forest"): {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 20]},
    ("classification", "Gradient Boosting"): {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7]},
    ("classification", "SVM"): {"regParam": [0.1, 1.0, 10.0]},
    ("classification", "Neural Network"): {"stepSize": [0.01, 0.03, 0.1]},
    ("regression", "Ridge Regression"): {"regParam": [0.1, 1.0, 10.0, 100.0]},
    ("regression", "Random Forest"): {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 20]},
    ("regression", "Gradient Boosting"): {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7]},
}
# fixed values: ready-made solutions (algorithm, trees, task, balanced class weights)
SOLUTIONS = {
    "customer_churn": ("Random Forest", 100, "classification", False),
    "fraud_detection": ("Random Forest", 150, "classification", True),
    "demand_forecasting": ("Random Forest", 100, "regression", False),
    "price_optimization": ("Random Forest", 120, "regression", False),
    "sentiment_analysis": ("Logistic Regression", None, "classification", False),
    "recommendation_engine": ("Random Forest", 100, "classification", False),
    "quality_prediction": ("Random Forest", 100, "classification", False),
    "lead_scoring": ("Logistic Regression", None, "classification", False),
}
COMPLEXITY_TREES = {"simple": 50, "advanced": 200}
#: Values of a number per tree feature, as in Spark's trees by default; up to so many distinct values are counted, more are sketched.
BINS, COUNTED_VALUES = 32, 10_000


def algorithms(task: str) -> list[str]:
    return list(CLASSIFIERS if task == "classification" else REGRESSORS)


def prepare_features(df: DataFrame, features, scale: bool = False, max_card: int = 10) -> PipelineModel:
    """Median imputation, one-hot (few values) or index codes, optional scaling.

    The target is not needed, so the fitted preparation scores rows that have none.
    """
    features = as_list(features)
    numbers, texts = numeric_cols(df, features), text_cols(df, features)
    casts = [f"CAST(`{c}` AS DOUBLE) AS `{c}__num`" for c in numbers] + [f"coalesce(`{c}`, 'Unknown') AS `{c}__txt`" for c in texts]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(casts)} FROM __THIS__")]
    inputs = []
    if numbers:
        filled = [f"{c}__fill" for c in numbers]
        stages.append(Imputer(inputCols=[f"{c}__num" for c in numbers], outputCols=filled, strategy="median"))
        inputs += filled
    if texts:
        stages.append(StringIndexer(inputCols=[f"{c}__txt" for c in texts], outputCols=[f"{c}__idx" for c in texts], stringOrderType="alphabetAsc", handleInvalid="keep"))
        few = [c for c in texts if small_categories(df, c, max_card) is not None]
        if few:
            stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in few], outputCols=[f"{c}__hot" for c in few], handleInvalid="keep"))
        inputs += [f"{c}__hot" if c in few else f"{c}__idx" for c in texts]
    raw = "_unscaled" if scale else "features"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=raw, handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True))
    return Pipeline(stages=stages).fit(df)


def _with_label(df: DataFrame, target: str, task: str):
    if task == "regression":
        return df.withColumn("label", F.col(target).cast("double")), None
    text = df.withColumn("_target", F.col(target).cast("string"))
    indexer = StringIndexer(inputCol="_target", outputCol="label", stringOrderType="alphabetAsc").fit(text)
    return indexer.transform(text).drop("_target"), indexer.labels


def _estimator(task: str, algorithm: str, classes: int, width: int):
    est = (CLASSIFIERS if task == "classification" else REGRESSORS)[algorithm]()
    if algorithm == "Neural Network":
        est.setLayers([width, 50, classes])
    if classes > 2 and algorithm in ("Gradient Boosting", "SVM"):
        est = OneVsRest(classifier=est)
    return est


def cut_points(df: DataFrame, columns: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Where each column is cut for trees: between all values, or, beyond ``bins`` values, into about equal shares of the rows.

    The rule is that of Spark's trees, applied to all rows instead of a sample.
    """
    if not columns:
        return {}
    held = [c.replace("`", "``") for c in columns]
    distinct = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"n{i}") for i, c in enumerate(held)]).first()
    few = [c for i, c in enumerate(held) if distinct[f"n{i}"] <= COUNTED_VALUES]
    many = [c for c in held if c not in few]
    cuts = {c: _cuts(df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v is not null and not isnan(v)").collect(), bins) for c in few}
    if many:
        sketched = df.approxQuantile([c.replace("``", "`") for c in many], [i / bins for i in range(1, bins)], 1e-4)
        cuts |= {c: sorted({float(x) for x in found}) for c, found in zip(many, sketched)}
    return {c: cuts[h] for c, h in zip(columns, held)}


def _cuts(counted, bins: int) -> list[float]:
    values = sorted((r["v"], r["n"]) for r in counted)
    middle = [(a + b) / 2 for (a, _), (b, _) in zip(values, values[1:])]
    if len(middle) < bins:
        return middle
    stride = sum(n for _, n in values) / bins
    cuts, seen, target = [], values[0][1], stride
    for cut, (_, n) in zip(middle, values[1:]):
        if abs(seen - target) < abs(seen + n - target):
            cuts.append(cut)
            target += stride
        seen += n
    return cuts


def _binned(df: DataFrame, prep: PipelineModel, labelled: DataFrame) -> tuple[list, DataFrame]:
    """Stages that turn prepared rows into ``bins``, and the rows with it.

    ``bins`` has the positions of ``features``; a number is the place of its bin, so it takes at most BINS values.
    """
    inputs = next(s for s in prep.stages if isinstance(s, VectorAssembler)).getInputCols()
    cuts = {c: found for c, found in cut_points(labelled, [c for c in inputs if c.endswith("__fill")]).items() if found}
    # a tree goes left at a cut itself, a bucket begins there
    edges = [[-math.inf, *[math.nextafter(x, math.inf) for x in found], math.inf] for found in cuts.values()]
    stages = []
    if cuts:
        stages.append(Bucketizer(inputCols=list(cuts), outputCols=[f"{c}__bucket" for c in cuts], splitsArray=edges, handleInvalid="keep"))
        # a plain number again: buckets are marked as categories, which trees don't keep in order
        places = [f"least(`{c}__bucket`, {len(found)}D) AS `{c}__bin`" for c, found in cuts.items()]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(places)} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=[f"{c}__bin" if c in cuts else c for c in inputs], outputCol="bins", handleInvalid="keep"))
    stages = Pipeline(stages=stages).fit(labelled).stages
    return stages, PipelineModel(stages=stages).transform(labelled)


def _weighted_bins(binned: DataFrame, task: str, weight: str | None = None) -> DataFrame:
    """(bins, label, _weight): rows of equal bins as one, whose label is their mean in a regression.

    Trees see nothing of a number but its bin, and the gain of a split by squared error depends on labels by their
    sums alone, so the trees are those of all rows.  The result is bounded by the bins, whatever the number of rows.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    if task == "regression":
        label = F.coalesce("label", F.lit(math.nan))  # a label that is no number still stops the fit
        return binned.groupBy("bins").agg((F.sum(label * w) / F.sum(w)).alias("label"), F.sum(w).alias("_weight"))
    return binned.groupBy("bins", "label").agg(F.sum(w).alias("_weight"))


def _on_bins(est, rows: DataFrame):
    """The estimator for weighted bins, and these in rows enough.

    Trees look for cuts in a sample of maxBins squared rows, which shall hold all bins, and want as many rows as a
    column has categories, so that few rows are dealt out as equal parts.
    """
    n = rows.count()
    if n < BINS:
        rows = rows.withColumn("_weight", F.col("_weight") / BINS).withColumn("_part", F.explode(F.sequence(F.lit(1), F.lit(BINS)))).drop("_part")
    trees = est.getClassifier() if isinstance(est, OneVsRest) else est
    trees.setMaxBins(max(BINS, math.isqrt(n) + 1))
    return est.copy({est.featuresCol: "bins", est.weightCol: "_weight"}), rows


def _width(prepared: DataFrame) -> int:
    row = prepared.select("features").first()
    return row["features"].size if row else 0


def train(df: DataFrame, features, target: str, algorithm: str, task: str = "classification", scale: bool = False, balanced: bool = False, trees: int | None = None) -> PipelineModel:
    """Fit preparation and model; the result scores raw rows and decodes labels to ``predicted``."""
    clean = df.where(F.col(target).isNotNull())
    prep = prepare_features(clean, features, scale or algorithm in ("SVM", "Neural Network"))
    labelled, labels = _with_label(prep.transform(clean), target, task)
    est = _estimator(task, algorithm, len(labels or []), _width(labelled))
    if trees is not None and est.hasParam("numTrees"):
        est = est.copy({est.numTrees: trees})
    if balanced and labels:
        counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = sum(counts.values())
        weight = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, n / (len(counts) * v))])
        labelled = labelled.withColumn("_weight", weight[F.col("label")])
        est = est.copy({est.weightCol: "_weight"})
    # iterative fits read their rows many times: keep only what they need, and in tasks of bounded size
    weights = ["_weight"] if "_weight" in labelled.columns else []
    stages, kept = [*prep.stages], labelled.select("features", "label", *weights)
    if algorithm == "Gradient Boosting":
        made, binned = _binned(clean, prep, labelled)
        stages += made
        cells = _weighted_bins(binned, task, *weights).persist()
        est, kept = _on_bins(est, cells)
    rows = bounded_tasks(kept).persist()
    stages.append(est.fit(rows))
    rows.unpersist()
    if algorithm == "Gradient Boosting":
        cells.unpersist()
    if labels:
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted", labels=labels))
    return PipelineModel(stages=stages)


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Input columns with the decoded prediction and, where the model has it, the winning probability.

    Works on batch and on streaming frames.
    """
    out = model.transform(df)
    made = {"prediction_value": F.col("predicted") if "predicted" in out.columns else F.col("prediction")}
    if "probability" in out.columns:
        made["probability_value"] = F.array_max(vector_to_array("probability"))
    return out.withColumns(made).select(*df.columns, *made)


def evaluate(df: DataFrame, model: PipelineModel, target: str, task: str) -> dict:
    scored = score(df.where(F.col(target).isNotNull()), model)
    if task == "classification":
        return classification_metrics(scored.withColumn("_t", F.col(target).cast("string")), "_t", "prediction_value").first().asDict()
    return regression_metrics(scored, target, "prediction_value").first().asDict()


def main_score(metrics: dict) -> float:
    return metrics["accuracy"] if "accuracy" in metrics else metrics["r2_score"]


def _split(df: DataFrame, keys, target: str, task: str, frac: float = 0.2):
    marked = split_random(df.where(F.col(target).isNotNull()), keys, frac, SEED, stratify=target if task == "classification" else ())
    return marked.where("split = 'train'").drop("split"), marked.where("split = 'test'").drop("split")


def cross_validate(df: DataFrame, keys, features, target: str, algorithm: str, task: str = "classification", k: int = 5) -> DataFrame:
    """Score of each fold, then mean, population deviation, minimum and maximum."""
    folded = df.withColumn("_fold", F.pmod(F.xxhash64(*as_list(keys)), F.lit(k))).persist()
    scores = []
    for i in range(k):
        model = train(folded.where(F.col("_fold") != i).drop("_fold"), features, target, algorithm, task)
        scores.append(float(main_score(evaluate(folded.where(F.col("_fold") == i).drop("_fold"), model, target, task))))
    folded.unpersist()
    mean = sum(scores) / k
    rows = [(f"fold_{i + 1}", s) for i, s in enumerate(scores)]
    rows += [("mean", mean), ("std", (sum((s - mean) ** 2 for s in scores) / k) ** 0.5), ("min", min(scores)), ("max", max(scores))]
    return df.sparkSession.createDataFrame(rows, "item string, score double")


def grid_search(df: DataFrame, features, target: str, algorithm: str, task: str = "classification", grid: dict | None = None, folds: int = 3, parallelism: int = 4) -> DataFrame:
    """Mean score of every parameter combination, best first."""
    clean = df.where(F.col(target).isNotNull())
    prep = prepare_features(clean, features, algorithm in ("SVM", "Neural Network"))
    labelled, labels = _with_label(prep.transform(clean), target, task)
    est = _estimator(task, algorithm, len(labels or []), _width(labelled))
    grid = grid if grid is not None else GRIDS.get((task, algorithm), {})
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), values)
    judge = MulticlassClassificationEvaluator(metricName="accuracy") if task == "classification" else RegressionEvaluator(metricName="r2")
    search = CrossValidator(estimator=est, estimatorParamMaps=builder.build(), evaluator=judge, numFolds=folds, parallelism=parallelism, seed=SEED)
    # every fold of every combination reads the same rows
    rows = labelled.select("features", "label").persist()
    search = search.fit(rows)
    rows.unpersist()
    found = [(", ".join(f"{p.name}={v}" for p, v in m.items()), float(s)) for m, s in zip(builder.build(), search.avgMetrics)]
    return df.sparkSession.createDataFrame(sorted(found, key=lambda r: -r[1]), "params string, mean_score double")


def feature_names(model: PipelineModel, sample: DataFrame) -> list[str]:
    """Names of the vector positions, from the assembler's metadata."""
    meta = model.transform(sample.limit(1)).schema["features"].metadata
    if "ml_attr" not in meta or "attrs" not in meta["ml_attr"]:
        return []
    attrs = [a for group in meta["ml_attr"]["attrs"].values() for a in group]
    return [a["name"] for a in sorted(attrs, key=lambda a: a["idx"])]


def feature_importance(model: PipelineModel, sample: DataFrame, k: int = 20) -> DataFrame:
    """Tree importances or absolute coefficients, best k."""
    fitted = next(s for s in model.stages if hasattr(s, "featureImportances") or hasattr(s, "coefficientMatrix") or hasattr(s, "coefficients"))
    if hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    elif hasattr(fitted, "coefficientMatrix"):
        values = abs(fitted.coefficientMatrix.toArray()).mean(axis=0)
    else:
        values = abs(fitted.coefficients.toArray())
    names = feature_names(model, sample) or [f"feature_{i}" for i in range(len(values))]
    rows = sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda r: (-r[1], r[0]))[:k]
    return sample.sparkSession.createDataFrame(rows, "feature string, importance double")


def compare_models(df: DataFrame, keys, features, target: str, task: str = "classification", names=None) -> DataFrame:
    """Test metrics of several algorithms; one that fails becomes an error row; the best is marked."""
    train_df, test_df = [p.persist() for p in _split(df, keys, target, task)]
    rows = []
    for name in names or algorithms(task):
        try:
            m = evaluate(test_df, train(train_df, features, target, name, task), target, task)
            rows.append((name, float(main_score(m)), None))
        except Exception as exc:  # a failing model must not stop the comparison
            rows.append((name, None, str(exc).splitlines()[0][:200]))
    train_df.unpersist()
    test_df.unpersist()
    known = [r[1] for r in rows if r[1] is not None]
    best = max(known) if known else None
    return df.sparkSession.createDataFrame([(*r, r[1] is not None and r[1] == best) for r in rows], "model string, score double, error string, is_best boolean")


def attach_predictions(df: DataFrame, keys, model: PipelineModel, target: str, test: DataFrame, task: str) -> DataFrame:
    """Predictions for the test rows put next to all rows, with the error or match and the split mark."""
    scored = score(test, model)
    cols = ["prediction_value"] + (["probability_value"] if "probability_value" in scored.columns else [])
    out = update_by_key(df, scored.withColumn("data_split", F.lit("test")), keys, [*cols, "data_split"])
    out = out.withColumn("data_split", F.coalesce("data_split", F.lit("train")))
    if task == "classification":
        return out.withColumn("prediction_correct", F.col(target).cast("string") == F.col("prediction_value"))
    return out.withColumn("prediction_error", F.abs(F.col(target) - F.col("prediction_value")))


def train_report(df: DataFrame, keys, features, target: str, algorithm: str, task: str = "classification", folds: int = 5) -> DataFrame:
    """Rows (section, item, score): test metrics, cross-validation, importances and the band."""
    train_df, test_df = [p.persist() for p in _split(df, keys, target, task)]
    model = train(train_df, features, target, algorithm, task)
    metrics = evaluate(test_df, model, target, task)
    spark = df.sparkSession
    rows = [("metric", k, float(v)) for k, v in metrics.items() if v is not None]
    level = spark.createDataFrame([(float(main_score(metrics)),)], "v double").select(performance_band(F.col("v"), task)).first()[0]
    out = spark.createDataFrame([*rows, ("performance", level, float(main_score(metrics)))], "section string, item string, score double")
    cv = cross_validate(df, keys, features, target, algorithm, task, folds).select(F.lit("cross_validation"), "item", "score")
    out = out.union(cv)
    if algorithm not in ("Naive Bayes", "Neural Network"):
        out = out.union(feature_importance(model, train_df).select(F.lit("importance"), "feature", "importance"))
    train_df.unpersist()
    test_df.unpersist()
    return out


def solution(df: DataFrame, kind: str, keys, features, target: str, complexity: str = "auto") -> DataFrame:
    """Train a ready-made solution and attach its test predictions to the rows."""
    algorithm, trees, task, balanced = SOLUTIONS.get(kind, SOLUTIONS["customer_churn"])
    if trees is not None:
        trees = COMPLEXITY_TREES.get(complexity, trees)
    train_df, test_df = _split(df, keys, target, task)
    model = train(train_df, features, target, algorithm, task, balanced=balanced, trees=trees)
    return attach_predictions(df, keys, model, target, test_df, task)


def auto_forest(df: DataFrame, keys, features, target: str) -> DataFrame:
    """A forest of 50 trees: regression for a number with more than 10 values, else classification."""
    numeric = bool(numeric_cols(df, [target])) and small_categories(df, target, 10) is None
    task = "regression" if numeric else "classification"
    train_df, test_df = _split(df, keys, target, task)
    model = train(train_df, features, target, "Random Forest", task, trees=50)
    metrics = evaluate(test_df, model, target, task)
    return df.sparkSession.createDataFrame([(task, "Random Forest", float(main_score(metrics)))], "task string, model string, score double")
