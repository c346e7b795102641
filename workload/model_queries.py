"""Evaluation with SQL twins; training and scoring as rows-only checks."""

from pyspark.sql import functions as F

from tabloom.operators import evaluate as V
from tabloom.operators import models as ML
from tabloom.operators import rules as R
from tabloom.operators.ordered import split_random
from tabloom.sources.tables import load_model, save_model
from tabloom.session import shared_path
from workload.registry import query, union_all

_FLAGS = "(SELECT l_returnflag AS label, CASE WHEN l_quantity > 34 THEN 'N' WHEN l_quantity > 17 THEN 'R' ELSE 'X' END AS prediction FROM lineitem)"


def flags(t):
    q = F.col("l_quantity")
    return t.lineitem.select(F.col("l_returnflag").alias("label"), F.when(q > 34, "N").when(q > 17, "R").otherwise("X").alias("prediction"))


@query("confusion_matrix", f"SELECT label, prediction, count(*) AS row_count FROM {_FLAGS} f GROUP BY 1, 2")
def _(t):
    return V.confusion_matrix(flags(t))


_REPORT = (
    f"SELECT class, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score, support FROM (SELECT c AS class, "
    f"coalesce(count(*) FILTER (label = c AND prediction = c) / nullif(count(*) FILTER (prediction = c), 0), 0) AS precision, coalesce(count(*) FILTER (label = c AND prediction = c) / nullif(count(*) FILTER (label = c), 0), 0) AS recall, count(*) FILTER (label = c) AS support "
    f"FROM {_FLAGS} f, (SELECT DISTINCT c FROM (SELECT label AS c FROM {_FLAGS} a UNION SELECT prediction FROM {_FLAGS} b)) k GROUP BY c)"
)


@query("classification_report", _REPORT, rnd={6: "precision recall f1_score"})
def _(t):
    return V.classification_report(flags(t))


@query(
    "classification_metrics",
    f"SELECT (SELECT avg(CAST(label = prediction AS INTEGER)) FROM {_FLAGS} f) AS accuracy, sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall, sum(f1_score * support) / sum(support) AS f1_score FROM ({_REPORT})",
    rnd={6: "accuracy precision recall f1_score"},
)
def _(t):
    return V.classification_metrics(flags(t))


_SCORED = "(SELECT quality AS label, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))"
_CUM = f"(SELECT score, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, p, n, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM {_SCORED} s GROUP BY 1))"


def scored(t):
    return t.labels.join(t.documents, "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"))


@query("roc_curve", f"SELECT NULL::DOUBLE AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr UNION ALL SELECT score, cn / tn, cp / tp FROM {_CUM} c", rnd={8: "fpr tpr"})
def _(t):
    return V.roc_curve(scored(t), "score")


@query("auc", f"SELECT sum(n * (cp - p + p / 2)) / (max(tp) * max(tn)) AS auc FROM {_CUM} c", rnd={8: "auc"})
def _(t):
    return V.auc(scored(t), "score")


_REG = "(SELECT l_extendedprice AS label, l_quantity * 1500 AS prediction FROM lineitem)"


def priced(t):
    return t.lineitem.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))


@query(
    "regression_metrics",
    f"SELECT avg(pow(label - prediction, 2)) AS mse, sqrt(avg(pow(label - prediction, 2))) AS rmse, 1 - sum(pow(label - prediction, 2)) / (var_pop(label) * count(*)) AS r2_score, avg(abs(label - prediction)) AS mae FROM {_REG} r",
    rnd={0: "mse", 4: "rmse mae", 6: "r2_score"},
)
def _(t):
    return V.regression_metrics(priced(t))


@query("residuals", f"SELECT *, label - prediction AS residual FROM {_REG} r")
def _(t):
    return V.residuals(priced(t))


@query(
    "performance_band",
    "SELECT p_partkey, CASE WHEN v >= 0.9 THEN 'Excellent' WHEN v >= 0.8 THEN 'Good' WHEN v >= 0.7 THEN 'Fair' ELSE 'Poor' END AS accuracy_band, CASE WHEN v >= 0.8 THEN 'Excellent' WHEN v >= 0.6 THEN 'Good' WHEN v >= 0.4 THEN 'Fair' ELSE 'Poor' END AS r2_band FROM (SELECT p_partkey, p_size / 50 AS v FROM part)",
)
def _(t):
    v = F.col("p_size") / 50
    return t.part.select("p_partkey", V.performance_band(v, "classification").alias("accuracy_band"), V.performance_band(v, "regression").alias("r2_band"))


def anova(c):
    return (
        f"SELECT '{c}' AS feature, (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_value FROM (SELECT l_returnflag, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY 1), (SELECT avg({c}) AS g FROM lineitem)"
    )


_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("select_k_best_classification", union_all(anova(c) for c in _FEATS), rnd={5: "f_value"})
def _(t):
    return V.select_k_best(t.lineitem, _FEATS, "l_returnflag")


@query(
    "select_k_best_regression",
    union_all(f"SELECT '{c}' AS feature, pow(corr({c}, l_extendedprice), 2) * (count(*) - 2) / (1 - pow(corr({c}, l_extendedprice), 2)) AS f_value FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
    rnd={5: "f_value"},
)
def _(t):
    return V.select_k_best(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "regression")


_SPLIT = "(SELECT *, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || '|42'), c_custkey) <= ceil(count(*) OVER () * 0.2) AS is_test FROM customer)"
_NEAR = (
    f"(SELECT a.c_custkey, b.c_custkey AS neighbour, b.c_mktsegment AS seg, b.c_acctbal AS bal, sqrt(pow(a.c_acctbal - b.c_acctbal, 2) + pow(a.c_nationkey - b.c_nationkey, 2)) AS distance, "
    f"CAST(row_number() OVER (PARTITION BY a.c_custkey ORDER BY sqrt(pow(a.c_acctbal - b.c_acctbal, 2) + pow(a.c_nationkey - b.c_nationkey, 2)), b.c_custkey) AS INTEGER) AS rank FROM {_SPLIT} a, {_SPLIT} b WHERE a.is_test AND NOT b.is_test QUALIFY rank <= 3)"
)


def customers(t):
    marked = split_random(t.customer, "c_custkey", 0.2, 42)
    return marked.where("split = 'train'").drop("split"), marked.where("split = 'test'").drop("split")


@query("nearest_neighbours", f"SELECT c_custkey, neighbour, distance, rank FROM {_NEAR} n", rnd={6: "distance"})
def _(t):
    return V.nearest_neighbours(*customers(t), "c_custkey", ["c_acctbal", "c_nationkey"], 3)


@query("knn_classify", f"SELECT c_custkey, seg AS prediction FROM (SELECT c_custkey, seg, row_number() OVER (PARTITION BY c_custkey ORDER BY count(*) DESC, seg) AS r FROM {_NEAR} n GROUP BY 1, 2) WHERE r = 1")
def _(t):
    return V.knn_predict(*customers(t), "c_custkey", ["c_acctbal", "c_nationkey"], "c_mktsegment", 3)


@query("knn_regress", f"SELECT c_custkey, avg(bal) AS prediction FROM {_NEAR} n GROUP BY 1", rnd={6: "prediction"})
def _(t):
    return V.knn_predict(*customers(t), "c_custkey", ["c_acctbal", "c_nationkey"], "c_acctbal", 3, "regression")


# ---- training: labelled documents (two classes), return flags (three classes), prices (regression)
def quality_docs(t):
    return t.labels.join(t.documents, "doc_id").select("doc_id", "quality", "lang", "source", "n_chars", F.size(F.split("text", r"\s+")).alias("n_words"))


DOC_FEATS = ["lang", "source", "n_chars", "n_words"]
PRICE_FEATS = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def _register_training(name, algorithm, task):
    @query(name)
    def _(t):
        df, target, feats = (quality_docs(t), "quality", DOC_FEATS) if task == "classification" else (t.wide("lineitem"), "l_extendedprice", PRICE_FEATS)
        return ML.score(df, ML.train(df, feats, target, algorithm, task)).select(target, *["prediction_value"])


for _task in ("classification", "regression"):
    for _name in ML.algorithms(_task):
        _register_training(f"train_{_task}_{_name.lower().replace(' ', '_')}", _name, _task)


@query("train_three_classes")
def _(t):
    df = t.wide("lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_returnflag")
    return ML.score(df, ML.train(df, ["l_quantity", "l_discount", "l_tax", "l_linestatus"], "l_returnflag", "Gradient Boosting"))


@query("prepare_features")
def _(t):
    from pyspark.ml.functions import vector_to_array

    df = quality_docs(t)
    return ML.prepare_features(df, DOC_FEATS, scale=True).transform(df).select("doc_id", vector_to_array("features").alias("features"))


@query("cross_validate")
def _(t):
    return ML.cross_validate(quality_docs(t), "doc_id", DOC_FEATS, "quality", "Decision Tree", k=5)


@query("grid_search")
def _(t):
    return ML.grid_search(quality_docs(t), DOC_FEATS, "quality", "Logistic Regression")


@query("feature_importance")
def _(t):
    df = quality_docs(t)
    return ML.feature_importance(ML.train(df, DOC_FEATS, "quality", "Random Forest"), df)


@query("compare_models")
def _(t):
    return ML.compare_models(quality_docs(t), "doc_id", DOC_FEATS, "quality", names=["Logistic Regression", "Decision Tree", "Naive Bayes"])


@query("rules_best_model")
def _(t):
    best = ML.compare_models(quality_docs(t), "doc_id", DOC_FEATS, "quality", names=["Logistic Regression", "Decision Tree"]).where("is_best")
    return R.apply_rules(best, "best_model", ["model"])


@query("train_report")
def _(t):
    return ML.train_report(quality_docs(t), "doc_id", DOC_FEATS, "quality", "Random Forest", folds=3)


@query("rules_training")
def _(t):
    df = quality_docs(t)
    accuracy = ML.evaluate(df, ML.train(df, DOC_FEATS, "quality", "Decision Tree"), "quality", "classification")["accuracy"]
    facts = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(accuracy).alias("accuracy"), F.lit(None).cast("double").alias("r2"))
    return R.apply_rules(facts, "training")


@query("attach_predictions")
def _(t):
    df = quality_docs(t)
    marked = split_random(df, "doc_id", 0.2, 42, "quality")
    model = ML.train(marked.where("split = 'train'").drop("split"), DOC_FEATS, "quality", "Logistic Regression")
    return ML.attach_predictions(df, "doc_id", model, "quality", marked.where("split = 'test'").drop("split"), "classification")


@query("solution_fraud_detection")
def _(t):
    df = t.labels.join(t.documents, "doc_id").select("doc_id", "toxic", "lang", "source", "n_chars")
    return ML.solution(df, "fraud_detection", "doc_id", ["lang", "source", "n_chars"], "toxic", "simple")


@query("solution_price_optimization")
def _(t):
    df = t.part.select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return ML.solution(df, "price_optimization", "p_partkey", ["p_brand", "p_type", "p_size"], "p_retailprice", "simple")


@query("auto_forest")
def _(t):
    return ML.auto_forest(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"], "c_mktsegment")


@query("save_and_score")
def _(t):
    df = quality_docs(t)
    path = shared_path(t.spark, "model")
    save_model(ML.train(df, DOC_FEATS, "quality", "Decision Tree"), path, algorithm="Decision Tree", target="quality")
    model, meta = load_model(t.spark, path)
    return ML.score(df, model).withColumn("algorithm", F.lit(meta["algorithm"]))
