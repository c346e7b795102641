import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import catalog as G
from tabloom.operators import cluster as K
from tabloom.operators import density
from tabloom.operators import evaluate as V
from tabloom.operators import models as ML
from tabloom.operators import rules as R
from tabloom.operators import suitability as U
from tabloom.operators.linkage import SingleLinkage
from tabloom.sources import tables
from tabloom.sources.tables import load_model, read_table, save_model, write_table


def brute_dbscan(pts, eps, m):
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    near = d2 <= eps * eps
    core = near.sum(1) >= m
    label = np.full(len(pts), -1)
    nxt = 0
    for i in range(len(pts)):
        if core[i] and label[i] == -1:
            todo, label[i] = [i], nxt
            while todo:
                for q in np.where(near[todo.pop()] & core)[0]:
                    if label[q] == -1:
                        label[q] = nxt
                        todo.append(q)
            nxt += 1
    for i in range(len(pts)):
        if not core[i]:
            hits = label[np.where(near[i] & core)[0]]
            label[i] = hits.min() if len(hits) else -1
    return label, core


@pytest.mark.parametrize("d", [1, 2, 3, 6])
def test_dbscan_equals_brute_force(spark, d, monkeypatch):
    monkeypatch.setattr(K, "LEAF_CELLS", 4)
    eps = 0.4 if d <= 3 else 1.0
    rng = np.random.default_rng(d)
    # a crowded cell, two blobs and scattered points; values on a grid give many equal points
    pts = np.vstack([rng.normal(0, 0.05, (120, d)), rng.normal(2, 0.4, (60, d)), np.round(rng.uniform(-4, 6, (80, d)), 1), np.zeros((40, d))])
    label, core = brute_dbscan(pts, eps, 4)
    names = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in K.dbscan(df, "id", names, eps, 4).collect()}
    assert got == {i: (int(label[i]), bool(core[i])) for i in range(len(pts))}


def brute_linkage(pts, k):
    """Merge the two closest clusters until k are left; numbered by their first point."""
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    label = np.arange(len(pts))
    for i, j in sorted(((i, j) for i in range(len(pts)) for j in range(i)), key=lambda e: d2[e]):
        if len(set(label)) <= k:
            break
        if label[i] != label[j]:
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    return {i: sorted(set(label)).index(c) for i, c in enumerate(label)}


def test_single_linkage_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    pts = np.vstack([rng.normal(0, 0.5, (9, 2)), rng.normal(20, 0.5, (6, 2)), rng.uniform(5, 9, (5, 2)), np.repeat([[9.0, 9.0]], 10, 0)])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, a double, b double").coalesce(1)
    merges = SingleLinkage(df, "id", [F.col("a"), F.col("b")], leaf=5)
    for k in (1, 4):
        assert {r["_k"]: r["label"] for r in merges.labels(k).collect()} == brute_linkage(pts, k)
    assert merges.tree.count() == 20


def test_density_clusters_of_a_wide_table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, 10 * (i % 3) + 0.1 * rng.standard_normal(4)), "ab"[i % 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e string")
    got = {r["id"]: r["cluster"] for r in K.cluster_table(df, "id", ["a", "b", "c", "d"], "dbscan", eps=0.5, min_samples=4).collect()}
    assert got == {i: i % 3 for i in range(90)}


def test_neighbours_in_five_columns(spark):
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.normal(0, 1, (250, 5)), 1000 * rng.normal(0, 1, (30, 5))])
    df = spark.createDataFrame([(f"k{i:03d}", *map(float, p)) for i, p in enumerate(pts)], "id string, a double, b double, c double, d double, e double")
    train, test = df.where("id < 'k200' or id >= 'k260'"), df.where("id >= 'k200' and id < 'k260'")
    got = {}
    for r in V.nearest_neighbours(train, test, "id", list("abcde"), 4, leaf=11).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    names = [r["id"] for r in train.collect()]
    for q in range(200, 260):
        best = sorted(names, key=lambda n: (((pts[q] - pts[int(n[1:])]) ** 2).sum(), n))[:4]
        assert [n for _, n in sorted(got[f"k{q:03d}"])] == best


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    # half of the points sit in one spot
    pts = np.vstack([np.repeat([[1.0, 1.0]], 150, 0), rng.normal(0, 3, (150, 2))])
    df = spark.createDataFrame([(i, float(a), float(b), "xy"[i % 2]) for i, (a, b) in enumerate(pts)], "id int, a double, b double, y string")
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    got = {}
    for r in V.nearest_neighbours(train, test, "id", ["a", "b"], 3, leaf=7).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    tr = [i for i in range(300) if i % 4]
    for q in range(0, 300, 4):
        best = sorted(tr, key=lambda i: (np.sqrt((pts[q, 0] - pts[i, 0]) ** 2 + (pts[q, 1] - pts[i, 1]) ** 2), i))[:3]
        assert [n for _, n in sorted(got[q])] == best
    assert V.knn_predict(train, test, "id", ["a", "b"], "y").count() == 75


def test_metrics_with_zero_division_and_ties(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b")], "label string, prediction string")
    rep = {r["class"]: (r["precision"], r["recall"], r["f1_score"], r["support"]) for r in V.classification_report(df).collect()}
    assert rep["c"] == (0.0, 0.0, 0.0, 1) and rep["b"] == (0.0, 0.0, 0.0, 0) and rep["a"][:2] == (1.0, 0.5)
    scored = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "label int, p double")
    assert V.auc(scored, "p").first()["auc"] == 0.875
    points = [(r["fpr"], r["tpr"]) for r in V.roc_curve(scored, "p").orderBy("tpr", "fpr").collect()]
    assert points == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(300).select(
        "id", (F.col("id") % 17).cast("double").alias("a"), F.when(F.col("id") % 11 != 0, F.col("id") % 5).cast("double").alias("b"),
        F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("c"), F.when(F.col("id") % 17 > 8, "yes").otherwise("no").alias("y"),
        (F.col("id") % 17 * 2 + 1).cast("double").alias("z"),
    ).cache()


def test_train_save_load_and_score(labelled, tmp_path, spark):
    model = ML.train(labelled, ["a", "b", "c"], "y", "Decision Tree")
    save_model(model, str(tmp_path / "m"), algorithm="Decision Tree")
    loaded, meta = load_model(spark, str(tmp_path / "m"))
    out = ML.score(labelled.drop("y"), loaded)
    assert meta == {"algorithm": "Decision Tree"} and out.count() == 300
    assert out.where("probability_value < 0.5 OR probability_value > 1").count() == 0
    assert ML.evaluate(labelled, loaded, "y", "classification")["accuracy"] == 1.0


def test_regression_and_importance(labelled):
    model = ML.train(labelled, ["a", "b"], "z", "Linear Regression", "regression")
    assert ML.evaluate(labelled, model, "z", "regression")["r2_score"] > 0.99
    assert ML.feature_importance(model, labelled).first()["feature"] == "a__fill"


def test_failed_model_becomes_error_row(labelled):
    got = {r["model"]: r for r in ML.compare_models(labelled, "id", ["a", "b"], "y", names=["Decision Tree", "No Such Model"]).collect()}
    assert got["Decision Tree"]["is_best"] and got["No Such Model"]["error"] is not None


def test_solution_marks_test_rows(labelled):
    out = ML.solution(labelled, "lead_scoring", "id", ["a", "b", "c"], "y")
    assert out.count() == 300 and out.where("data_split = 'test' AND prediction_value IS NULL").count() == 0
    assert out.where("data_split = 'train' AND prediction_value IS NOT NULL").count() == 0


def test_catalog_and_rules(spark):
    df = spark.createDataFrame([(1, "n", "a@b.c", "1", "x", 5)], "id int, name string, email string, phone string, city string, age int")
    cat = G.classify_columns({"contacts": df})
    kinds = {r["column_name"]: (r["semantic_type"], r["privacy_level"]) for r in cat.collect()}
    assert kinds["email"] == ("Email", "Confidential") and kinds["id"][0] == "Identifier" and kinds["age"][0] == "Numeric"
    assert "Contains Sensitive Data" in {r["tag"] for r in G.smart_tags(cat).collect()}
    assert G.catalog_search(cat, "phone number").first()["column_name"] == "phone"
    assert G.fairness_score(df).first()["fairness_score"] == 60
    score = G.governance_score(spark.createDataFrame([(90.0, "High", 80.0)], "quality_score double, risk_level string, compliance_score double")).first()
    assert round(score["overall_score"], 6) == 72.0 and score["grade"] == "C"
    facts = spark.createDataFrame([(0.75, 3)], "silhouette double, cluster_count int")
    assert [r["title"] for r in R.apply_rules(facts, "clustering").collect()] == ["Excellent Clustering Quality", "Customer Segmentation Opportunity"]
    labels = {r["column_name"]: r["label"] for r in U.suitability(df, "machine_learning").collect()}
    assert set(labels.values()) == {"No"}


def test_csv_round_trip(spark, tmp_path, labelled):
    write_table(labelled, str(tmp_path / "t"), "csv")
    back = read_table(spark, str(tmp_path / "t"), "csv", schema=labelled.schema)
    assert back.exceptAll(labelled).count() == 0 and back.count() == 300


def test_few_rows_cluster(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 10, float(i)) for i in range(30)], "id int, a double, b double")
    out = K.cluster_label_distance(df, ["a", "b"])
    assert out.where("ai_cluster_distance < 0").count() == 0 and out.count() == 30
    assert K.cluster_report(df, "id", ["a", "b"], "kmeans", 2).count() == 4


def test_ranked_search_prefers_rare_words(spark):
    rows = [("t", f"customer_{c}", "Name", "Customer field", "General") for c in ("id", "city", "zip")] + [("u", "iban", "Account", "Bank account of a customer", "Financial"), ("u", None, None, None, None)]
    catalog = spark.createDataFrame(rows, "table_name string, column_name string, semantic_type string, business_meaning string, data_category string")
    values = spark.createDataFrame([("t", "customer_city", "Berlin"), ("t", "customer_city", "Bank Street")], "table_name string, column_name string, value string")
    index = G.search_index(catalog, values)
    found = G.ranked_search(index, "Customer BANK").collect()
    assert [r["column_name"] for r in found][:2] == ["iban", "customer_city"] and len(found) == 4
    assert G.ranked_search(index, "nothing here").count() == 0
    n, df, tf, length, mean = 5, 1, 1.0, index.where("column_name = 'customer_city'").first()["length"], index.first()["mean_length"]
    want = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    assert round(G.ranked_search(index, "berlin").first()["score"], 9) == round(want, 9)


def test_rows_that_are_read_often_come_in_bounded_tasks(spark, labelled, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 7)
    made = []
    for module in (ML, K):
        monkeypatch.setattr(module, "bounded_tasks", lambda df: made.append(tables.bounded_tasks(df)) or made[-1])
    rows = labelled.coalesce(1)
    ML.train(rows, ["a", "b", "c"], "z", "Decision Tree", "regression")
    points = spark.createDataFrame([(i, float(i % 5), float(i % 3)) for i in range(60)], "id int, a double, b double").coalesce(1)
    assert K.auto_cluster(points, "id", ["a", "b"], k_values=[2], density=False).count() == 2
    assert len(made) == 2 and all(df.rdd.getNumPartitions() == -(-df.count() // 7) > 1 for df in made)
    few = spark.range(0, 5, 1, 1)
    assert tables.bounded_tasks(few) is few


def test_density_blocks_compare_only_open_points(spark, monkeypatch):
    """Every round, many blocks, and no step that asks for all points."""
    monkeypatch.setattr(K, "LEAF_CELLS", 4)
    monkeypatch.setattr(density, "BLOCK_LEAVES", 8)
    monkeypatch.setattr(density, "ASKED_LEAVES", 6)
    monkeypatch.setattr(density, "LINKING", 20)
    rng = np.random.default_rng(12)
    # two long chains, a blob, loose points, equal points, an infinite one and one with a gap
    chain = np.cumsum(rng.uniform(0.1, 0.3, (80, 4)), axis=0)
    pts = np.vstack([chain, chain + 3.0, rng.normal(-3, 0.3, (150, 4)), rng.uniform(-5, 25, (30, 4)), np.full((5, 4), 40.0)])
    label, core = brute_dbscan(pts, 0.8, 4)
    assert len(set(label)) > 3 and not core.all()
    rows = [(i, *map(float, p)) for i, p in enumerate(pts)] + [(900, float("inf"), 0.0, 0.0, 0.0), (901, None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    met = []
    whole = density.Points._meet
    monkeypatch.setattr(density.Points, "_meet", lambda self, asked, *rest: met.append(asked.count()) or whole(self, asked, *rest))
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in K.dbscan(df, "id", list("abcd"), 0.8, 4).collect()}
    assert got == {i: (int(label[i]), bool(core[i])) for i in range(len(pts))} | {900: (-1, False), 901: (None, None)}
    assert len(met) == 4 and max(met) < len(pts)


def test_density_steps_leave_no_pairs(spark):
    """A dense cloud: all but a few points are decided in their own block."""
    rng = np.random.default_rng(13)
    pts = np.unique(rng.normal(0, 0.1, (6000, 6)), axis=0)
    frame = spark.createDataFrame([(*map(float, p), 1) for p in pts], ", ".join(f"x{i} double" for i in range(6)) + ", w long")
    space = density.Points(frame, 6, 0.2, 16)
    first = space.rows.select("block", "_pos", "w", *space.xs).groupBy("block").applyInArrow(density._crowded(6, space.limit, 4, 16), "_pos long, enough boolean")
    assert space.rows.select("block").distinct().count() > 4
    assert first.where("NOT enough").count() < len(pts) / 20
    assert space.components(space.rows.join(space.core(4), "_pos")).select("comp").distinct().count() == 1


def test_terms_of_texts_equal_spark_ml_in_one_reading(spark):
    from pyspark.ml.feature import IDF, CountVectorizer
    from pyspark.ml.functions import vector_to_array

    # ties (Spark's order of equal counts follows the partitions, so positions are compared by word), repeats in a text, stop words, an empty and a null text
    texts = ["Apple apple pear the fig", "pear Plum_2 apple", "fig kiwi lime", "", None, "été Été the of x", "lime kiwi melon"]
    df = spark.createDataFrame([(i, t, float(i)) for i, t in enumerate(texts)], "id int, t string, n double")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    once = df.mapInArrow(counted, df.schema)
    words = K.RegexTokenizer(inputCol="t", outputCol="w", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2).transform(df.na.fill("", ["t"]))
    words = K.StopWordsRemover(inputCol="w", outputCol="k").transform(words)
    model = CountVectorizer(inputCol="k", outputCol="tf", vocabSize=6).fit(words)
    idf = IDF(inputCol="tf", outputCol="i").fit(model.transform(words))
    kept, weights = K._frequent_terms(words, "k", 6)
    assert kept == ["apple", "fig", "kiwi", "lime", "pear", "été"] == sorted(model.vocabulary)
    place = [model.vocabulary.index(w) for w in kept]
    assert np.allclose(weights, idf.idf.toArray()[place], rtol=1e-14)
    want = K.Normalizer(inputCol="i", outputCol="u").transform(idf.transform(model.transform(words))).select("id", vector_to_array("u").alias("u")).collect()
    got = K.cluster_prepare(once, ["t"], text="tfidf", terms=6)
    assert reads.value == len(texts)
    got = {r["id"]: r["f"] for r in got.select("id", vector_to_array("features").alias("f")).collect()}
    assert len(got) == len(texts) and all(np.allclose(got[r["id"]], np.array(r["u"])[place], rtol=1e-14) for r in want)
    with pytest.raises(Exception):
        K.cluster_prepare(df.where("id = 3"), ["t"], text="tfidf")


def boosting_rows(spark, n):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 50, n), rng.integers(0, 5, n)
    c = rng.normal(size=n)
    rows = [(int(i), float(x) if i % 97 else None, float(y), float(z), "uvw"[int(k)], float(x * y + 3 * z + k)) for i, (x, y, z, k) in enumerate(zip(a, b, c, rng.integers(0, 3, n)))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, t string, y double").repartition(3)


def test_cut_points_are_those_of_all_rows(spark):
    rows = spark.createDataFrame([(float(v), float(v % 3)) for v in range(64) for _ in range(1 + v % 2)], "v double, w double")
    cuts = ML.cut_points(rows, ["v", "w"])
    assert cuts["w"] == [0.5, 1.5] and len(cuts["v"]) == 31
    many = spark.range(30_000).select((F.col("id") / 7.0).alias("v"))
    found = ML.cut_points(many, ["v"])["v"]
    assert len(found) == 31 and all(abs(x - 30_000 / 7 * (i + 1) / 32) < 5 for i, x in enumerate(found))


def test_boosting_on_bins_equals_boosting_on_rows(spark):
    df = boosting_rows(spark, 1500)
    feats = ["a", "b", "t"]
    for task, target in (("regression", "y"), ("classification", "big")):
        rows = df.withColumn("big", F.when(F.col("y") > 60, "yes").otherwise("no"))
        prep = ML.prepare_features(rows, feats)
        labelled, labels = ML._with_label(prep.transform(rows), target, task)
        plain = ML._estimator(task, "Gradient Boosting", len(labels or []), 0).fit(labelled.select("features", "label"))
        want = {r.id: r.prediction for r in plain.transform(labelled).select("id", "prediction").collect()}
        got = {r.id: r.prediction for r in ML.train(rows, feats, target, "Gradient Boosting", task).transform(rows).select("id", "prediction").collect()}
        assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_boosting_rows_are_bounded_by_bins(spark):
    df = boosting_rows(spark, 20_000)
    prep = ML.prepare_features(df, ["b", "c"])
    labelled, _ = ML._with_label(prep.transform(df), "y", "regression")
    _, binned = ML._binned(df, prep, labelled)
    cells = ML._weighted_bins(binned, "regression").collect()
    assert len(cells) <= 5 * 32 and sum(r["_weight"] for r in cells) == 20_000
    model = ML.train(df.limit(40).withColumn("one", F.lit(1.0)).withColumn("u", F.lit("x")), ["one", "u"], "y", "Gradient Boosting", "regression")
    assert model.transform(df.limit(5).withColumn("one", F.lit(1.0)).withColumn("u", F.lit("x"))).count() == 5


def test_auto_cluster_query_searches_the_whole_grid(spark, monkeypatch, tmp_path):
    import __spark_entry__ as entry

    tried = []

    def clusters(name):
        return lambda df, k: tried.append((name, k)) or df.withColumn("cluster", F.pmod("p_partkey", F.lit(k)))

    monkeypatch.setattr(K, "kmeans", clusters("kmeans"))
    monkeypatch.setattr(K, "hierarchical", clusters("hierarchical"))
    monkeypatch.setattr(K, "dbscan", lambda df, key, cols, eps, m: tried.append((eps, m)) or df.withColumn("cluster", F.pmod(F.col(key), F.lit(2))))
    monkeypatch.setattr(K, "silhouette", lambda labelled: 0.5)
    spark.createDataFrame([(i, i % 7, float(i)) for i in range(20)], "p_partkey int, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert entry.queries()["auto_cluster"](spark, str(tmp_path)).count() == 24
    # clustering_backend.py of the reference: k from 3 to 8, four distances, three sizes
    assert set(tried) == {(a, k) for a in ("kmeans", "hierarchical") for k in range(3, 9)} | {(e, m) for e in (0.3, 0.5, 0.7, 1.0) for m in (3, 5, 7)}
