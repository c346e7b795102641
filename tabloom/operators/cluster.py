"""Clustering: feature preparation, k-means, bisecting, single linkage, density clusters, choice by silhouette, projection."""

from __future__ import annotations

import math
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, CountVectorizerModel, ElementwiseProduct, Imputer, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.columns import as_list, join_on, numeric_cols, text_cols, total
from tabloom.operators import density
from tabloom.operators.graph import connected_components
from tabloom.operators.linkage import SingleLinkage
from tabloom.operators.ordered import POS, row_index
from tabloom.operators.profile import cluster_profile
from tabloom.session import cut_lineage
from tabloom.sources.tables import bounded_tasks

SEED = 42
# fixed values: the search grid of auto_cluster
K_VALUES = range(3, 9)
EPS_VALUES = [0.3, 0.5, 0.7, 1.0]
MIN_SAMPLES = [3, 5, 7]
#: Up to so many columns the cells around one are listed; beyond, blocks of points are compared.
#: LEAF_CELLS points share a box there.
GRID_COLUMNS = 3
LEAF_CELLS = 64


def _frequent_terms(df: DataFrame, words: str, terms: int) -> tuple[list[str], list[float]]:
    """The most frequent words and log((rows + 1) / (rows with the word + 1)), as CountVectorizer and IDF have them.

    Both counts come from one reading of the texts, combined in the tasks; only the chosen words reach the driver.
    """
    # each word of a row, then each different one; the null beside those counts the rows
    different = F.concat(F.array_distinct(words), F.array(F.lit(None).cast("string")))
    twice = df.select(F.posexplode(F.array(words, different)).alias("_second", "_part"))
    each = twice.select("_second", F.explode("_part").alias("_word"))
    counts = each.groupBy("_word").agg(F.count_if(F.col("_second") == 0).alias("n"), F.sum("_second").alias("in_rows"))
    rows = counts.orderBy(F.col("_word").isNotNull(), F.desc("n"), "_word").limit(terms + 1).collect()
    if len(rows) < 2:
        raise ValueError("the texts hold no words")
    return [r["_word"] for r in rows[1:]], [math.log((rows[0]["in_rows"] + 1) / (r["in_rows"] + 1)) for r in rows[1:]]


def cluster_prepare(df: DataFrame, cols, text: str = "encode", terms: int = 100) -> DataFrame:
    """Add ``features``: medians for gaps, scaled numbers, and label codes or TF-IDF of the texts."""
    cols = as_list(cols)
    numbers, texts = numeric_cols(df, cols), text_cols(df, cols)
    casts = [f"CAST(`{c}` AS DOUBLE) AS `{c}__num`" for c in numbers]
    if text == "encode":
        casts += [f"coalesce(`{c}`, 'Unknown') AS `{c}__txt`" for c in texts]
    elif texts:
        casts.append("concat_ws(' ', " + ", ".join(f"coalesce(`{c}`, '')" for c in texts) + ") AS _text")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(casts)} FROM __THIS__")]
    scaled, parts = [], []
    if numbers:
        stages.append(Imputer(inputCols=[f"{c}__num" for c in numbers], outputCols=[f"{c}__fill" for c in numbers], strategy="median"))
        scaled += [f"{c}__fill" for c in numbers]
    if texts and text == "encode":
        stages.append(StringIndexer(inputCols=[f"{c}__txt" for c in texts], outputCols=[f"{c}__idx" for c in texts], stringOrderType="alphabetAsc"))
        scaled += [f"{c}__idx" for c in texts]
    if scaled:
        stages += [VectorAssembler(inputCols=scaled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)]
        parts.append("_scaled")
    if texts and text != "encode":
        words = [RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2), StopWordsRemover(inputCol="_words", outputCol="_kept")]
        kept, weights = _frequent_terms(PipelineModel(stages=[stages[0], *words]).transform(df), "_kept", terms)
        stages += [
            *words,
            CountVectorizerModel.from_vocabulary(kept, inputCol="_kept", outputCol="_tf"),
            ElementwiseProduct(inputCol="_tf", outputCol="_idf", scalingVec=Vectors.dense(weights)),
            Normalizer(inputCol="_idf", outputCol="_tfidf"),
        ]
        parts.append("_tfidf")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages).fit(df).transform(df).select(*df.columns, "features")


def kmeans(prepared: DataFrame, k: int, name: str = "cluster") -> DataFrame:
    return KMeans(k=k, seed=SEED, featuresCol="features", predictionCol=name).fit(prepared).transform(prepared)


def hierarchical(prepared: DataFrame, k: int, name: str = "cluster") -> DataFrame:
    """Top-down bisecting clusters; ``single_linkage`` goes bottom-up."""
    return BisectingKMeans(k=k, seed=SEED, featuresCol="features", predictionCol=name).fit(prepared).transform(prepared)


def single_linkage(df: DataFrame, key: str, cols, k: int, name: str = "cluster") -> DataFrame:
    """Bottom-up clusters by single linkage, cut at ``k`` and numbered by their first key; null where a column is.

    For several cuts of one table, keep a ``linkage.SingleLinkage`` and ask it for labels.
    """
    merges = SingleLinkage(df, key, [F.col(c) for c in as_list(cols)])
    return join_on(df, merges.labels(k).withColumnsRenamed({"_k": key, "label": name}), key, "left")


def cluster_label_distance(df: DataFrame, cols) -> DataFrame:
    """k = min(5, rows / 10) labels and each row's distance to its own centre; needs two numeric columns."""
    numbers = numeric_cols(df, cols)
    k = min(5, df.count() // 10)
    if len(numbers) < 2 or k < 2:
        return df
    prepared = cluster_prepare(df, numbers)
    model = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="ai_cluster_label").fit(prepared)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    own = F.get(centres, F.col("ai_cluster_label"))
    squares = F.zip_with(vector_to_array("features"), own, lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    return model.transform(prepared).withColumn("ai_cluster_distance", distance).drop("features")


def silhouette(labelled: DataFrame, name: str = "cluster") -> float:
    """Mean silhouette on squared Euclidean distance, computed from cluster sums in one pass."""
    return ClusteringEvaluator(featuresCol="features", predictionCol=name).evaluate(labelled)


def _offsets(d: int, reach: int, half: bool = False):
    """Cell offsets within reach; with ``half`` only one of each opposite pair, without zero."""
    every = product(range(-reach, reach + 1), repeat=d)
    return [o for o in every if not half or o > (0,) * d]


def _near_cells(df: DataFrame, d: int, offsets) -> DataFrame:
    """One row per (row, cell offset) with the neighbour cell in n0, n1, ..."""
    steps = F.array(*[F.array(*[F.lit(x) for x in o]) for o in offsets])
    moved = df.withColumn("_o", F.explode(steps))
    return moved.withColumns({f"n{i}": F.col(f"g{i}") + F.col("_o")[i] for i in range(d)}).drop("_o")


def _gap(a_low, a_high, b_low, b_high):
    """Smallest and largest distance along one axis between two intervals."""
    least = F.greatest(F.lit(0.0), b_low - a_high, a_low - b_high)
    most = F.greatest(a_high - b_low, b_high - a_low)
    return least, most


def _box_distances(d: int, a: str, b: str) -> tuple[Column, Column]:
    low, high = [], []
    for i in range(d):
        least, most = _gap(*[F.col(f"{p}_{e}{i}") for p in (a, b) for e in ("lo", "hi")])
        low.append(least * least)
        high.append(most * most)
    return total(low), total(high)


def _boxes(core: DataFrame, d: int, keys, prefix: str) -> DataFrame:
    edges = [f(f"x{i}").alias(f"{prefix}_{e}{i}") for i in range(d) for f, e in ((F.min, "lo"), (F.max, "hi"))]
    return core.groupBy(*keys).agg(*edges)


def _cell_edges(core: DataFrame, d: int, side: float, eps: float) -> DataFrame:
    """Pairs of cells holding core points within eps of each other.

    Bounding boxes decide most pairs of cells, boxes of quarter cells most of the rest; points are
    compared only where a pair of quarter cells is still open.
    """
    reach, limit = math.ceil(math.sqrt(d) * (1 + 1e-9)), eps * eps
    grid = [f"g{i}" for i in range(d)]
    quarter = core.withColumns({f"q{i}": F.floor(F.col(f"x{i}") / F.lit(side / 4)).cast("bigint") for i in range(d)}).withColumn("q", F.concat_ws("_", *[f"q{i}" for i in range(d)]))
    a = _boxes(core, d, [*grid, "cell"], "a").withColumnRenamed("cell", "id_1")
    b = _boxes(core, d, [*grid, "cell"], "b").withColumnRenamed("cell", "id_2").withColumnsRenamed({g: f"n{i}" for i, g in enumerate(grid)})
    pairs = _near_cells(a, d, _offsets(d, reach, half=True)).join(b, [f"n{i}" for i in range(d)])
    least, most = _box_distances(d, "a", "b")
    pairs = cut_lineage(pairs.withColumns({"_least": least, "_most": most}).where(F.col("_least") <= limit).select("id_1", "id_2", "_most"))
    sure = pairs.where(F.col("_most") <= limit).select("id_1", "id_2")
    open_cells = pairs.where(F.col("_most") > limit).select("id_1", "id_2")
    qa = _boxes(quarter, d, ["cell", "q"], "a").withColumnsRenamed({"cell": "id_1", "q": "q_1"})
    qb = _boxes(quarter, d, ["cell", "q"], "b").withColumnsRenamed({"cell": "id_2", "q": "q_2"})
    least, most = _box_distances(d, "a", "b")
    inner = open_cells.join(qa, "id_1").join(qb, "id_2").withColumns({"_least": least, "_most": most}).where(F.col("_least") <= limit)
    inner = cut_lineage(inner.select("id_1", "id_2", "q_1", "q_2", "_most"))
    sure_inner = inner.where(F.col("_most") <= limit).select("id_1", "id_2").distinct()
    still = inner.join(sure_inner, ["id_1", "id_2"], "left_anti").select("id_1", "id_2", "q_1", "q_2")
    pa = quarter.select(F.col("cell").alias("id_1"), F.col("q").alias("q_1"), *[F.col(f"x{i}").alias(f"a{i}") for i in range(d)])
    pb = quarter.select(F.col("cell").alias("id_2"), F.col("q").alias("q_2"), *[F.col(f"x{i}").alias(f"b{i}") for i in range(d)])
    dist = total([(F.col(f"a{i}") - F.col(f"b{i}")) * (F.col(f"a{i}") - F.col(f"b{i}")) for i in range(d)])
    touched = still.join(pa, ["id_1", "q_1"]).join(pb, ["id_2", "q_2"]).where(dist <= limit).select("id_1", "id_2").distinct()
    return sure.union(sure_inner).union(touched)


def dbscan(df: DataFrame, key: str, cols, eps: float = 0.5, min_samples: int = 5, name: str = "cluster") -> DataFrame:
    """Density clusters: ``name`` (-1 is noise) and ``is_core``.

    Equal points are collapsed with a weight.  Up to three columns a grid has the side eps / sqrt(dimensions), so
    points of a cell are within eps: a cell with ``min_samples`` points is all core without any comparison, and a
    crowded cell meets only the few points of sparse neighbour cells.  Beyond that, where nearly every point has a cell
    of its own, ``density`` compares blocks of points along a curve.
    Clusters are numbered by their first core row; a border row takes the lowest cluster that reaches it.
    """
    cols = as_list(cols)
    xs = [f"x{i}" for i in range(len(cols))]
    placed = df.select(F.col(key).alias("_k"), *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs)]).na.drop()
    points = placed.groupBy(*xs).agg(F.count(F.lit(1)).alias("w"), F.min("_k").alias("first"))
    labels = (_grid_labels if len(cols) <= GRID_COLUMNS else _block_labels)(points, len(cols), eps, min_samples)
    rows = placed.join(labels, xs, "left").select(F.col("_k").alias(key), F.coalesce("_label", F.lit(-1)).alias(name), F.coalesce("is_core", F.lit(False)).alias("is_core"))
    return join_on(df, rows, key, "left")


def _numbered(core: DataFrame, component: str) -> DataFrame:
    """(component, _label): components by their first core row."""
    firsts = core.groupBy(component).agg(F.min("first").alias("first"))
    return row_index(firsts, "first", name="_label").select(component, F.col("_label").cast("int").alias("_label"))


def _block_labels(points: DataFrame, d: int, eps: float, min_samples: int) -> DataFrame:
    """(x0, x1, ..., _label, is_core) of the points in a cluster, by blocks of points."""
    xs = [f"x{i}" for i in range(d)]
    space = density.Points(points, d, eps, LEAF_CELLS)
    dense = space.core(min_samples)
    core = space.components(space.rows.join(dense, POS))
    core = cut_lineage(core.join(_numbered(core, "comp"), "comp"))
    others = space.rows.join(dense, POS, "left_anti")
    border = others.join(space.border(others, core.withColumnRenamed("_label", "label")), POS)
    return core.select(*xs, "_label", F.lit(True).alias("is_core")).union(border.select(*xs, "label", F.lit(False)))


def _grid_labels(points: DataFrame, d: int, eps: float, min_samples: int) -> DataFrame:
    """(x0, x1, ..., _label, is_core) of the points in a cluster, by a grid."""
    side, limit = eps / math.sqrt(d) * (1 - 1e-9), eps * eps
    xs, grid, ids = [f"x{i}" for i in range(d)], [f"g{i}" for i in range(d)], [f"n{i}" for i in range(d)]
    offsets = _offsets(d, math.ceil(math.sqrt(d) * (1 + 1e-9)))
    points = points.withColumns({g: F.floor(F.col(x) / F.lit(side)).cast("bigint") for g, x in zip(grid, xs)})
    points = points.withColumn("cell", F.concat_ws("_", *grid))
    weights = points.groupBy("cell").agg(F.sum("w").alias("cell_w"))
    points = cut_lineage(points.join(weights, "cell"))
    cell_of = [F.col(g).alias(n) for g, n in zip(grid, ids)]
    others = points.select(*cell_of, *[F.col(x).alias(f"o{i}") for i, x in enumerate(xs)], F.col("w").alias("ow"))
    near = total([(F.col(x) - F.col(f"o{i}")) * (F.col(x) - F.col(f"o{i}")) for i, x in enumerate(xs)])
    sparse = points.where(F.col("cell_w") < min_samples)
    reached = _near_cells(sparse, d, offsets).join(others, ids).where(near <= limit)
    counted = reached.groupBy(*xs).agg(F.sum("ow").alias("_near"))
    marked = points.join(counted, xs, "left").withColumn("is_core", (F.col("cell_w") >= min_samples) | (F.coalesce("_near", F.lit(0)) >= min_samples)).drop("_near")
    marked = cut_lineage(marked)
    core = marked.where("is_core")
    parts = connected_components(_cell_edges(core, d, side, eps))
    core = core.join(parts.withColumnRenamed("node", "cell"), "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    core = cut_lineage(core.join(_numbered(core, "component"), "component").select(*xs, *grid, "cell", "_label"))
    centres = core.select(*cell_of, *[F.col(x).alias(f"o{i}") for i, x in enumerate(xs)], "_label")
    border = _near_cells(marked.where("NOT is_core"), d, offsets).join(centres, ids).where(near <= limit)
    border = border.groupBy(*xs).agg(F.min("_label").alias("_label"))
    return core.select(*xs, "_label", F.lit(True).alias("is_core")).union(border.select(*xs, "_label", F.lit(False)))


def auto_cluster(df: DataFrame, key: str, cols, k_values=K_VALUES, eps_values=EPS_VALUES, min_samples=MIN_SAMPLES, density: bool = True) -> DataFrame:
    """Silhouette of every tried setting, best first: k-means, bisecting, and density runs without noise."""
    cols = as_list(cols)
    # every setting reads the same rows
    prepared = cluster_prepare(bounded_tasks(df.select(key, *cols)), cols).persist()
    n, rows = prepared.count(), []
    for k in k_values:
        if k <= n:
            for algorithm, run in (("kmeans", kmeans), ("hierarchical", hierarchical)):
                labelled = run(prepared, k)
                if labelled.select("cluster").distinct().count() > 1:
                    rows.append((algorithm, f"k={k}", float(silhouette(labelled))))
    if density:
        arrays = prepared.withColumn("_v", vector_to_array("features"))
        flat = arrays.select(key, "features", *[F.col("_v")[i].alias(f"v{i}") for i in range(len(cols))])
        for eps in eps_values:
            for m in min_samples:
                labelled = dbscan(flat, key, [f"v{i}" for i in range(len(cols))], eps, m)
                facts = labelled.agg(F.count_distinct("cluster").alias("k"), F.min("cluster").alias("low")).first()
                if facts["k"] > 1 and facts["low"] >= 0:
                    rows.append(("dbscan", f"eps={eps}, min_samples={m}", float(silhouette(labelled))))
    prepared.unpersist()
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: -r[2]), "algorithm string, params string, silhouette double")


def pca2(labelled: DataFrame, name: str = "cluster") -> DataFrame:
    """Two principal components x, y of each row (the vector itself when it has at most two parts)."""
    width = labelled.select("features").first()["features"].size
    if width > 2:
        labelled = PCA(k=2, inputCol="features", outputCol="_p").fit(labelled).transform(labelled)
    else:
        labelled = labelled.withColumn("_p", F.col("features"))
    v = vector_to_array("_p")
    return labelled.withColumns({"x": F.get(v, 0), "y": F.coalesce(F.get(v, 1), F.lit(0.0))}).drop("_p")


def pca_centres(projected: DataFrame, name: str = "cluster") -> DataFrame:
    return projected.groupBy(name).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("cluster_size"))


def cluster_table(df: DataFrame, key: str, cols, method: str = "kmeans", k: int = 5, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Rows with their cluster by the chosen method."""
    prepared = cluster_prepare(df, cols)
    if method == "dbscan":
        v = vector_to_array("features")
        names = [f"_v{i}" for i in range(len(as_list(cols)))]
        flat = prepared.withColumns({n: v[i] for i, n in enumerate(names)})
        return dbscan(flat, key, names, eps, min_samples).drop("features", *names)
    if method == "single_linkage":
        names = [f"_v{i}" for i in range(len(as_list(cols)))]
        flat = prepared.withColumns({n: vector_to_array("features")[i] for i, n in enumerate(names)})
        return single_linkage(flat, key, names, k).drop("features", *names)
    return (hierarchical if method == "hierarchical" else kmeans)(prepared, k).drop("features")


def cluster_summary(labelled: DataFrame, name: str = "cluster") -> DataFrame:
    sizes = labelled.where(F.col(name) != -1).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    noise = labelled.agg(F.count_if(F.col(name) == -1).alias("c"), F.count(F.lit(1)).alias("t")).first()
    return sizes.agg(
        F.count(F.lit(1)).alias("cluster_count"), F.max("n").alias("largest_cluster_size"), F.min("n").alias("smallest_cluster_size")
    ).withColumns({"noise_rows": F.lit(noise["c"]).cast("bigint"), "total_records": F.lit(noise["t"]).cast("bigint")})


def cluster_report(df: DataFrame, key: str, cols, method: str = "kmeans", k: int = 5, **opts) -> DataFrame:
    """Profile of every cluster found by the chosen method."""
    return cluster_profile(cluster_table(df, key, cols, method, k, **opts), "cluster", cols)
