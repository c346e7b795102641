"""Clustering and monitoring."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators import cluster as K
from tabloom.operators import rules as R
from tabloom.operators.profile import iqr_table
from tabloom.streaming import monitor as S
from workload.drift_queries import ks_sql
from workload.profile_queries import iqr_sql
from tabloom.session import shared_path
from workload.registry import query, union_all

PARTS = ["p_size", "p_retailprice"]


def prepared(t):
    return K.cluster_prepare(t.part.select("p_partkey", "p_brand", *PARTS), PARTS)


@query("cluster_prepare")
def _(t):
    return prepared(t).withColumn("features", vector_to_array("features"))


@query("cluster_prepare_text")
def _(t):
    df = t.documents.select("doc_id", "text", "n_chars")
    return K.cluster_prepare(df, ["text", "n_chars"], text="tfidf").select("doc_id", vector_to_array("features").alias("features"))


@query("kmeans")
def _(t):
    return K.kmeans(prepared(t), 4).drop("features")


@query("hierarchical")
def _(t):
    return K.hierarchical(prepared(t), 4).drop("features")


@query("cluster_label_distance")
def _(t):
    return K.cluster_label_distance(t.part.select("p_partkey", *PARTS), PARTS)


_PTS = "(SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer)"


def dbscan_sql(eps, m):
    return (
        f"WITH RECURSIVE n AS MATERIALIZED (SELECT a.id, b.id AS nb FROM {_PTS} a, {_PTS} b WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {eps * eps}), core AS MATERIALIZED (SELECT id FROM n GROUP BY id HAVING count(*) >= {m}), "
        "e AS MATERIALIZED (SELECT n.id, nb FROM n JOIN core a ON n.id = a.id JOIN core b ON n.nb = b.id), r AS (SELECT id AS node, id AS reached FROM core UNION SELECT r.node, e.nb FROM r JOIN e ON r.reached = e.id), "
        "k AS (SELECT node, dense_rank() OVER (ORDER BY c) - 1 AS label FROM (SELECT node, min(reached) AS c FROM r GROUP BY 1)), "
        "b AS (SELECT n.id, min(label) AS label FROM n JOIN k ON n.nb = k.node WHERE n.id NOT IN (SELECT id FROM core) GROUP BY 1) "
        "SELECT c_custkey, CAST(coalesce(k.label, b.label, -1) AS INTEGER) AS cluster, k.label IS NOT NULL AS is_core FROM customer LEFT JOIN k ON c_custkey = k.node LEFT JOIN b ON c_custkey = b.id"
    )


def points(t):
    return t.customer.select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))


@query("dbscan", dbscan_sql(1.5, 4))
def _(t):
    return K.dbscan(points(t), "c_custkey", ["x", "y"], 1.5, 4).drop("x", "y")


@query("dbscan_one_column", dbscan_sql(0.5, 12).replace("CAST(c_nationkey AS DOUBLE) AS y", "0::DOUBLE AS y"))
def _(t):
    return K.dbscan(points(t).drop("y"), "c_custkey", ["x"], 0.5, 12).drop("x")


_SIX = "(SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(6)) + " FROM embeddings)"
_SIX_NEAR = " + ".join(f"pow(a.e{i} - b.e{i}, 2)" for i in range(6))


@query(
    "dbscan_six_columns",
    f"WITH RECURSIVE p AS MATERIALIZED {_SIX}, n AS MATERIALIZED (SELECT a.vec_id AS id, b.vec_id AS nb FROM p a, p b WHERE {_SIX_NEAR} <= 0.2 * 0.2), core AS MATERIALIZED (SELECT id FROM n GROUP BY id HAVING count(*) >= 4), "
    "e AS MATERIALIZED (SELECT n.id, nb FROM n JOIN core a ON n.id = a.id JOIN core b ON n.nb = b.id), r AS (SELECT id AS node, id AS reached FROM core UNION SELECT r.node, e.nb FROM r JOIN e ON r.reached = e.id), "
    "k AS (SELECT node, dense_rank() OVER (ORDER BY c) - 1 AS label FROM (SELECT node, min(reached) AS c FROM r GROUP BY 1)), "
    "b AS (SELECT n.id, min(label) AS label FROM n JOIN k ON n.nb = k.node WHERE n.id NOT IN (SELECT id FROM core) GROUP BY 1) "
    "SELECT vec_id, CAST(coalesce(k.label, b.label, -1) AS INTEGER) AS cluster, k.label IS NOT NULL AS is_core FROM p LEFT JOIN k ON vec_id = k.node LEFT JOIN b ON vec_id = b.id",
)
def _(t):
    names = [f"e{i}" for i in range(6)]
    rows = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return K.dbscan(rows, "vec_id", names, 0.2, 4).drop(*names)


@query("silhouette")
def _(t):
    value = K.silhouette(K.kmeans(prepared(t), 4))
    return t.spark.createDataFrame([(float(value),)], "silhouette double")


@query("auto_cluster")
def _(t):
    return K.auto_cluster(t.part.select("p_partkey", *PARTS), "p_partkey", PARTS)


@query("rules_clustering")
def _(t):
    labelled = K.kmeans(prepared(t), 4)
    facts = K.cluster_summary(labelled).withColumn("silhouette", F.lit(float(K.silhouette(labelled))))
    return R.apply_rules(facts, "clustering")


@query("pca2")
def _(t):
    df = K.cluster_prepare(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return K.pca_centres(K.pca2(K.kmeans(df, 3)))


@query("cluster_table")
def _(t):
    return K.cluster_table(t.part, "p_partkey", [*PARTS, "p_brand"], "hierarchical", 4)


@query(
    "cluster_summary",
    "SELECT count(*) AS cluster_count, max(n) AS largest_cluster_size, min(n) AS smallest_cluster_size, any_value(noise) AS noise_rows, any_value(t) AS total_records FROM (SELECT cluster, count(*) AS n FROM (" + dbscan_sql(1.5, 4) + ") WHERE cluster <> -1 GROUP BY 1), "
    "(SELECT count(*) FILTER (cluster = -1) AS noise, count(*) AS t FROM (" + dbscan_sql(1.5, 4) + "))",
)
def _(t):
    return K.cluster_summary(K.dbscan(points(t), "c_custkey", ["x", "y"], 1.5, 4))


@query("cluster_report")
def _(t):
    return K.cluster_report(t.part, "p_partkey", [*PARTS, "p_type"], "kmeans", 4)


# ---- monitoring: events with gaps, bounds from the whole table
_EV = "(SELECT ts, user_id, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events)"
_QUALITY = (
    f"SELECT *, completeness_pct - outlier_pct AS quality_score, CASE WHEN completeness_pct - outlier_pct < 60 THEN 'critical' WHEN completeness_pct - outlier_pct < 75 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS row_count, "
    f"100.0 * (count(value) + count(event_type)) / (2 * count(*)) AS completeness_pct, 100.0 * count(*) FILTER (value < lower_bound OR value > upper_bound) / count(value) AS outlier_pct FROM {_EV} e, ({iqr_sql(_EV, ['value'])}) b GROUP BY 1, 2)"
)
_QR = {6: "completeness_pct outlier_pct quality_score"}


def gaps(df):
    return df.select("ts", "user_id", "event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"))


@query("window_quality", _QUALITY, rnd=_QR)
def _(t):
    df = gaps(t.events)
    return S.window_quality(df, "ts", ["value", "event_type"], iqr_table(df, ["value"]), "1 day")


def event_stream(t):
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t._dir)


@query(
    "stream_window_quality",
    f"SELECT * FROM ({_QUALITY}) WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    rnd=_QR,
)
def _(t):
    path = shared_path(t.spark, "quality")
    bounds = iqr_table(gaps(t.events), ["value"])
    S.start_quality_monitor(gaps(event_stream(t)), path, "ts", ["value", "event_type"], bounds).awaitTermination()
    return t.spark.read.parquet(f"{path}/rows")


_WEEK = "time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01')"


_WINDOW_DRIFT = (
    f"WITH w AS (SELECT {_WEEK} AS ws, value FROM events), c AS (SELECT ws, value, count(*) AS n FROM w GROUP BY 1, 2), f AS (SELECT min(ws) AS fw FROM w), later AS (SELECT DISTINCT ws FROM w, f WHERE ws > fw), "
    "u AS (SELECT l.ws, value, n AS a, 0 AS b FROM c, f, later l WHERE c.ws = fw UNION ALL SELECT ws, value, 0, n FROM c, f WHERE ws > fw), g AS (SELECT ws, value, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1, 2), "
    "r AS (SELECT ws, sum(a) OVER o / sum(a) OVER p AS fa, sum(b) OVER o / sum(b) OVER p AS fb, sum(a) OVER p AS n1, sum(b) OVER p AS n2 FROM g WINDOW o AS (PARTITION BY ws ORDER BY value), p AS (PARTITION BY ws)), "
    "d AS (SELECT ws, max(abs(fa - fb)) AS statistic, max(n2) AS n2, sqrt(max(n1) * max(n2) / (max(n1) + max(n2))) AS en FROM r GROUP BY 1), "
    "z AS (SELECT ws, statistic, n2, (en + 0.12 + 0.11 / en) * statistic AS lam FROM d), q AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * k * k * lam * lam))))) END AS p_value FROM z) "
    "SELECT ws AS window_start, statistic, p_value, CAST(n2 AS BIGINT) AS row_count, CASE WHEN p_value < 0.01 THEN 'critical' WHEN p_value < 0.03 THEN 'warning' ELSE 'ok' END AS status FROM q"
)


@query("window_drift", _WINDOW_DRIFT, rnd={8: "statistic p_value"})
def _(t):
    return S.window_drift(t.events, "ts", "value", "7 days")


@query(
    "stream_window_drift",
    f"SELECT * FROM ({_WINDOW_DRIFT}) WHERE window_start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    rnd={8: "statistic p_value"},
)
def _(t):
    path = shared_path(t.spark, "window_drift")
    week = F.window("ts", "7 days")["start"]
    first = t.events.agg(F.min(week).alias("w"))
    reference = t.events.withColumn("w", week).join(F.broadcast(first), "w").drop("w")
    S.start_window_drift(event_stream(t), reference, path, "ts", "value").awaitTermination()
    found = t.spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").drop("batch")
    return found.join(F.broadcast(first), found["window_start"] > first["w"]).drop("w")


_VS = f"(SELECT value, user_id, is_ref FROM (SELECT value, user_id, true AS is_ref FROM events WHERE {_WEEK} = (SELECT min({_WEEK}) FROM events) UNION ALL SELECT value, user_id, false FROM events))"


@query(
    "stream_drift",
    f"SELECT column_name, 'Kolmogorov-Smirnov' AS test_used, statistic AS drift_score, p_value, CASE WHEN statistic > 0.3 THEN 'High' WHEN statistic > 0.1 THEN 'Medium' WHEN statistic > 0.05 THEN 'Low' ELSE 'Minimal' END AS drift_magnitude, p_value < 0.05 AS drift_detected, 0 AS batch_id FROM ({union_all([ks_sql(_VS, 'value'), ks_sql(_VS, 'user_id')])})",
    rnd={8: "drift_score p_value"},
)
def _(t):
    path = shared_path(t.spark, "drift")
    week = F.window("ts", "7 days")["start"]
    first = t.events.agg(F.min(week).alias("w")).first()["w"]
    reference = t.events.where(week == F.lit(str(first)).cast("timestamp_ntz"))
    S.start_drift_monitor(event_stream(t), reference, path, ["value", "user_id"]).awaitTermination()
    return t.spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").drop("batch")
