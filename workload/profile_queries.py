"""Column and table profiles."""

from pyspark.sql import functions as F

from tabloom.operators import profile as P
from workload.registry import query, union_all
from workload.shape_queries import NULL_QTY, NULL_TYPE, lineitem_with_nulls, part_with_nulls

PART = [
    ("p_partkey", "bigint", "numeric"), ("p_name", "string", "text"), ("p_brand", "string", "text"),
    ("p_type", "string", "text"), ("p_size", "int", "numeric"), ("p_retailprice", "double", "numeric"),
]
PART_SRC = f"(SELECT p_partkey, p_name, p_brand, {NULL_TYPE} AS p_type, p_size, p_retailprice FROM part)"
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_SRC = (
    f"(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {NULL_QTY} AS l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate FROM lineitem)"
)
ORDERS = [
    ("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"), ("o_orderstatus", "string", "text"),
    ("o_totalprice", "double", "numeric"), ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "text"),
]
CUSTOMER = [
    ("c_custkey", "bigint", "numeric"), ("c_name", "string", "text"), ("c_nationkey", "int", "numeric"),
    ("c_acctbal", "double", "numeric"), ("c_mktsegment", "string", "text"),
]


def facts_sql(src: str, columns) -> str:
    """Per-column facts, the SQL twin of column_facts."""
    parts = []
    for c, dtype, kind in columns:
        num = kind == "numeric"
        txt = kind == "text"
        n = "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, '{dtype}' AS data_type, '{kind}' AS kind, count(*) AS row_count, count(*) - count({c}) AS missing_count, "
            f"100.0 * (count(*) - count({c})) / count(*) AS missing_pct, count(DISTINCT {c}) AS unique_count, "
            + (f"CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, avg({c}) AS mean_value, stddev_samp({c}) AS std_value, " if num else f"{n} AS min_value, {n} AS max_value, {n} AS mean_value, {n} AS std_value, ")
            + (f"avg(length({c})) AS avg_length, count(*) FILTER ({c} = lower({c})) AS lower_count, bool_or(contains({c}, '@')) AS has_at, bool_or(regexp_matches({c}, '[0-9]')) AS has_digit " if txt else f"{n} AS avg_length, CAST(NULL AS BIGINT) AS lower_count, CAST(NULL AS BOOLEAN) AS has_at, CAST(NULL AS BOOLEAN) AS has_digit ")
            + f"FROM {src} s"
        )
    return union_all(parts)


def dup_sql(src: str, cols) -> str:
    return f"(SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {src} s GROUP BY {', '.join(cols)}))"


def missing_sql(src, cols) -> str:
    return f"(SELECT {' + '.join(f'(count(*) - count({c}))' for c in cols)} FROM {src} s)"


def iqr_sql(src, cols) -> str:
    return union_all(
        f"SELECT '{c}' AS column_name, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound "
        f"FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {src} s)"
        for c in cols
    )


def outlier_sql(src, cols) -> str:
    return union_all(
        f"SELECT column_name, (SELECT count(*) FROM {src} s WHERE {c} < lower_bound OR {c} > upper_bound) AS outlier_count, "
        f"100.0 * (SELECT count(*) FROM {src} s WHERE {c} < lower_bound OR {c} > upper_bound) / (SELECT count(*) FROM {src} s) AS outlier_pct, lower_bound, upper_bound "
        f"FROM ({iqr_sql(src, [c])})"
        for c in cols
    )


PART_COLS = [c for c, _, _ in PART]
_PROFILE_SQL = union_all(
    f"SELECT '{c}' AS column_name, count({c}) AS value_count, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, avg({c}) AS mean_value, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median_value, stddev_samp({c}) AS std_value FROM {LINE_SRC} s"
    for c in LINE_NUM
)
_LINE_OUT = outlier_sql(LINE_SRC, LINE_NUM)


@query(
    "lineitem_profile",
    f"SELECT p.*, m.missing_count, m.missing_pct, o.outlier_count, o.outlier_pct, o.lower_bound, o.upper_bound FROM ({_PROFILE_SQL}) p "
    f"JOIN ({facts_sql(LINE_SRC, [(c, 'double', 'numeric') for c in LINE_NUM])}) m USING (column_name) JOIN ({_LINE_OUT}) o USING (column_name)",
    rnd={4: "mean_value median_value std_value lower_bound upper_bound", 6: "missing_pct outlier_pct"},
)
def _(t):
    df = lineitem_with_nulls(t).select(*LINE_NUM)
    missing = P.missing_report(df).drop("data_type")
    return P.numeric_profile(df).join(missing, "column_name").join(P.outlier_report(df), "column_name")


@query(
    "table_info",
    f"SELECT count(*) AS row_count, 6 AS column_count, {missing_sql(PART_SRC, PART_COLS)} AS missing_cells, 3 AS numeric_columns, 3 AS text_columns, "
    f"CAST({dup_sql(PART_SRC, PART_COLS)} AS BIGINT) AS duplicate_rows FROM part",
)
def _(t):
    return P.table_info(part_with_nulls(t))


@query("missing_report", f"SELECT column_name, data_type, missing_count, missing_pct FROM ({facts_sql(PART_SRC, PART)})", rnd={6: "missing_pct"})
def _(t):
    return P.missing_report(part_with_nulls(t))


@query(
    "missing_patterns",
    f"SELECT p_type IS NULL AS p_type_missing, p_brand IS NULL AS p_brand_missing, count(*) AS row_count FROM {PART_SRC} s GROUP BY 1, 2",
)
def _(t):
    return P.missing_patterns(part_with_nulls(t), ["p_type", "p_brand"])


@query("unique_report", f"SELECT column_name, unique_count FROM ({facts_sql(PART_SRC, PART)})")
def _(t):
    return P.unique_report(part_with_nulls(t))


@query("numeric_profile", _PROFILE_SQL, rnd={4: "mean_value median_value std_value"})
def _(t):
    return P.numeric_profile(lineitem_with_nulls(t), LINE_NUM)


@query(
    "duplicate_rows",
    "SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_discount)",
)
def _(t):
    return P.duplicate_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_discount"))


@query("top_values", "SELECT p_brand AS value, count(*) AS value_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return P.top_values(t.part, "p_brand", 5)


@query("count_map", "SELECT o_orderpriority AS value, count(*) AS value_count FROM orders GROUP BY 1")
def _(t):
    return P.count_map(t.orders, "o_orderpriority")


@query(
    "datetime_profile",
    "SELECT 'o_orderdate' AS column_name, min(o_orderdate) AS min_value, max(o_orderdate) AS max_value, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS INTEGER) AS range_days FROM orders",
)
def _(t):
    return P.datetime_profile(t.orders, "o_orderdate")


@query("mode_of", "SELECT l_quantity AS mode_value, count(*) AS value_count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(t):
    return P.mode_of(t.lineitem, "l_quantity")


@query("iqr_bounds", iqr_sql(LINE_SRC, LINE_NUM), rnd={4: "q1 q3 iqr lower_bound upper_bound"})
def _(t):
    return P.iqr_bounds(lineitem_with_nulls(t), LINE_NUM)


@query("outlier_report", outlier_sql("orders", ["o_totalprice", "o_custkey"]), rnd={4: "lower_bound upper_bound", 6: "outlier_pct"})
def _(t):
    return P.outlier_report(t.orders, ["o_totalprice", "o_custkey"])


@query(
    "distribution_report",
    union_all(
        f"SELECT '{c}' AS column_name, avg({c}) AS mean_value, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median_value, stddev_samp({c}) AS std_value, "
        f"skewness({c}) AS skewness, kurtosis({c}) AS kurtosis FROM {LINE_SRC} s"
        for c in LINE_NUM
    ),
    rnd={4: "mean_value median_value std_value", 6: "skewness kurtosis"},
)
def _(t):
    return P.distribution_report(lineitem_with_nulls(t), LINE_NUM)


@query(
    "histogram",
    "WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), "
    "b AS (SELECT CAST(least(floor((o_totalprice - lo) * 30 / (hi - lo)), 29) AS BIGINT) AS bin, lo, (hi - lo) / 30 AS w FROM orders, r) "
    "SELECT bin, lo + bin * w AS bin_start, lo + bin * w + w AS bin_end, count(*) AS value_count FROM b GROUP BY bin, lo, w",
    rnd={4: "bin_start bin_end"},
)
def _(t):
    return P.histogram(t.orders, "o_totalprice", 30)


def five_sql(src, c, by=None):
    qs = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS {n}" for p, n in ((0.0, "min_value"), (0.25, "q1"), (0.5, "median_value"), (0.75, "q3"), (1.0, "max_value")))
    return f"SELECT '{c}' AS column_name, {by + ', ' if by else ''}{qs} FROM {src} s {'GROUP BY ' + by if by else ''}"


@query("five_number", union_all(five_sql("lineitem", c) for c in LINE_NUM), rnd={4: "min_value q1 median_value q3 max_value"})
def _(t):
    return P.five_number(t.lineitem, LINE_NUM)


@query(
    "five_number_by_group",
    union_all(five_sql("lineitem", c, "l_returnflag") for c in ("l_quantity", "l_extendedprice")),
    rnd={4: "min_value q1 median_value q3 max_value"},
)
def _(t):
    return P.five_number(t.lineitem, ["l_quantity", "l_extendedprice"], by="l_returnflag")


@query(
    "correlation_matrix",
    union_all(f"SELECT '{a}' AS column_1, '{b}' AS column_2, corr({a}, {b}) AS correlation FROM {LINE_SRC} s" for a in LINE_NUM for b in LINE_NUM),
    rnd={6: "correlation"},
)
def _(t):
    return P.correlation_matrix(lineitem_with_nulls(t), LINE_NUM)


@query(
    "strong_pairs",
    "SELECT * FROM ("
    + union_all(
        f"SELECT '{a}' AS column_1, '{b}' AS column_2, corr({a}, {b}) AS correlation FROM (SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)"
        for i, a in enumerate(LINE_NUM + ["revenue"])
        for b in (LINE_NUM + ["revenue"])[i + 1 :]
    )
    + ") WHERE abs(correlation) > 0.7",
    rnd={6: "correlation"},
)
def _(t):
    df = t.lineitem.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return P.strong_pairs(df, LINE_NUM + ["revenue"], 0.7)


@query(
    "variance_rank",
    union_all(f"SELECT '{c}' AS column_name, var_samp({c}) AS variance_score, coalesce(var_samp({c}) / nullif(max({c}), 0), 0) AS normalized_score FROM lineitem" for c in LINE_NUM),
    rnd={2: "variance_score", 4: "normalized_score"},
)
def _(t):
    return P.variance_rank(t.lineitem, LINE_NUM)


_TOT = (
    f"WITH t AS (SELECT (SELECT count(*) FROM {PART_SRC} s) AS n, {missing_sql(PART_SRC, PART_COLS[1:5])} AS m, "
    f"CAST({dup_sql(PART_SRC, PART_COLS[1:5])} AS BIGINT) AS d, "
    f"(SELECT (avg(coalesce(length(p_name), 0)) + avg(coalesce(length(p_brand), 0)) + avg(coalesce(length(p_type), 0))) / 3 FROM {PART_SRC} s) AS len) "
)


def part_slice(t):
    return part_with_nulls(t).select("p_name", "p_brand", "p_type", "p_size")


@query(
    "quality_score",
    _TOT + "SELECT greatest(0, least(100, 100 - 50.0 * m / (n * 4) - 30.0 * d / n)) AS quality_score, m AS missing_values, d AS duplicate_rows, "
    "100.0 * (1 - m / (n * 4)) AS completeness_pct, 100.0 * (1 - d / n) AS consistency_pct FROM t",
    rnd={6: "quality_score completeness_pct consistency_pct"},
)
def _(t):
    return P.quality_score(part_slice(t))


@query(
    "matching_quality",
    _TOT + "SELECT 100.0 * greatest(0, least(1, 0.4 * (1 - m / (n * 4)) + 0.3 * (1 - d / n) + 0.3 * least(1.0, len / 20))) AS matching_quality FROM t",
    rnd={6: "matching_quality"},
)
def _(t):
    return P.matching_quality(part_slice(t))


@query(
    "completeness_consistency",
    _TOT + "SELECT (a + b) / 2 AS overall_score, a AS completeness_score, b AS consistency_score, m AS missing_values, 1::BIGINT AS columns_with_missing, d AS duplicate_rows, "
    "CASE WHEN (a + b) / 2 >= 90 THEN 'Excellent' WHEN (a + b) / 2 >= 70 THEN 'Good' ELSE 'Fair' END AS quality_level "
    "FROM (SELECT *, 100.0 * (1 - m / (n * 4)) AS a, greatest(0, 100 - 100.0 * d / n) AS b FROM t)",
    rnd={6: "overall_score completeness_score consistency_score"},
)
def _(t):
    return P.completeness_consistency(part_with_nulls(t), ["p_name", "p_brand", "p_type", "p_size"])


_NUM_PART = [c for c, _, k in PART if k == "numeric"]


def column_quality_sql(src, columns):
    numbers = [c for c, _, k in columns if k == "numeric"]
    return (
        f"WITH f AS ({facts_sql(src, columns)}), o AS ({outlier_sql(src, numbers)}), "
        "s AS (SELECT f.*, o.outlier_pct, 100 - missing_pct AS completeness, "
        "CASE WHEN kind = 'text' THEN 100.0 * lower_count / (row_count - missing_count) ELSE 95 END AS consistency, "
        "CASE WHEN kind = 'numeric' THEN greatest(0, 100 - 2 * outlier_pct) ELSE 90 END AS validity, 100.0 * unique_count / row_count AS uniqueness "
        "FROM f LEFT JOIN o USING (column_name)) "
        "SELECT column_name, completeness, consistency, validity, uniqueness, (completeness + consistency + validity) / 3 AS overall_score, "
        "concat_ws(', ', CASE WHEN missing_pct > 20 THEN 'High missing values' END, CASE WHEN kind = 'text' AND consistency < 80 THEN 'Inconsistent text formatting' END, "
        "CASE WHEN outlier_pct > 5 THEN 'High outlier rate' END, CASE WHEN contains(lower(column_name), 'id') AND uniqueness < 95 THEN 'ID column not sufficiently unique' END) AS issues, "
        "concat_ws(', ', CASE WHEN missing_pct > 20 THEN 'Data Quality Risk' END, CASE WHEN kind = 'text' AND consistency < 80 THEN 'Standardization Required' END, "
        "CASE WHEN outlier_pct > 5 THEN 'Outlier Management Needed' END, CASE WHEN contains(lower(column_name), 'id') AND uniqueness < 95 THEN 'Identity Integrity Risk' END) AS governance_flags FROM s"
    )


@query("column_quality", column_quality_sql(PART_SRC, PART), rnd={6: "completeness consistency validity uniqueness overall_score"})
def _(t):
    return P.column_quality(part_with_nulls(t))


@query(
    "group_stats",
    "SELECT l_returnflag, avg(l_quantity) AS l_quantity_mean, stddev_samp(l_quantity) AS l_quantity_std, count(l_quantity) AS l_quantity_count, "
    f"avg(l_tax) AS l_tax_mean, stddev_samp(l_tax) AS l_tax_std, count(l_tax) AS l_tax_count FROM {LINE_SRC} s GROUP BY 1",
    rnd={6: "l_quantity_mean l_quantity_std l_tax_mean l_tax_std"},
)
def _(t):
    return P.group_stats(lineitem_with_nulls(t), "l_returnflag", ["l_quantity", "l_tax"])


def cluster_profile_sql(src, label, numbers, texts, k=3):
    parts = []
    for c in numbers:
        parts.append(f"SELECT {label}, count(*) AS cluster_size, '{c}' AS column_name, avg({c}) AS mean_value, stddev_samp({c}) AS std_value, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, CAST(NULL AS VARCHAR) AS top_values FROM {src} s WHERE {label} <> -1 GROUP BY 1")
    for c in texts:
        parts.append(
            f"SELECT {label}, CAST(sum(n) AS BIGINT), '{c}', NULL, NULL, NULL, NULL, string_agg(CASE WHEN r <= {k} THEN v || '=' || n END, ', ' ORDER BY r) FROM "
            f"(SELECT {label}, {c} AS v, count(*) AS n, row_number() OVER (PARTITION BY {label} ORDER BY count(*) DESC, {c}) AS r FROM {src} s WHERE {label} <> -1 GROUP BY 1, 2) GROUP BY 1"
        )
    return f"SELECT *, 100.0 * cluster_size / (SELECT count(*) FROM {src} s) AS cluster_pct FROM ({union_all(parts)})"


@query(
    "cluster_profile",
    cluster_profile_sql("(SELECT *, CASE WHEN p_size > 40 THEN -1 ELSE p_size % 4 END AS label FROM part)", "label", ["p_size", "p_retailprice"], ["p_brand", "p_type"]),
    rnd={4: "mean_value std_value min_value max_value", 6: "cluster_pct"},
)
def _(t):
    labelled = t.part.withColumn("label", F.expr("CASE WHEN p_size > 40 THEN -1 ELSE p_size % 4 END"))
    return P.cluster_profile(labelled, "label", ["p_size", "p_retailprice", "p_brand", "p_type"])


@query(
    "cv_risk",
    "SELECT *, CASE WHEN cv > 1 THEN 'High' WHEN cv > 0.5 THEN 'Medium' ELSE 'Low' END AS drift_risk FROM ("
    + union_all(f"SELECT '{c}' AS column_name, stddev_samp({c}) / avg({c}) AS cv FROM lineitem" for c in LINE_NUM)
    + ")",
    rnd={6: "cv"},
)
def _(t):
    return P.cv_risk(t.lineitem, LINE_NUM)


_ANOM = "(SELECT l_returnflag, l_linestatus, l_discount, CASE WHEN l_quantity > 20 THEN NULL ELSE l_tax END AS half_tax, 'x' AS fixed, CASE WHEN l_quantity >= 48 THEN 1000.0 ELSE l_quantity END AS spiky FROM lineitem)"
_ANOM_COLS = ["l_returnflag", "l_linestatus", "l_discount", "half_tax", "fixed", "spiky"]
_ANOM_T = [("l_returnflag", "string", "text"), ("l_linestatus", "string", "text"), ("l_discount", "double", "numeric"), ("half_tax", "double", "numeric"), ("fixed", "string", "text"), ("spiky", "double", "numeric")]


@query(
    "dataset_anomalies",
    f"WITH f AS ({facts_sql(_ANOM, _ANOM_T)}) SELECT 'High Missing Values' AS anomaly_type, column_name, missing_count AS affected, 95 AS confidence FROM f WHERE missing_pct > 50 "
    f"UNION ALL SELECT 'Duplicate Rows Detected', NULL, CAST({dup_sql(_ANOM, _ANOM_COLS)} AS BIGINT), 100 "
    "UNION ALL SELECT 'Constant Column', column_name, row_count, 100 FROM f WHERE unique_count = 1 "
    f"UNION ALL SELECT 'Statistical Outliers', column_name, outlier_count, 80 FROM ({outlier_sql(_ANOM, ['l_discount', 'half_tax', 'spiky'])}) WHERE outlier_pct > 5",
)
def _(t):
    df = t.lineitem.select(
        "l_returnflag", "l_linestatus", "l_discount", F.when(F.col("l_quantity") <= 20, F.col("l_tax")).alias("half_tax"), F.lit("x").alias("fixed"),
        F.when(F.col("l_quantity") >= 48, 1000.0).otherwise(F.col("l_quantity")).alias("spiky"),
    )
    return P.dataset_anomalies(df)


@query(
    "column_notes",
    f"SELECT column_name, data_type, CASE kind WHEN 'numeric' THEN printf('Numeric column with %d unique values. Range: %.2f to %.2f', unique_count, min_value, max_value) "
    "WHEN 'text' THEN printf('Categorical column with %d unique values', unique_count) ELSE printf('Column of type %s with %d unique values', data_type, unique_count) END AS summary, "
    "CASE kind WHEN 'numeric' THEN CASE WHEN missing_pct < 5 THEN 'Good quality numeric data. Consider for statistical analysis.' WHEN missing_pct < 20 THEN 'Some missing values. Consider for imputation strategies.' "
    "ELSE 'High missing values. Investigate data collection process.' END WHEN 'text' THEN CASE WHEN unique_count / row_count > 0.8 THEN 'High cardinality. Consider grouping or encoding strategies.' "
    "WHEN unique_count < 10 THEN 'Low cardinality. Good for categorical analysis.' ELSE 'Medium cardinality. Suitable for most analyses.' END "
    f"ELSE 'Review data type and consider appropriate preprocessing.' END AS recommendation FROM ({facts_sql('orders', ORDERS)})",
)
def _(t):
    return P.column_notes(t.orders)


_TOPS = {
    c: f"(SELECT string_agg(v, ', ' ORDER BY r) FROM (SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM {PART_SRC} s WHERE {c} IS NOT NULL GROUP BY 1) WHERE r <= 3)"
    for c, _, k in PART
    if k == "text"
}
_DICT = (
    "SELECT column_name, data_type, missing_count, missing_pct, unique_count, min_value, max_value, mean_value, CASE column_name "
    + " ".join(f"WHEN '{c}' THEN {q}" for c, q in _TOPS.items())
    + f" END AS top_values FROM ({facts_sql(PART_SRC, PART)})"
)


@query("data_dictionary", _DICT, rnd={4: "min_value max_value mean_value", 6: "missing_pct"})
def _(t):
    return P.data_dictionary(part_with_nulls(t))


@query(
    "dictionary_markdown",
    "SELECT column_name, concat_ws(chr(10), '### ' || column_name, '- **Type**: ' || data_type, printf('- **Missing**: %d (%.1f%%)', missing_count, missing_pct), "
    "'- **Unique Values**: ' || unique_count, CASE WHEN min_value IS NOT NULL THEN printf('- **Range**: %.2f to %.2f', min_value, max_value) END, '- **Top Values**: ' || top_values) AS markdown "
    f"FROM ({_DICT})",
)
def _(t):
    return P.dictionary_markdown(P.data_dictionary(part_with_nulls(t)))


@query(
    "quality_issues",
    f"WITH f AS ({facts_sql('(SELECT *, CASE WHEN c_nationkey < 10 THEN NULL ELSE c_acctbal END AS half_bal FROM customer)', CUSTOMER + [('half_bal', 'double', 'numeric')])}) "
    "SELECT column_name, 'missing values' AS issue, missing_pct AS issue_pct FROM f WHERE missing_pct > 20 "
    "UNION ALL SELECT column_name, 'high cardinality', 100.0 * unique_count / row_count FROM f WHERE kind = 'text' AND unique_count / row_count > 0.8",
    rnd={6: "issue_pct"},
)
def _(t):
    return P.quality_issues(t.customer.withColumn("half_bal", F.when(F.col("c_nationkey") >= 10, F.col("c_acctbal"))))


@query(
    "enrichment_delta",
    f"WITH m AS (SELECT {missing_sql(PART_SRC, PART_COLS)} AS m0) SELECT 6::BIGINT AS original_columns, 7::BIGINT AS enriched_columns, 1::BIGINT AS new_columns_added, 1 / 6 AS enrichment_ratio, m0 AS original_missing_values, "
    "0::BIGINT AS enriched_missing_values, CAST(100 AS DOUBLE) AS data_quality_improvement, 100.0 * (SELECT count(*) FROM part WHERE p_size > 5) / (SELECT count(*) FROM part) AS retention_pct FROM m",
    rnd={6: "enrichment_ratio data_quality_improvement retention_pct"},
)
def _(t):
    before = part_with_nulls(t)
    after = before.na.fill({"p_type": "Unknown"}).where("p_size > 5").withColumn("flag", F.lit(1))
    return P.enrichment_delta(before, after)


@query(
    "modeling_overview",
    _TOT + "SELECT 'data_quality' AS category, 'overview' AS priority, 'Missing Percentage' AS title, 100.0 * m / (n * 4) AS value FROM t "
    "UNION ALL SELECT 'data_quality', 'overview', 'Duplicate Percentage', 100.0 * d / n FROM t "
    "UNION ALL SELECT 'data_quality', 'high', 'Handle Missing Values', 100.0 * m / (n * 4) FROM t WHERE 100.0 * m / (n * 4) > 10 "
    "UNION ALL SELECT 'data_quality', 'medium', 'Remove Duplicates', 100.0 * d / n FROM t WHERE 100.0 * d / n > 5 "
    "UNION ALL SELECT 'preprocessing', 'high', 'High Cardinality Features', 1",
    rnd={6: "value"},
)
def _(t):
    return P.modeling_overview(part_slice(t))
