"""Windows, cleaning, encodings and scalar functions."""

from pyspark.sql import functions as F

from tabloom.functions import scalars as X
from tabloom.operators import clean as C
from tabloom.operators import features as E
from tabloom.operators import ordered as O
from workload.profile_queries import iqr_sql
from workload.registry import query
from workload.shape_queries import NULL_QTY, NULL_TYPE, part_with_nulls

NULL_PRICE = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END"
ORD_SRC = f"(SELECT o_orderkey, o_orderpriority, o_orderdate, {NULL_PRICE} AS price FROM orders)"


def orders_with_nulls(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate", F.expr(NULL_PRICE).alias("price"))


_ROLL = (
    "avg(price) OVER (ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS price_rolling_mean_3, "
    "stddev_samp(price) OVER (ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS price_rolling_std_3"
)
_LAG = "lag(price, 1) OVER (ORDER BY o_orderkey) AS price_lag_1, lag(price, 2) OVER (ORDER BY o_orderkey) AS price_lag_2"
_CUM = ", ".join(
    f"CASE WHEN price IS NOT NULL THEN {f}(price) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) END AS price_cum{f}" for f in ("sum", "max", "min")
)
_Z = f"(price - (SELECT avg(price) FROM {ORD_SRC} s)) / (SELECT stddev_samp(price) FROM {ORD_SRC} s) AS price_zscore"
_PR = (
    "CASE WHEN price IS NOT NULL THEN (rank() OVER (ORDER BY price NULLS LAST) + (count(*) OVER (PARTITION BY price) - 1) / 2.0) / count(price) OVER () END AS price_percentile_rank"
)


@query("rolling_stats", f"SELECT *, {_ROLL} FROM {ORD_SRC} s", rnd={4: "price_rolling_mean_3 price_rolling_std_3"})
def _(t):
    return O.rolling_stats(orders_with_nulls(t), "price", "o_orderkey", 3)


@query(
    "rolling_stats_by_group",
    "SELECT o_orderkey, o_orderpriority, price, avg(price) OVER w AS price_rolling_mean_3, stddev_samp(price) OVER w AS price_rolling_std_3 "
    f"FROM {ORD_SRC} s WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    rnd={4: "price_rolling_mean_3 price_rolling_std_3"},
)
def _(t):
    return O.rolling_stats(orders_with_nulls(t).drop("o_orderdate"), "price", "o_orderkey", 3, "o_orderpriority", block_rows=4000)


@query("lags", f"SELECT *, {_LAG} FROM {ORD_SRC} s")
def _(t):
    return O.lags(orders_with_nulls(t), "price", "o_orderkey", (1, 2))


@query("cumulative", f"SELECT *, {_CUM} FROM {ORD_SRC} s", rnd={2: "price_cumsum"})
def _(t):
    return O.cumulative(orders_with_nulls(t), "price", "o_orderkey")


@query("zscore", f"SELECT *, {_Z} FROM {ORD_SRC} s", rnd={6: "price_zscore"})
def _(t):
    return O.zscore(orders_with_nulls(t), "price")


@query(
    "percentile_rank",
    "SELECT l_orderkey, l_partkey, l_quantity, (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) / count(l_quantity) OVER () AS l_quantity_percentile_rank FROM lineitem",
    rnd={8: "l_quantity_percentile_rank"},
)
def _(t):
    return O.percentile_rank(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), "l_quantity")


@query(
    "step_diff",
    "SELECT event_id, ts, CAST(epoch(ts) AS BIGINT) - CAST(epoch(lag(ts) OVER (ORDER BY ts, event_id)) AS BIGINT) AS step_seconds FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)",
)
def _(t):
    df = t.events.select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return O.step_diff(df, "ts", ["ts", "event_id"])


@query("dedupe_whole_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def _(t):
    return O.dedupe_first(t.lineitem.select("l_returnflag", "l_linestatus", "l_discount"))


@query(
    "dedupe_first",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1",
)
def _(t):
    return O.dedupe_first(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("row_index", "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM events")
def _(t):
    return O.row_index(t.events.select("event_id", "ts"), ["ts", "event_id"])


@query("row_index_by_group", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_index FROM events")
def _(t):
    return O.row_index(t.events.select("event_id", "event_type", "ts"), ["ts", "event_id"], "event_type").drop("ts")


@query(
    "group_ratio",
    "SELECT l_orderkey, l_partkey, l_extendedprice, l_returnflag, l_extendedprice / (avg(l_extendedprice) OVER (PARTITION BY l_returnflag) + 1e-8) AS l_extendedprice_to_l_returnflag_mean FROM lineitem",
    rnd={6: "l_extendedprice_to_l_returnflag_mean"},
)
def _(t):
    return E.group_ratio(t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag"), "l_returnflag", "l_extendedprice")


@query(
    "group_stat_features",
    "SELECT l_orderkey, l_tax, l_returnflag, coalesce(avg(l_tax) OVER w, 0) AS l_returnflag_l_tax_mean, coalesce(stddev_samp(l_tax) OVER w, 0) AS l_returnflag_l_tax_std, count(l_tax) OVER w AS l_returnflag_l_tax_count FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)",
    rnd={6: "l_returnflag_l_tax_mean l_returnflag_l_tax_std"},
)
def _(t):
    return E.group_stat_features(t.lineitem.select("l_orderkey", "l_tax", "l_returnflag"), ["l_returnflag"], ["l_tax"])


_ORDC = "o_orderkey, o_totalprice"
_IMP = (
    f"WITH b AS (SELECT p_partkey, p_brand, {NULL_TYPE} AS p_type, CASE WHEN p_size > 45 THEN NULL ELSE p_retailprice END AS price FROM part) "
    "SELECT p_partkey, p_brand, coalesce(p_type, {text}) AS p_type, coalesce(price, {num}) AS price {extra} FROM b"
)
_MODE = "(SELECT p_type FROM b WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1)"
_MED = "(SELECT quantile_cont(price, 0.5) FROM b)"


def part_gaps(t):
    return part_with_nulls(t).select("p_partkey", "p_brand", "p_type", F.expr("CASE WHEN p_size > 45 THEN NULL ELSE p_retailprice END").alias("price"))


@query("impute_median_mode", _IMP.format(text=_MODE, num=_MED, extra=""), rnd={4: "price"})
def _(t):
    return C.impute(part_gaps(t), ["p_type", "price"])


@query("impute_mean_unknown", _IMP.format(text="'Unknown'", num="(SELECT avg(price) FROM b)", extra=""), rnd={4: "price"})
def _(t):
    return C.impute(part_gaps(t), ["p_type", "price"], numeric="mean", text="Unknown")


@query(
    "impute_with_confidence",
    _IMP.format(text=_MODE, num=_MED, extra=", CAST(p_type IS NOT NULL AS DOUBLE) AS p_type_imputation_confidence, CAST(price IS NOT NULL AS DOUBLE) AS price_imputation_confidence"),
    rnd={4: "price"},
)
def _(t):
    return C.impute_with_confidence(part_gaps(t), ["p_brand", "p_type", "price"])


@query(
    "clean_table",
    f"WITH b AS (SELECT p_brand, {NULL_TYPE} AS p_type, p_size FROM part) SELECT DISTINCT lower(trim(p_brand)) AS p_brand, lower(trim(coalesce(p_type, {_MODE}))) AS p_type, p_size FROM b",
)
def _(t):
    return C.clean_table(part_with_nulls(t).select("p_brand", "p_type", "p_size"), ["p_brand", "p_type"])


STRIPPED = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
TITLE = "list_aggregate(list_transform(regexp_extract_all({c}, '(\\p{{L}}+|\\P{{L}}+)'), lambda r: CASE WHEN r[1:1] = 'ß' THEN 'Ss' ELSE upper(r[1:1]) END || lower(r[2:])), 'string_agg', '')"


@query(
    "clean_standardize",
    "SELECT c_custkey, c_name, c_mktsegment, lower(trim(c_name)) AS contact_email, concat('Tel. ', c_custkey, '-', c_nationkey) AS phone, "
    f"{TITLE.format(c='trim(c_name)')} AS c_name_cleaned, {TITLE.format(c='trim(c_mktsegment)')} AS c_mktsegment_cleaned, lower(trim(c_name)) AS contact_email_cleaned, "
    "regexp_replace(concat('Tel. ', c_custkey, '-', c_nationkey), '[^0-9]', '', 'g') AS phone_cleaned FROM customer",
)
def _(t):
    df = t.customer.select(
        "c_custkey", "c_name", "c_mktsegment", F.lower("c_name").alias("contact_email"), F.concat(F.lit("Tel. "), "c_custkey", F.lit("-"), "c_nationkey").alias("phone")
    )
    return C.clean_standardize(df.union(df), ["c_name", "c_mktsegment", "contact_email", "phone"], "c_custkey")


@query(
    "validate_text",
    f"SELECT doc_id, text AS t, (CASE WHEN length({STRIPPED}) < 2 THEN 0.5::DOUBLE ELSE 1 END) * (CASE WHEN regexp_matches({STRIPPED}, '\\?|#|NULL|null|N/A|n/a') THEN 0.3::DOUBLE ELSE 1 END) * (CASE WHEN length({STRIPPED}) > 200 THEN 0.7::DOUBLE ELSE 1 END) AS t_data_quality, "
    f"{TITLE.format(c=STRIPPED)} AS t_standardized FROM documents",
    rnd={6: "t_data_quality"},
)
def _(t):
    return C.validate_text(t.documents.select("doc_id", F.col("text").alias("t")), ["t"])


@query(
    "flag_anomalies",
    f"WITH b AS ({iqr_sql('(SELECT *, CASE WHEN l_quantity >= 48 THEN l_quantity * 20 ELSE l_quantity END AS q FROM lineitem)', ['q'])}) "
    "SELECT l_orderkey, l_partkey, q, CAST(q < lower_bound OR q > upper_bound AS INTEGER) AS q_is_anomaly, CASE WHEN q < lower_bound THEN lower_bound - q WHEN q > upper_bound THEN q - upper_bound ELSE 0 END AS q_anomaly_score "
    "FROM (SELECT *, CASE WHEN l_quantity >= 48 THEN l_quantity * 20 ELSE l_quantity END AS q FROM lineitem), b",
    rnd={4: "q_anomaly_score"},
)
def _(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", F.expr("CASE WHEN l_quantity >= 48 THEN l_quantity * 20 ELSE l_quantity END").alias("q"))
    return C.flag_anomalies(df, ["q"])


@query(
    "change_log",
    f"WITH b AS (SELECT p_brand, {NULL_TYPE} AS p_type, p_size FROM part), c AS (SELECT DISTINCT lower(trim(p_brand)) AS p_brand, lower(trim(coalesce(p_type, {_MODE}))) AS p_type, p_size FROM b) "
    "SELECT 'p_type' AS column_name, 'filled missing values' AS action, (SELECT count(*) FROM b WHERE p_type IS NULL) AS affected "
    "UNION ALL SELECT 'p_brand', 'standardized text', (SELECT count(*) FROM b) UNION ALL SELECT 'p_type', 'standardized text', (SELECT count(*) FROM b) "
    "UNION ALL SELECT NULL, 'removed duplicate rows', (SELECT count(*) FROM b) - (SELECT count(*) FROM c)",
)
def _(t):
    before = part_with_nulls(t).select("p_brand", "p_type", "p_size")
    return C.change_log(before, C.clean_table(before, ["p_brand", "p_type"]), ["p_brand", "p_type"])


_ONE = ", ".join(f"coalesce(o_orderpriority = '{v}', false) AS \"o_orderpriority_onehot_{v}\"" for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
_LABEL = "(SELECT count(DISTINCT coalesce(i.{c}, 'missing')) FROM {src} i WHERE coalesce(i.{c}, 'missing') < coalesce(b.{c}, 'missing')) AS {c}_label_encoded"


@query("label_encode", f"SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY coalesce(p_type, 'missing')) - 1 AS p_type_label_encoded FROM (SELECT p_partkey, {NULL_TYPE} AS p_type FROM part)")
def _(t):
    return E.label_encode(part_with_nulls(t).select("p_partkey", "p_type"), "p_type")


@query("one_hot", f"SELECT o_orderkey, o_orderpriority, {_ONE}, o_orderpriority IS NULL AS o_orderpriority_onehot_nan FROM orders")
def _(t):
    return E.one_hot(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("frequency_encode", f"SELECT *, count(p_type) OVER (PARTITION BY p_type) AS p_type_frequency FROM (SELECT p_partkey, {NULL_TYPE} AS p_type FROM part)")
def _(t):
    return E.frequency_encode(part_with_nulls(t).select("p_partkey", "p_type"), "p_type")


@query(
    "categorical_features",
    "SELECT o_orderkey, o_orderpriority, " + _ONE + ", o_orderpriority IS NULL AS o_orderpriority_onehot_nan, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority_label_encoded, "
    "count(*) OVER (PARTITION BY o_orderpriority) AS o_orderpriority_frequency, CAST(length(o_orderpriority) AS INTEGER) AS o_orderpriority_length FROM orders",
)
def _(t):
    return E.categorical_features(t.orders.select("o_orderkey", "o_orderpriority"))


@query(
    "temporal_features",
    "SELECT event_id, ts, " + ", ".join(
        f"CAST({e} AS INTEGER) AS ts_{n}"
        for n, e in {
            "year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "dayofweek": "isodow(ts) - 1", "hour": "hour(ts)", "quarter": "quarter(ts)",
            "is_weekend": "isodow(ts) >= 6", "is_month_start": "day(ts) = 1", "is_month_end": "CAST(ts AS DATE) = last_day(ts)",
        }.items()
    ) + " FROM events",
)
def _(t):
    return E.temporal_features(t.events.select("event_id", "ts"))


@query(
    "statistical_features",
    f"SELECT *, {_ROLL}, {_LAG}, {_CUM}, {_Z}, {_PR} FROM {ORD_SRC} s",
    rnd={4: "price_rolling_mean_3 price_rolling_std_3", 2: "price_cumsum", 6: "price_zscore", 8: "price_percentile_rank"},
)
def _(t):
    return E.statistical_features(orders_with_nulls(t), "price", "o_orderkey", block_rows=6000)


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]
_INTER = ", ".join(f"{a} * {b} AS {a}_x_{b}, {a} + {b} AS {a}_plus_{b}, {a} / ({b} + 1e-8) AS {a}_div_{b}, {a} - {b} AS {a}_minus_{b}" for a, b in _PAIRS)


@query("interaction_features", f"SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, {_INTER} FROM lineitem")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    return E.interaction_features(df, ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    "polynomial_features",
    "SELECT c_custkey, c_acctbal, c_acctbal * c_acctbal AS c_acctbal_squared, sqrt(abs(c_acctbal)) AS c_acctbal_sqrt FROM customer",
    rnd={3: "c_acctbal_squared", 6: "c_acctbal_sqrt"},
)
def _(t):
    return E.polynomial_features(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"])


_RS = "list_filter([CAST(l_quantity AS DOUBLE), l_extendedprice, l_tax], lambda v: v IS NOT NULL)"


@query(
    "row_stats",
    f"SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_tax, list_sum({_RS}) AS numeric_sum, list_avg({_RS}) AS numeric_mean, list_stddev_samp({_RS}) AS numeric_std FROM (SELECT l_orderkey, l_partkey, {NULL_QTY} AS l_quantity, l_extendedprice, l_tax FROM lineitem)",
    rnd={4: "numeric_sum numeric_mean numeric_std"},
)
def _(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", F.expr(NULL_QTY).alias("l_quantity"), "l_extendedprice", "l_tax")
    return E.row_stats(df, ["l_quantity", "l_extendedprice", "l_tax"])


@query(
    "auto_features",
    "SELECT p_partkey, p_size, p_retailprice, p_size * p_retailprice AS p_size_x_p_retailprice, p_size / (p_retailprice + 1e-8) AS p_size_div_p_retailprice, "
    "p_size * p_size AS p_size_squared, sqrt(abs(p_size)) AS p_size_sqrt, p_retailprice * p_retailprice AS p_retailprice_squared, sqrt(abs(p_retailprice)) AS p_retailprice_sqrt, "
    "p_size + p_retailprice AS numeric_sum, (p_size + p_retailprice) / 2 AS numeric_mean, list_stddev_samp([CAST(p_size AS DOUBLE), p_retailprice]) AS numeric_std FROM part",
    rnd={4: "p_size_x_p_retailprice p_retailprice_squared p_retailprice_sqrt p_size_sqrt numeric_sum numeric_mean numeric_std", 6: "p_size_div_p_retailprice"},
)
def _(t):
    return E.auto_features(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@query(
    "transform_columns",
    "WITH b AS (SELECT p_partkey, p_brand, p_size, CAST(p_size AS DOUBLE) * p_size * p_size * p_size * p_size AS big FROM part) SELECT *, (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS p_size_standardized, "
    "(big - avg(big) OVER ()) / stddev_samp(big) OVER () AS big_standardized, ln(1 + big) AS big_log, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_encoded FROM b",
    rnd={6: "p_size_standardized big_standardized big_log"},
)
def _(t):
    df = t.part.select("p_partkey", "p_brand", "p_size", F.expr("CAST(p_size AS DOUBLE) * p_size * p_size * p_size * p_size").alias("big"))
    return E.transform_columns(df, ["p_brand", "p_size", "big"])


@query(
    "spec_features",
    "SELECT p_partkey, p_brand, p_size, p_retailprice, p_retailprice / (p_size + 1e-8) AS price_per_size, p_retailprice / (avg(p_retailprice) OVER (PARTITION BY p_brand) + 1e-8) AS price_vs_brand FROM part",
    rnd={6: "price_per_size price_vs_brand"},
)
def _(t):
    df = t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return E.spec_features(df, [("price_per_size", "p_retailprice", "p_size"), ("price_vs_brand", "p_retailprice", "p_brand")])


_W = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@query(
    "text_features",
    f"WITH b AS (SELECT doc_id, text, {_W} AS w FROM documents) SELECT doc_id, CAST(len(w) AS INTEGER) AS text_word_count, CAST(length(text) AS INTEGER) AS text_char_count, CAST(len(list_distinct(w)) AS INTEGER) AS text_unique_words, "
    "CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END AS text_avg_word_length, "
    + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS text_{n}_count" for n, p in (("exclamation", "!"), ("question", "\\?"), ("uppercase", "[A-Z]"), ("digit", "[0-9]"), ("sentence", "[.!?]+")))
    + " FROM b",
    rnd={6: "text_avg_word_length"},
)
def _(t):
    return E.text_features(t.documents.select("doc_id", "text"), ["text"]).drop("text")


@query(
    "scale_standard",
    "SELECT c_custkey, c_acctbal, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS c_acctbal_scaled FROM customer",
    rnd={6: "c_acctbal_scaled"},
)
def _(t):
    return E.scale_standard(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal")


@query(
    "build_features",
    "SELECT o_orderkey, o_orderdate, o_orderstatus, o_totalprice, "
    + ", ".join(
        f"CAST({e} AS INTEGER) AS o_orderdate_{n}"
        for n, e in {
            "year": "year(o_orderdate)", "month": "month(o_orderdate)", "day": "day(o_orderdate)", "dayofweek": "isodow(o_orderdate) - 1", "hour": "hour(o_orderdate)", "quarter": "quarter(o_orderdate)",
            "is_weekend": "isodow(o_orderdate) >= 6", "is_month_start": "day(o_orderdate) = 1", "is_month_end": "CAST(o_orderdate AS DATE) = last_day(o_orderdate)",
        }.items()
    )
    + ", o_orderstatus = 'F' AS o_orderstatus_onehot_F, o_orderstatus = 'O' AS o_orderstatus_onehot_O, o_orderstatus = 'P' AS o_orderstatus_onehot_P, false AS o_orderstatus_onehot_nan, "
    "dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus_label_encoded, count(*) OVER (PARTITION BY o_orderstatus) AS o_orderstatus_frequency, 1 AS o_orderstatus_length, "
    "avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS o_orderstatus_o_totalprice_mean, stddev_samp(o_totalprice) OVER (PARTITION BY o_orderstatus) AS o_orderstatus_o_totalprice_std, "
    "count(*) OVER (PARTITION BY o_orderstatus) AS o_orderstatus_o_totalprice_count FROM orders",
    rnd={4: "o_orderstatus_o_totalprice_mean o_orderstatus_o_totalprice_std"},
)
def _(t):
    df = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    return E.build_features(df, ["o_orderdate", "o_orderstatus", "o_totalprice"], ["temporal", "categorical", "aggregation"])


@query(
    "normalize_text",
    f"SELECT doc_id, regexp_replace(lower({STRIPPED}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS clean FROM documents",
)
def _(t):
    return t.documents.select("doc_id", X.normalize_text("text").alias("clean"))


@query("title_case", f"SELECT doc_id, {TITLE.format(c='text')} AS title FROM documents")
def _(t):
    return t.documents.select("doc_id", X.title_case("text").alias("title"))


@query("digits_only", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, lower(trim(c_name)) AS email FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.digits_only("c_name").alias("digits"), X.lower_email("c_name").alias("email"))


@query("concat_text", f"SELECT p_partkey, concat_ws(' ', p_brand, coalesce(p_type, '')) AS joined FROM (SELECT p_partkey, p_brand, {NULL_TYPE} AS p_type FROM part)")
def _(t):
    return part_with_nulls(t).select("p_partkey", X.concat_text(["p_brand", "p_type"]).alias("joined"))


@query(
    "contains_patterns",
    "SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}') AS has_email, regexp_matches(text, '(^|[^\\p{L}\\p{N}_])\\d{3}[-.]?\\d{3}[-.]?\\d{4}([^\\p{L}\\p{N}_]|$)') AS has_phone, "
    "regexp_matches(text, '(^|[^\\p{L}\\p{N}_])\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}([^\\p{L}\\p{N}_]|$)') AS has_date, contains(text, '@') AS has_at, regexp_matches(text, '[0-9]') AS has_digit FROM documents",
)
def _(t):
    return t.documents.select(
        "doc_id", X.contains_email("text").alias("has_email"), X.contains_phone("text").alias("has_phone"), X.contains_date("text").alias("has_date"),
        X.contains_at("text").alias("has_at"), X.contains_digit("text").alias("has_digit"),
    )


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS short FROM documents")
def _(t):
    return t.documents.select("doc_id", X.truncate_text("text").alias("short"))


@query(
    "numeric_helpers",
    "SELECT o_orderkey, greatest(1000, least(200000, o_totalprice)) AS clamped, o_totalprice / (o_custkey + 1e-8) AS ratio, ln(1 + o_totalprice) AS logged, abs(o_totalprice - 150000) AS distance FROM orders",
    rnd={8: "logged"},
)
def _(t):
    return t.orders.select(
        "o_orderkey", X.clamp("o_totalprice", 1000.0, 200000.0).alias("clamped"), X.safe_ratio("o_totalprice", "o_custkey").alias("ratio"),
        F.log1p("o_totalprice").alias("logged"), F.abs(F.col("o_totalprice") - 150000).alias("distance"),
    )


@query(
    "ngrams",
    f"WITH b AS (SELECT doc_id, {_W} AS w FROM documents) SELECT doc_id, array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS bigrams FROM b",
)
def _(t):
    return t.documents.select("doc_id", F.array_join(X.ngrams(X.words("text"), 2), "|").alias("bigrams"))


@query("slice_array", f"SELECT doc_id, array_to_string({_W}[1:5], '|') AS first_words FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.slice_array(X.words("text"), 5), "|").alias("first_words"))


@query("band", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'Large' WHEN p_size >= 15 THEN 'Middle' ELSE 'Small' END AS size_band FROM part")
def _(t):
    return t.part.select("p_partkey", X.band("p_size", [40, 15], ["Large", "Middle", "Small"]).alias("size_band"))
