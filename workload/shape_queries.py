"""Sources, projections, joins, sorting and set operations."""

from pyspark.sql import functions as F

from tabloom.operators import joins as J
from tabloom.operators import ordered as O
from tabloom.operators import shape as S
from tabloom.sources.tables import read_table, write_table
from tabloom.session import shared_path
from workload.registry import query

NULL_TYPE = "CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END"
NULL_QTY = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END"
DATE_TEXT = (
    "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') "
    "WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') "
    "WHEN 4 THEN '31/12/' || strftime(o_orderdate, '%Y') ELSE 'no date' END"
)


def part_with_nulls(t):
    return t.part.withColumn("p_type", F.expr(NULL_TYPE))


def lineitem_with_nulls(t):
    return t.lineitem.withColumn("l_quantity", F.expr(NULL_QTY))


def orders_with_date_text(t):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(d, "MM/dd/yyyy"))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 3, F.date_format(d, "MM/dd/yyyy HH:mm:ss"))
        .when(k == 4, F.concat(F.lit("31/12/"), F.date_format(d, "yyyy")))
        .otherwise("no date")
    )
    return t.orders.select("o_orderkey", text.alias("d"))


@query("read_table", "SELECT * FROM part")
def _(t):
    return read_table(t.spark, f"{t._dir}/part.parquet")


@query("write_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    # round trip through CSV in the shared folder of the session
    path = shared_path(t.spark, "write_table")
    write_table(t.customer, path, "csv")
    return read_table(t.spark, path, "csv", schema=t.customer.schema)


@query("preview_first", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def _(t):
    return S.preview(t.orders, 20, "o_orderkey")


@query("preview_last", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def _(t):
    return S.preview(t.orders, 50, "o_orderkey", last=True)


@query("sample_rows", "SELECT * FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || '|42'), c_custkey LIMIT 100")
def _(t):
    return S.sample_rows(t.customer, "c_custkey", 100, 42)


@query(
    "split_random",
    "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey) "
    "<= ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders",
)
def _(t):
    return O.split_random(t.orders.select("o_orderkey"), "o_orderkey", 0.2, 42)


@query(
    "split_stratified",
    "SELECT o_orderkey, o_orderpriority, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey) "
    "<= ceil(count(*) OVER (PARTITION BY o_orderpriority) * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders",
)
def _(t):
    return O.split_random(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", 0.2, 42, stratify="o_orderpriority")


@query(
    "split_by_order",
    "SELECT event_id, ts, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= CAST(floor(count(*) OVER () * 0.7) AS BIGINT) THEN 'Reference' ELSE 'Current' END AS drift_period FROM events",
)
def _(t):
    return O.split_by_order(t.events.select("event_id", "ts"), ["ts", "event_id"], 0.7)


@query(
    "records_from_json",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t):
    return S.records_from_json(t.events.select("event_id", "props"), "props", "k bigint", ["k"])


@query("rows_to_json", "SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS json FROM nation")
def _(t):
    return S.rows_to_json(t.nation)


@query("select_cols", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return S.select_cols(t.orders, ["o_orderkey", "o_totalprice"])


@query("drop_cols", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def _(t):
    return S.drop_cols(t.orders, ["o_totalprice", "o_orderpriority"])


@query("drop_null_target", f"SELECT * FROM (SELECT p_partkey, {NULL_TYPE} AS p_type FROM part) WHERE p_type IS NOT NULL")
def _(t):
    return S.drop_null_target(part_with_nulls(t).select("p_partkey", "p_type"), "p_type")


@query(
    "drop_any_null",
    f"SELECT * FROM (SELECT l_orderkey, l_linenumber, {NULL_QTY} AS l_quantity FROM lineitem) WHERE l_quantity IS NOT NULL",
)
def _(t):
    return S.drop_any_null(lineitem_with_nulls(t).select("l_orderkey", "l_linenumber", "l_quantity"))


@query("outside_range", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
def _(t):
    return S.outside_range(t.customer, "c_acctbal", 0, 9000).select("c_custkey", "c_acctbal")


@query(
    "to_numeric",
    "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN 'x' || CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS v FROM orders",
)
def _(t):
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    return S.to_numeric(t.orders.select("o_orderkey", text.alias("v")), "v")


_PARSED = (
    "coalesce(TRY_CAST(d AS TIMESTAMP), try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%d/%m/%Y'), "
    "try_strptime(d, '%Y-%m-%d %H:%M:%S'), try_strptime(d, '%m/%d/%Y %H:%M:%S'))"
)


@query("to_datetime", f"SELECT o_orderkey, {_PARSED} AS d FROM (SELECT o_orderkey, {DATE_TEXT} AS d FROM orders)")
def _(t):
    return S.to_datetime(orders_with_date_text(t), "d")


@query(
    "looks_datetime",
    f"SELECT 'd' AS column_name, bool_and({_PARSED} IS NOT NULL) AS is_datetime FROM (SELECT o_orderkey, {DATE_TEXT} AS d FROM orders ORDER BY o_orderkey LIMIT 50)",
)
def _(t):
    return S.looks_datetime(orders_with_date_text(t), "d", "o_orderkey", 50)


@query("with_metadata", "SELECT *, true AS reviewed, '2024-01-01 00:00:00' AS run_time, CAST(0.5 AS DOUBLE) AS score FROM supplier")
def _(t):
    return S.with_metadata(t.supplier, reviewed=True, run_time="2024-01-01 00:00:00", score=0.5)


@query(
    "null_quality_flag",
    f"SELECT p_partkey, p_type, CASE WHEN p_type IS NULL THEN 0 ELSE 100 END AS p_type_quality_score FROM (SELECT p_partkey, {NULL_TYPE} AS p_type FROM part)",
)
def _(t):
    return S.null_quality_flag(part_with_nulls(t).select("p_partkey", "p_type"), "p_type")


@query(
    "column_quality_cols",
    f"WITH b AS (SELECT p_partkey, {NULL_TYPE} AS p_type FROM part) SELECT *, "
    "(SELECT 100.0 * count(p_type) / count(*) FROM b) AS p_type_quality_score, CAST(100 AS DOUBLE) AS p_partkey_quality_score FROM b",
    rnd={6: "p_type_quality_score"},
)
def _(t):
    return S.column_quality_cols(part_with_nulls(t).select("p_partkey", "p_type"), ["p_type", "p_partkey"])


@query("lookup_join", "SELECT c.*, coalesce(s.n, 0) AS n FROM customer c LEFT JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) s USING (c_mktsegment)")
def _(t):
    return J.lookup_join(t.customer, J.value_counts(t.customer, "c_mktsegment"), "c_mktsegment", {"n": 0})


@query(
    "attach_by_key",
    "SELECT o.o_orderkey, o.o_totalprice, l.n_lines FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey",
)
def _(t):
    feats = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return J.attach_by_key(t.orders.select("o_orderkey", "o_totalprice"), feats, "o_orderkey")


@query(
    "update_by_key",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders",
    rnd={4: "o_totalprice"},
)
def _(t):
    updates = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return J.update_by_key(t.orders.select("o_orderkey", "o_totalprice"), updates, "o_orderkey", "o_totalprice")


@query("anti_split", "SELECT * FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')")
def _(t):
    ref = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.anti_split(t.customer, ref, "c_custkey")


@query("flag_members", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS is_member FROM customer")
def _(t):
    ids = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return J.flag_members(t.customer.select("c_custkey"), ids, "c_custkey")


@query(
    "align_counts",
    "WITH a AS (SELECT l_discount, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_discount < 0.08 GROUP BY 1), "
    "b AS (SELECT l_discount, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' AND l_discount > 0.02 GROUP BY 1) "
    "SELECT coalesce(a.l_discount, b.l_discount) AS l_discount, coalesce(a.n, 0) AS reference_count, coalesce(b.n, 0) AS current_count FROM a FULL JOIN b ON a.l_discount = b.l_discount",
)
def _(t):
    a = t.lineitem.where("l_returnflag = 'R' AND l_discount < 0.08D")
    b = t.lineitem.where("l_returnflag <> 'R' AND l_discount > 0.02D")
    return J.align_counts(a, b, "l_discount")


@query(
    "dimension_enrich",
    "SELECT c_custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def _(t):
    a = J.dimension_enrich(t.customer.select("c_custkey", "c_nationkey"), t.nation, "c_nationkey", "n_nationkey", {"n_name": "nation", "n_regionkey": "rk"})
    return J.dimension_enrich(a, t.region, "rk", "r_regionkey", {"r_name": "region"}).select("c_custkey", "nation", "region")


@query("sort_by", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def _(t):
    return S.sort_by(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query("top_k", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return S.top_k(t.orders, "o_totalprice", 10, ["o_orderkey"])


@query(
    "top_k_per_group",
    "SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3",
)
def _(t):
    return S.top_k_per_group(t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_orderpriority", "o_totalprice", 3, ["o_orderkey"])


@query(
    "append_rows",
    "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return S.append_rows(a, t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("category_union", "SELECT c_nationkey AS nk FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return S.category_union(t.customer.select(F.col("c_nationkey").alias("nk")), t.supplier.select(F.col("s_nationkey").alias("nk")), "nk")
