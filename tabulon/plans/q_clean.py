"""Queries over cleaning, joins and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import clean as C
from tabulon.plans.q_profile import NULLED, _with_nulls, fine, long, r
from tabulon.plans.registry import query, table


@query(f"SELECT c_custkey, {r('c_acctbal')} AS c_acctbal, c_mktsegment FROM {NULLED} WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL")
def customer_complete_rows(spark, d):
    return fine(C.drop_incomplete_rows(_with_nulls(spark, d)), "c_acctbal")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def customer_dropped_columns(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit(1).alias("one"), F.lit(None).cast("string").alias("nothing"), F.when(F.col("c_custkey") % 3 == 0, 1.0 * F.col("c_custkey")).alias("thin"))
    return C.drop_constant_columns(C.drop_sparse_columns(C.drop_empty_columns(rows), 0.5))


@query(f"SELECT l_orderkey, l_linenumber, {r('l_quantity')} AS l_quantity, {r('l_extendedprice')} AS l_extendedprice FROM lineitem")
def lineitem_uncorrelated(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (2 * F.col("l_quantity") + 1).alias("twice"))
    return fine(C.drop_correlated_columns(rows), "l_quantity", "l_extendedprice")


@query("SELECT doc_id, length(trim(text)) BETWEEN 10 AND 10000 AND length(regexp_replace(trim(text), '[^\\p{L}]', '', 'g')) >= 0.3 * length(trim(text)) AS valid FROM documents")
def documents_valid_text(spark, d):
    return table(spark, d, "documents").select("doc_id", C.valid_text(F.col("text")).alias("valid"))


@query(f"SELECT o_orderkey, {r('least(greatest(o_totalprice, a - 1.5 * (b - a)), b + 1.5 * (b - a))')} AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)")
def price_capped(spark, d):
    return fine(C.clip(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), "o_totalprice")


@query(f"SELECT o_orderkey, {r('least(greatest(o_totalprice, a), b)')} AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b FROM orders WHERE o_orderkey % 2 = 0)")
def price_quantile_clipped(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return fine(C.clip(rows, ["o_totalprice"], method="quantile", fit_on=rows.where("o_orderkey % 2 = 0")), "o_totalprice")


@query("SELECT o_orderkey FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) WHERE abs(o_totalprice - m) <= 2 * s")
def price_without_outliers(spark, d):
    return C.drop_outliers(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], method="zscore", limit=2.0).select("o_orderkey")


@query("SELECT 'x' AS column_name, count(*) AS outlier_count, min(o_orderkey) AS first_key FROM orders, (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM (SELECT o_totalprice * o_totalprice AS x FROM orders)) WHERE o_totalprice * o_totalprice < a - 1.5 * (b - a) OR o_totalprice * o_totalprice > b + 1.5 * (b - a) HAVING count(*) > 0")
def price_outlier_report(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * F.col("o_totalprice")).alias("x"))
    return C.outlier_report(rows, "o_orderkey", ["x"]).select("column_name", "outlier_count", F.element_at("keys", 1).alias("first_key"))


@query(f"SELECT c_custkey, {r('coalesce(c_acctbal, (SELECT median(c_acctbal) FROM ' + NULLED + '))')} AS c_acctbal, coalesce(c_mktsegment, (SELECT c_mktsegment FROM {NULLED} WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)) AS c_mktsegment FROM {NULLED}")
def acctbal_imputed(spark, d):
    return fine(C.fill_values(_with_nulls(spark, d), {"c_acctbal": "median", "c_mktsegment": "mode"}), "c_acctbal")


@query(f"SELECT 'c_custkey' AS column_name, 0.0::DOUBLE AS null_ratio, 'none' AS strategy UNION ALL SELECT 'c_acctbal', {r('1 - count(c_acctbal) / count(*)', 6)}, CASE WHEN abs(skewness(c_acctbal)) > 1 THEN 'median' ELSE 'mean' END FROM {NULLED} UNION ALL SELECT 'c_mktsegment', {r('1 - count(c_mktsegment) / count(*)', 6)}, 'mode' FROM {NULLED}")
def customer_fill_strategies(spark, d):
    return fine(C.fill_strategies(_with_nulls(spark, d)), "null_ratio", digits=6)


_GAPPY = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 4 != 0 THEN value END AS value FROM events)"


def _gappy(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"))


@query(f"SELECT event_id, {r('last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} AS value FROM {_GAPPY}")
def value_ffill(spark, d):
    return fine(C.carried(_gappy(spark, d), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value"), "value")


@query(f"SELECT event_id, {r('first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS value FROM {_GAPPY}")
def value_bfill(spark, d):
    return fine(C.carried(_gappy(spark, d), "value", ["ts", "event_id"], ["user_id"], how="backward").select("event_id", "value"), "value")


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {_GAPPY}),
q AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, last_value(value IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1, first_value(value IGNORE NULLS) OVER a AS v1 FROM p
 WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, {r('coalesce(value, v0 + coalesce((v1 - v0) / nullif(i1 - i0, 0), 0) * (i - i0))')} AS value FROM q""")
def value_interp(spark, d):
    return fine(C.interpolated(_gappy(spark, d), "value", "ts", ["user_id"], tie="event_id").select("event_id", "value"), "value")


@query()
def acctbal_iterative_impute(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")).alias("l_extendedprice"), "l_quantity")
    return C.iterative_impute(rows, ["l_extendedprice", "l_quantity"], rounds=2)


@query("SELECT event_id, (event_id % 100)::DOUBLE AS number FROM events")
def events_converted(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 100).cast("string").alias("number"))
    return C.convert_types(rows)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events) WHERE i = 1")
def events_first_by_key(spark, d):
    return C.keep_first(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query()
def customer_preprocessed(spark, d):
    return C.preprocess(_with_nulls(spark, d))[0]


@query("SELECT c_custkey, c_acctbal AS balance, coalesce(r_name, 'unknown') AS region FROM customer LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3) ON c_nationkey = n_nationkey")
def customer_context(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    return C.with_context(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), "c_nationkey"), nations, ["c_nationkey"]).drop("c_nationkey")


@query("SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT p_brand AS b, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand HAVING count(*) > 3) ON p_brand = b")
def brand_lookup(spark, d):
    parts = table(spark, d, "part")
    counts = parts.where("p_partkey % 2 = 0").groupBy("p_brand").agg(F.count("*").alias("n")).where("n > 3")
    return C.lookup(parts.select("p_partkey", "p_brand"), "p_brand", counts, key="p_brand", value="n", otherwise=0, out="n").select("p_partkey", "n")


@query("SELECT DISTINCT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_unseen(spark, d):
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return C.unseen(table(spark, d, "customer").select("c_custkey"), seen, ["c_custkey"]).distinct()


@query("""SELECT o_orderkey, o_custkey, l_partkey FROM (SELECT o_orderkey, o_custkey, l_partkey, count(*) OVER (PARTITION BY o_custkey) AS u, count(*) OVER (PARTITION BY l_partkey) AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE u >= 30 AND i >= 30""")
def active_interactions(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "l_partkey")
    return C.active(rows, "o_custkey", "l_partkey", 30, 30)


@query("""SELECT a.event_id, CASE WHEN epoch(date_trunc('second', a.ts)) - epoch(date_trunc('second', b.ts)) <= 86400 THEN b.k END AS k FROM (SELECT * FROM events WHERE event_id % 2 = 0) a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS k FROM events WHERE event_id % 2 = 1 GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def events_asof_features(spark, d):
    events = table(spark, d, "events")
    features = events.where("event_id % 2 = 1").select("user_id", "ts", F.col("event_id").alias("k"))
    return C.as_of(events.where("event_id % 2 = 0").select("event_id", "user_id", "ts"), features, "user_id", "ts", ["k"], ttl_seconds=86_400).select("event_id", "k")


@query("SELECT o_orderkey, CASE WHEN i < floor(0.8 * n) THEN 'train' ELSE 'test' END AS part, i AS position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)")
def orders_chronological_split(spark, d):
    return C.chronological_split(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5(o_orderkey || ':42'), 1, 8))::BIGINT < floor(0.1 * 4294967296)")
def orders_sample(spark, d):
    return C.sample_by_key(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.1)


@query("SELECT p_partkey, trim(substr(regexp_replace(p_name || '<b>\"x\"', '[<>\"'']', '', 'g'), 1, 12)) AS name FROM part")
def part_sanitised(spark, d):
    return table(spark, d, "part").select("p_partkey", C.sanitise(F.concat("p_name", F.lit('<b>"x"')), max_length=12).alias("name"))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_orders_by_customer(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return long(table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 3"), "rank")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey")


@query("SELECT n_nationkey AS k, 'nation' AS side FROM nation UNION ALL SELECT r_regionkey, 'region' FROM region")
def united_keys(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.lit("nation").alias("side"))
    return a.unionByName(table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("k"), F.lit("region").alias("side")))
