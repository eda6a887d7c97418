"""Queries over profiles and quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.stats import rounded
from tabulon.operators import profile as P
from tabulon.operators import quality as Q
from tabulon.plans.registry import query, table

NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
MEASURES = NUMBERS[3:]
TEXTS = ("l_returnflag", "l_linestatus")


def r(x: str, digits: int = 4) -> str:
    """The SQL twin of ``rounded``."""
    return f"(round(({x})::DOUBLE + 1e-9, {digits}) + 0.0)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def fine(df, *names, digits: int = 4):
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


def _profile_sql() -> str:
    none = "NULL::DOUBLE"
    parts = []
    for c in NUMBERS:
        kind = "'id'" if c.endswith("key") else f"CASE WHEN count(DISTINCT {c}) > 0.95 * count(*) THEN 'id' ELSE 'numeric' END"
        parts.append(
            f"SELECT '{c}' AS column_name, {kind} AS logical_type, count(*) AS n_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, avg({c}) AS mean_value, stddev_samp({c}) AS std_value, quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.75)::DOUBLE AS q3, "
            f"(SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM lineitem) WHERE b > a AND ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))) AS outlier_count, NULL::BIGINT AS min_length, NULL::BIGINT AS max_length, {none} AS avg_length FROM lineitem"
        )
    for c in TEXTS:
        parts.append(
            f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) < 0.1 * count(*) THEN 'categorical' ELSE 'text' END, count(*), count(*) - count({c}), count(DISTINCT {c}), {none}, {none}, {none}, {none}, {none}, {none}, 0, min(length({c})), max(length({c})), avg(length({c})) FROM lineitem"
        )
    parts.append(f"SELECT 'l_shipdate', 'datetime', count(*), count(*) - count(l_shipdate), count(DISTINCT l_shipdate), {none}, {none}, {none}, {none}, {none}, {none}, 0, NULL, NULL, {none} FROM lineitem")
    return union(parts)


_QUALITY_SQL = f"""
WITH profile AS ({_profile_sql()}),
scored AS (SELECT *, greatest(0, least(1, 1 - (null_count + 0.2 * outlier_count) / n_rows - 0.1 * (CASE WHEN null_count > 0.5 * n_rows THEN 1 ELSE 0 END + CASE WHEN outlier_count > 0.1 * n_rows THEN 1 ELSE 0 END))) AS column_score FROM profile),
dup AS (SELECT (sum(n) - count(*)) / sum(n) AS d FROM (SELECT count(*) AS n FROM lineitem GROUP BY ALL)),
total AS (SELECT sum(null_count) / sum(n_rows) AS m, avg(column_score) AS s FROM scored),
score AS (SELECT m, d, 0.4 * (1 - m) + 0.2 * (1 - least(2 * d, 1.0)) + 0.4 * s AS t FROM total, dup)
SELECT column_name, logical_type, n_rows, null_count, unique_count, {", ".join(f"{r(c, 7)} AS {c}" for c in ("min_value", "max_value", "mean_value", "std_value", "q1", "q3"))}, outlier_count::BIGINT AS outlier_count,
 min_length, max_length, {r("avg_length", 7)} AS avg_length, {r("column_score", 7)} AS column_score, {r("m", 7)} AS table_missing_ratio, {r("d", 7)} AS table_duplicate_ratio, {r("t", 7)} AS table_score,
 CASE WHEN t >= 0.95 THEN 'excellent' WHEN t >= 0.8 THEN 'good' WHEN t >= 0.6 THEN 'fair' WHEN t >= 0.4 THEN 'poor' ELSE 'critical' END AS quality_level FROM scored, score
""".replace("SELECT count(*) AS n FROM lineitem GROUP BY ALL", "SELECT count(*) AS n FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem) GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")


@query(_QUALITY_SQL)
def lineitem_quality(spark, d):
    report = Q.quality_report(table(spark, d, "lineitem").select(*NUMBERS, *TEXTS, "l_shipdate")).drop("median")
    report = long(report, "n_rows", "null_count", "unique_count", "outlier_count", "min_length", "max_length")
    return fine(report, "min_value", "max_value", "mean_value", "std_value", "q1", "q3", "avg_length", "column_score", "table_missing_ratio", "table_duplicate_ratio", "table_score", digits=7)


@query(union([f"SELECT '{c}' AS column_name, count({c}) AS n, {r(f'min({c})')} AS min_value, {r(f'max({c})')} AS max_value, {r(f'avg({c})')} AS mean_value, {r(f'stddev_samp({c})')} AS std_value, {r(f'skewness({c})')} AS skewness, {r(f'kurtosis({c})')} AS kurtosis, {r(f'quantile_cont({c}, 0.25)')} AS q1, {r(f'median({c})')} AS median, {r(f'quantile_cont({c}, 0.75)')} AS q3 FROM lineitem" for c in MEASURES]))
def lineitem_profile(spark, d):
    return fine(P.numeric_summary(table(spark, d, "lineitem"), list(MEASURES)).drop("null_count"), "min_value", "max_value", "mean_value", "std_value", "skewness", "kurtosis", "q1", "median", "q3")


def _with_nulls(spark, d):
    """Customers whose balance or segment is null by a key rule, as the given tables hold no nulls."""
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))


NULLED = "(SELECT c_custkey, CASE WHEN c_custkey % 7 != 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 11 != 0 THEN c_mktsegment END AS c_mktsegment FROM customer)"


@query(union([f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, {r(f'1 - count({c}) / count(*)', 6)} AS null_ratio, 1 - count({c}) / count(*) > 0.1 AS concerning FROM {NULLED}" for c in ("c_custkey", "c_acctbal", "c_mktsegment")]))
def customer_missing(spark, d):
    return fine(P.missing_summary(_with_nulls(spark, d), 0.1), "null_ratio", digits=6)


@query(f"SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS duplicate_count, {r('sum(n - 1) / sum(n)', 6)} AS duplicate_ratio FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")
def events_duplicates(spark, d):
    return fine(P.duplicate_summary(table(spark, d, "events"), ["user_id", "event_type"]), "duplicate_ratio", digits=6)


@query(union([f"SELECT '{c}' AS column_name, {kind} AS logical_type, count(DISTINCT {c}) AS unique_count FROM customer" for c, kind in (("c_custkey", "'id'"), ("c_name", "CASE WHEN count(DISTINCT c_name) < 0.1 * count(*) OR (count(DISTINCT c_name) < 0.2 * count(*) AND avg(length(c_name)) < 20) THEN 'categorical' ELSE 'text' END"), ("c_nationkey", "'id'"), ("c_acctbal", "CASE WHEN count(DISTINCT c_acctbal) > 0.95 * count(*) THEN 'id' ELSE 'numeric' END"), ("c_mktsegment", "CASE WHEN count(DISTINCT c_mktsegment) < 0.1 * count(*) THEN 'categorical' ELSE 'text' END"))]))
def customer_types(spark, d):
    return long(P.column_types(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), "unique_count").drop("unique_ratio")


@query(union([f"SELECT '{c}' AS column_name, {e} AS feature_type FROM lineitem" for c, e in (("l_linenumber", "CASE WHEN count(DISTINCT l_linenumber) = 2 THEN 'binary' WHEN count(DISTINCT l_linenumber) < 20 THEN 'ordinal' ELSE 'numeric' END"), ("l_discount", "CASE WHEN count(DISTINCT l_discount) = 2 THEN 'binary' ELSE 'numeric' END"), ("l_returnflag", "CASE WHEN count(DISTINCT l_returnflag) = 2 THEN 'binary' ELSE 'categorical' END"), ("l_linestatus", "CASE WHEN count(DISTINCT l_linestatus) = 2 THEN 'binary' ELSE 'categorical' END"), ("l_shipdate", "'datetime'"), ("l_extendedprice", "'target'"))]).replace("SELECT 'l_shipdate' AS column_name, 'datetime' AS feature_type FROM lineitem", "SELECT 'l_shipdate', 'datetime'").replace("SELECT 'l_extendedprice' AS column_name, 'target' AS feature_type FROM lineitem", "SELECT 'l_extendedprice', 'target'"))
def lineitem_feature_types(spark, d):
    return P.feature_types(table(spark, d, "lineitem").select("l_linenumber", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice"), "l_extendedprice")


@query(union([f"SELECT '{c}' AS column_name, {r('a - 1.5 * (b - a)')} AS lower, {r('b + 1.5 * (b - a)')} AS upper, (SELECT count(*) FROM lineitem WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outlier_count FROM (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem)" for c in ("l_quantity", "l_extendedprice")]))
def lineitem_outliers(spark, d):
    return fine(P.outlier_counts(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), "lower", "upper")


@query(union([f"SELECT '{c}' AS column_name, count(*) FILTER (abs({c} - m) > 2 * s) AS outlier_count, {r(f'count(*) FILTER (abs({c} - m) > 2 * s) / count({c})', 6)} AS outlier_ratio FROM {t}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {t})" for t, c in (("orders", "o_totalprice"),)]))
def orders_zscore_outliers(spark, d):
    return fine(P.zscore_outliers(table(spark, d, "orders"), ["o_totalprice"], 2.0), "outlier_ratio", digits=6)


@query(union([f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})')} AS correlation FROM lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]))
def lineitem_correlations(spark, d):
    return fine(P.correlation_pairs(table(spark, d, "lineitem"), list(MEASURES)), "correlation")


@query(union([f"SELECT '{c}' AS column_name, {r('x')} AS correlation, {r('x * sqrt(n - 2) / sqrt(1 - x * x)', 3)} AS t, n FROM (SELECT corr({c}, l_extendedprice) AS x, count(*) AS n FROM lineitem)" for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax")]))
def price_correlations(spark, d):
    found = P.target_correlation(table(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice"), "l_extendedprice")
    return fine(fine(found, "correlation"), "t", digits=3)


@query(union([f"SELECT '{c}' AS column_name, rank, value, n, {r('n / total', 6)} AS share FROM (SELECT {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, sum(count(*)) OVER () AS total FROM part GROUP BY {c}) WHERE rank <= 5" for c in ("p_brand", "p_type")]))
def part_top_values(spark, d):
    return fine(long(P.top_values(table(spark, d, "part"), ["p_brand", "p_type"], 5), "rank"), "share", digits=6)


@query(f"SELECT o_orderstatus AS label, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 6)} AS share, {r('max(count(*)) OVER () / min(count(*)) OVER ()', 6)} AS imbalance_ratio FROM orders GROUP BY o_orderstatus")
def order_status_distribution(spark, d):
    return fine(P.class_distribution(table(spark, d, "orders"), "o_orderstatus"), "share", "imbalance_ratio", digits=6)


@query(union([f"SELECT c_mktsegment AS \"group\", count(*) AS size, {r('count(*) / (SELECT count(*) FROM customer)', 6)} AS share, '{c}' AS column_name, {r(f'avg({c})')} AS mean_value, {r(f'stddev_samp({c})')} AS std_value, {r(f'min({c})')} AS min_value, {r(f'max({c})')} AS max_value, {r(f'median({c})')} AS median_value FROM customer GROUP BY c_mktsegment" for c in ("c_acctbal", "c_nationkey")]))
def segment_profiles(spark, d):
    found = P.group_profile(table(spark, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"])
    return fine(fine(found, "share", digits=6), "mean_value", "std_value", "min_value", "max_value", "median_value")


@query(f"SELECT {r('(2 * sum(i * v) - (count(*) + 1) * sum(v)) / (count(*) * sum(v))', 6)} AS gini, {r('max(v) / sum(v)', 6)} AS top_share, count(*) FILTER (v > 0.01) AS effective_count FROM (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY p_brand))")
def brand_concentration(spark, d):
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    return fine(P.concentration(brands, "v"), "gini", "top_share", digits=6)


@query(f"SELECT event_type AS name, count(value) AS n, {r('sum(value)')} AS total, {r('avg(value)')} AS mean, {r('min(value)')} AS least, {r('max(value)')} AS most, {r('arg_max(value, (ts, value))')} AS latest FROM events WHERE ts >= TIMESTAMP '1995-01-01' GROUP BY event_type")
def events_metric_window(spark, d):
    return fine(P.metric_window(table(spark, d, "events"), "1995-01-01", name="event_type"), "total", "mean", "least", "most", "latest")


@query(f"SELECT event_type AS name, count(*) AS n, {r('avg(value)')} AS mean, {r('min(value)')} AS least, {r('max(value)')} AS most, {', '.join(r(f'max(value) FILTER (i = floor(n * {p})::BIGINT)') + f' AS {a}' for p, a in ((0.5, 'median'), (0.95, 'p95'), (0.99, 'p99')))} FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def events_latency(spark, d):
    return fine(P.latency_profile(table(spark, d, "events"), name="event_type"), "mean", "least", "most", "median", "p95", "p99")


@query(f"SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS slow_count, {r('avg(value)')} AS mean, {r('count(*) / greatest(epoch(date_trunc(\'second\', max(ts))) - epoch(date_trunc(\'second\', min(ts))), 1)', 8)} AS per_second, {r('100.0 * count(*) FILTER (event_type = \'error\') / count(*)')} AS error_percent FROM events")
def events_requests(spark, d):
    found = P.request_summary(table(spark, d, "events"), failed=F.col("event_type") == "error", slow=50.0)
    return fine(fine(found, "mean", "error_percent"), "per_second", digits=8)


@query("SELECT 'orders' AS table_name, column_name, sum(n)::BIGINT AS n_values, count(*) AS unique_count FROM (" + union([f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM orders GROUP BY {c}" for c in ("o_orderstatus", "o_orderpriority")]) + ") GROUP BY ROLLUP (column_name)")
def orders_value_rollup(spark, d):
    counts = P.value_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    return counts.rollup("column_name").agg(F.sum("n").alias("n_values"), F.count("*").alias("unique_count")).withColumn("table_name", F.lit("orders"))


@query(union([f"SELECT '{c}' AS column_name, CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END AS narrow_type FROM lineitem" for c in NUMBERS[:4]] + [f"SELECT '{c}', CASE WHEN bool_and(abs({c} - {c}::FLOAT::DOUBLE) <= 1e-8 + 1e-5 * abs({c})) THEN 'float' ELSE 'double' END FROM lineitem" for c in NUMBERS[4:]]))
def lineitem_narrow_types(spark, d):
    return P.narrowest_types(table(spark, d, "lineitem").select(*NUMBERS))


@query("SELECT 'v' AS column_name, 3::BIGINT AS n_classes, true AS mixed")
def events_mixed_types(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return long(P.mixed_types(table(spark, d, "events").select(v.alias("v"))), "n_classes")


@query(f"SELECT CASE WHEN count(*) > 0 THEN 'yyyy-MM-dd' END AS format, {r('1.0')} AS ratio FROM orders")
def orders_date_format(spark, d):
    return P.date_format(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "day")


@query(union([f"SELECT '{p}' AS policy, CASE WHEN {e} THEN 'regression' ELSE 'classification' END AS task, u AS unique_count FROM (SELECT count(DISTINCT l_quantity) AS u, count(*) AS n FROM lineitem)" for p, e in (("ratio", "u > 0.1 * n"), ("count_and_ratio", "u > 20 AND u > 0.1 * n"), ("small", "NOT (u <= 20 AND u < 0.05 * n)"), ("bounded", "NOT (u < least(20.0, 0.1 * n))"))]))
def lineitem_task_types(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity")
    parts = [P.task_type(rows, "l_quantity", p).withColumn("policy", F.lit(p)) for p in ("ratio", "count_and_ratio", "small", "bounded")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH n AS (SELECT count(*) > 100 AS many, least((avg(length(text)) > 50)::INT + (avg(length(lang)) > 50)::INT + (avg(length(source)) > 50)::INT, 1) AS long FROM documents),
s AS (SELECT unnest(['tabular', 'time_series', 'text', 'anomaly', 'clustering']) AS kind, unnest([0.4 * 2 / 5 + 0.3 * many::INT, 0.2, 0.8 * long + 0.2 * 3 / 5, 0.3 + 0.4 * 2 / 5, 0.4 + 0.4 * 2 / 5]::DOUBLE[]) AS raw FROM n)
SELECT kind, {r('raw / max(raw) OVER ()', 6)} AS score, row_number() OVER (ORDER BY raw DESC, kind) AS rank FROM s""")
def documents_kind_scores(spark, d):
    return fine(long(P.dataset_kind_scores(table(spark, d, "documents")), "rank"), "score", digits=6)


@query()
def orders_fingerprint(spark, d):
    return P.fingerprint(table(spark, d, "orders"))


@query()
def lineitem_approximate_profile(spark, d):
    rows = table(spark, d, "lineitem")
    return P.numeric_summary(rows, list(MEASURES), exact=False).join(P.distinct_counts(rows, list(MEASURES), exact=False), "column_name")


_FACTS = f"""facts AS (SELECT (SELECT count(*) FROM {NULLED}) AS n, (SELECT (3 * count(*) - count(c_custkey) - count(c_acctbal) - count(c_mktsegment)) / (3 * count(*)) FROM {NULLED}) AS m,
 (SELECT (sum(k) - count(*)) / sum(k) FROM (SELECT count(*) AS k FROM {NULLED} GROUP BY c_custkey, c_acctbal, c_mktsegment)) AS d)"""


@query(f"WITH {_FACTS} SELECT n AS n_rows, {r('greatest(0, 1 - 0.3 * m - 0.2 * d)', 6)} AS batch_score, {r('(greatest(0, 1 - 2 * m) + greatest(0, 1 - 2 * d) + 1) / 3', 6)} AS preparation_score, {r('(greatest(0, 1 - 2 * m) + greatest(0, 1 - 3 * d) + 1 + least(1, n / 1000)) / 4', 6)} AS pipeline_score, {r('((1 - m) + (1 - m) + (1 - d)) / 3', 6)} AS monitoring_score FROM facts")
def customer_scores(spark, d):
    return fine(Q.scores(_with_nulls(spark, d)), "batch_score", "preparation_score", "pipeline_score", "monitoring_score", digits=6)


@query(f"WITH {_FACTS}, o AS (SELECT avg(x) AS x FROM (" + union([f"SELECT count(*) FILTER (abs({c} - a) > 3 * s) / count({c}) AS x FROM {NULLED}, (SELECT avg({c}) AS a, stddev_pop({c}) AS s FROM {NULLED})" for c in ("c_custkey", "c_acctbal")]) + f")), s AS (SELECT 1 - m AS a, 1 - d AS b, greatest(0, 1 - 3 * x) AS c FROM facts, o) SELECT {r('a', 6)} AS missing_score, {r('b', 6)} AS duplicate_score, {r('c', 6)} AS outlier_score, {r('(a + b + c) / 3', 6)} AS score, CASE WHEN (a + b + c) / 3 >= 0.8 THEN 'valid' WHEN (a + b + c) / 3 >= 0.5 THEN 'warning' ELSE 'error' END AS status FROM s")
def customer_validation(spark, d):
    return fine(Q.validation_score(_with_nulls(spark, d)), "missing_score", "duplicate_score", "outlier_score", "score", digits=6)


@query("SELECT 'c_name' AS column_name, 'integer' AS expected, count(c_name) AS n, count(*) FILTER (try_cast(c_name AS DOUBLE) IS NULL) AS invalid FROM customer UNION ALL SELECT 'c_acctbal', 'integer', count(*), count(*) FILTER (c_acctbal != floor(c_acctbal)) FROM customer UNION ALL SELECT 'c_mktsegment', 'categorical', count(*), CASE WHEN count(DISTINCT c_mktsegment) >= 0.8 * count(*) THEN count(*) ELSE 0 END FROM customer")
def customer_conformance(spark, d):
    return Q.conformance(table(spark, d, "customer"), {"c_name": "integer", "c_acctbal": "integer", "c_mktsegment": "categorical"})


@query(f"SELECT 'missing_column' AS issue_type, 'error' AS severity, 'c_phone' AS column_name, NULL::DOUBLE AS value, 'required column c_phone is missing' AS message UNION ALL SELECT 'missing_values', 'warning', column_name, {r('x', 6)}, 'impute or drop the column' FROM (SELECT 'c_acctbal' AS column_name, 1 - count(c_acctbal) / count(*) AS x FROM {NULLED} UNION ALL SELECT 'c_mktsegment', 1 - count(c_mktsegment) / count(*) FROM {NULLED}) WHERE x > 0.05")
def customer_issues(spark, d):
    return fine(Q.issues(_with_nulls(spark, d), required=["c_custkey", "c_phone"], max_missing=0.05), "value", digits=6)


@query(f"SELECT 'collect_rows' AS rule, 'info' AS severity, 'n_rows' AS metric, count(*)::DOUBLE AS value, 'Collect more rows' AS message FROM customer HAVING count(*) < 1000")
def customer_recommendations(spark, d):
    return Q.recommendations(_with_nulls(spark, d))


@query("SELECT 'few_rows' AS rule, 'warning' AS severity, 'n_rows' AS metric, count(*)::DOUBLE AS value, 'few rows' AS message FROM nation HAVING count(*) BETWEEN 10 AND 49")
def nation_dataset_check(spark, d):
    return Q.dataset_check(table(spark, d, "nation"))


@query("SELECT CASE WHEN min(s) < 0.5 THEN 'error' WHEN min(s) < 0.99 THEN 'warning' ELSE 'valid' END AS status, " + r("avg(s)", 6) + f" AS score, count(*) AS n FROM (SELECT c_mktsegment, count(c_acctbal) / count(*) AS s FROM {NULLED} GROUP BY c_mktsegment)")
def segment_combined_status(spark, d):
    by = _with_nulls(spark, d).groupBy("c_mktsegment").agg((F.count("c_acctbal") / F.count("*")).alias("score"))
    s = F.col("score")
    return fine(Q.combined_status(by.select(F.when(s < 0.5, "error").when(s < 0.99, "warning").otherwise("valid").alias("status"), "score")), "score", digits=6)


@query("SELECT 'mostly_missing' AS issue_type, 'thin' AS column_name")
def orders_final_check(spark, d):
    thin = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice"))
    return Q.final_check(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", thin.alias("thin")))
