"""Queries that fit on one table and apply to another, and further tests, series and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import clean as C
from tabulon.operators import features as E
from tabulon.operators import fitted as T
from tabulon.operators import groups as G
from tabulon.operators import insights as I
from tabulon.operators import metrics as V
from tabulon.operators import models as M
from tabulon.operators import series as S
from tabulon.operators import text as X
from tabulon.plans.q_features import _FOLDS, _fold_scores
from tabulon.plans.q_models import _ORDERS, _lines, _two_lines, _vectors
from tabulon.plans.q_profile import fine, long, r, union
from tabulon.plans.q_series import _DAILY, DAY, _daily, _key
from tabulon.plans.q_text import _TERMS, _W, _docs
from tabulon.plans.registry import query, table

# --- fit once, apply later ---------------------------------------------------------------------------------------


@query(f"""WITH q AS (SELECT quantile_cont(c_acctbal, 0.05) AS a, quantile_cont(c_acctbal, 0.95) AS b FROM customer), c AS (SELECT greatest(a, least(b, c_acctbal)) AS v FROM customer, q), m AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM c)
SELECT s_suppkey, {r('(greatest(a, least(b, s_acctbal)) - m) / s')} AS balance FROM supplier, q, m""")
def suppliers_scaled_as_customers(spark, d):
    state = T.fit_numbers(table(spark, d, "customer").select(F.col("c_acctbal").alias("balance")), ["balance"], clip=(0.05, 0.95))
    return fine(T.apply_numbers(table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance")), state), "balance")


@query(f"WITH c AS (SELECT l_linestatus AS v, count(*) / (SELECT count(*) FROM lineitem) AS k FROM lineitem GROUP BY 1) SELECT o_orderkey, {r('coalesce(k, 0)', 6)} AS status_code FROM orders LEFT JOIN c ON v = o_orderstatus")
def orders_coded_as_lines(spark, d):
    codes = T.fit_codes(table(spark, d, "lineitem").select(F.col("l_linestatus").alias("status")), ["status"])
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return fine(T.apply_codes(orders, codes, ["status"]).select("o_orderkey", "status_code"), "status_code", digits=6)


_PAIR = "(SELECT vec_id, label, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1 FROM embeddings)"


def _pair(spark, d):
    return _vectors(spark, d).select("vec_id", F.col("label").alias("cluster"), *[F.col("embedding")[i].alias(f"e{i}") for i in range(2)])


@query(f"""WITH c AS (SELECT label, avg(e0) AS m0, avg(e1) AS m1 FROM {_PAIR} GROUP BY label), x AS (SELECT vec_id, label, sqrt((e0 - m0) ** 2 + (e1 - m1) ** 2) AS d FROM (SELECT vec_id, e0, e1 FROM {_PAIR}), c)
SELECT vec_id, arg_min(label, (d, label))::BIGINT AS "cluster", {r('min(d)')} AS distance FROM x GROUP BY vec_id""")
def vectors_nearest_centre(spark, d):
    rows = _pair(spark, d)
    found = T.nearest_centre(rows.select("vec_id", "e0", "e1"), ["e0", "e1"], T.group_centres(rows, ["e0", "e1"]))
    return fine(long(found.select("vec_id", "cluster", "distance"), "cluster"), "distance")


@query(f"""WITH m AS (SELECT avg(c_acctbal) AS m0, avg(c_nationkey) AS m1, var_samp(c_acctbal) AS a, var_samp(c_nationkey) AS b, covar_samp(c_acctbal, c_nationkey) AS c FROM customer)
SELECT s_suppkey, {r('(b * (s_acctbal - m0) ** 2 - 2 * c * (s_acctbal - m0) * (s_nationkey - m1) + a * (s_nationkey - m1) ** 2) / (a * b - c * c)')} AS distance FROM supplier, m""")
def suppliers_under_customer_envelope(spark, d):
    envelope = T.fit_envelope(table(spark, d, "customer").select(F.col("c_acctbal").alias("b"), F.col("c_nationkey").alias("n")), ["b", "n"])
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("b"), F.col("s_nationkey").alias("n"))
    return fine(T.envelope_distance(rows, envelope).select("s_suppkey", "distance"), "distance")


@query(union([f"SELECT 'price' AS detector, {s}::DOUBLE AS share, {r('any_value(q)')} AS \"limit\", count(*) FILTER (o_totalprice > q) AS flagged, {r('(avg(o_totalprice) FILTER (o_totalprice > q) - avg(o_totalprice) FILTER (o_totalprice <= q)) / stddev_pop(o_totalprice)')} AS separation FROM orders, (SELECT quantile_cont(o_totalprice, {1 - s}) AS q FROM orders)" for s in (0.01, 0.05, 0.1)]))
def orders_detector_sweep(spark, d):
    return fine(T.detector_sweep(table(spark, d, "orders"), {"price": F.col("o_totalprice")}), "limit", "separation")


# --- tests, selection, columns -----------------------------------------------------------------------------------

_DIFFERENCES = f"f AS ({_FOLDS}), p AS (SELECT a.model AS model_a, b.model AS model_b, round(a.score - b.score, 12) AS d FROM f a JOIN f b ON a.fold = b.fold AND a.model < b.model), k AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY model_a, model_b, abs(d)) AS t FROM p WHERE d <> 0)"


@query(f"WITH {_DIFFERENCES}, s AS (SELECT model_a, model_b, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, sum(t * t - 1) AS t FROM k GROUP BY ALL) SELECT model_a, model_b, n, w::DOUBLE AS w, {r('(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48)', 6)} AS z FROM s")
def price_wilcoxon(spark, d):
    return fine(V.wilcoxon(_fold_scores(spark, d)).select("model_a", "model_b", "n", "w", "z"), "z", digits=6)


@query(f"WITH f AS ({_FOLDS}), k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2 AS r, count(*) OVER (PARTITION BY fold, score) AS t FROM f), m AS (SELECT model, sum(r) AS r, count(*) AS n FROM k GROUP BY model), s AS (SELECT count(*) AS m, max(n) AS n, sum(r * r) AS rr FROM m), t AS (SELECT sum(t * t - 1) AS t FROM k) SELECT m AS models, n AS folds, {r('(12 / (n * m * (m + 1)) * rr - 3 * n * (m + 1)) / (1 - t / (n * m * (m * m - 1)))', 6)} AS statistic FROM s, t")
def price_friedman(spark, d):
    return fine(V.friedman(_fold_scores(spark, d)).select("models", "folds", "statistic"), "statistic", digits=6)


@query(union([f"SELECT '{c}' AS column_name, {r(f'corr({c}, y) ** 2 * (count(*) - 2) / (1 - corr({c}, y) ** 2)', 3)} AS f FROM ({_ORDERS})" for c in ("quantity", "price")]))
def order_f_regression(spark, d):
    return fine(E.f_regression(_lines(spark, d), ["quantity", "price"], "y"), "f", digits=3)


@query()
def order_features_left(spark, d):
    """The columns that recursive elimination by a tree's importances leaves."""
    rows = _lines(spark, d)
    columns = ["quantity", "price", "discount"]
    left = E.eliminate(rows, columns, lambda some: M.importance(M.fit(rows, "y", some, "tree"), some), keep=2)
    return spark.createDataFrame([(c, c in left) for c in columns], "column_name string, kept boolean")


@query(f"WITH k AS (SELECT c_custkey, (rank() OVER (ORDER BY c_acctbal) - 1 + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2) / (count(*) OVER () - 1) AS p FROM customer) SELECT c_custkey, {r('p', 6)} AS place FROM k")
def acctbal_places(spark, d):
    return fine(E.quantile_transform(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "place").select("c_custkey", "place"), "place", digits=6)


@query("WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) SELECT c_custkey, s_suppkey FROM c FULL JOIN s USING (i)")
def customers_beside_suppliers(spark, d):
    return C.append_columns(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"])


@query()
def order_cross_validation(spark, d):
    return M.cross_validated(_lines(spark, d), "y", ["quantity", "price"], "key", ["linear", "tree"], k=2)


@query(f"WITH p AS (SELECT DISTINCT vec_id, label FROM embeddings), n AS (SELECT label, count(*) / (SELECT count(*) FROM p) AS s FROM p GROUP BY label) SELECT label::BIGINT AS label, {r('s', 6)} AS share FROM n")
def embedding_label_shares(spark, d):
    from tabulon.operators.profile import class_distribution

    return fine(long(class_distribution(_vectors(spark, d), "label").select("label", "share"), "label"), "share", digits=6)


_C = ["c_custkey", "c_nationkey", "c_acctbal"]
_CORRELATIONS = [f"abs(corr({a}::DOUBLE, {b}::DOUBLE))" for i, a in enumerate(_C) for b in _C[i + 1 :]]


@query(f"SELECT count(*) AS n_rows, 5::BIGINT AS n_columns, 0::BIGINT AS columns_with_missing, 0::BIGINT AS missing_values, 0.0::DOUBLE AS missing_ratio, 3::BIGINT AS numeric_columns, 2::BIGINT AS other_columns, {r('2.0 / 3')} AS kind_diversity, {' + '.join(f'({c} > 0.9)::BIGINT' for c in _CORRELATIONS)} AS high_pairs, {r(f'2 * ({" + ".join(_CORRELATIONS)}) / 9', 6)} AS mean_correlation FROM customer")
def customer_transformed_metrics(spark, d):
    out = E.transformed_metrics(table(spark, d, "customer").select(*_C, "c_name", "c_mktsegment"))
    return fine(fine(long(out, "n_columns", "columns_with_missing", "numeric_columns", "other_columns"), "kind_diversity"), "mean_correlation", digits=6)


_WITHIN = "c AS (SELECT label, count(*) AS n, avg(e0) AS m0, avg(e1) AS m1, var_pop(e0) * count(*) AS a, var_pop(e1) * count(*) AS b, covar_pop(e0, e1) * count(*) AS c FROM {} WHERE label < 2 GROUP BY label), w AS (SELECT sum(a) / (sum(n) - 2) AS a, sum(b) / (sum(n) - 2) AS b, sum(c) / (sum(n) - 2) AS c, max(m0) FILTER (label = 1) - max(m0) FILTER (label = 0) AS d0, max(m1) FILTER (label = 1) - max(m1) FILTER (label = 0) AS d1 FROM c), v AS (SELECT *, (b * d0 - c * d1) / (a * b - c * c) AS v0, (a * d1 - c * d0) / (a * b - c * c) AS v1 FROM w), u AS (SELECT v0 / sqrt(a * v0 * v0 + 2 * c * v0 * v1 + b * v1 * v1) AS u0, v1 / sqrt(a * v0 * v0 + 2 * c * v0 * v1 + b * v1 * v1) AS u1 FROM v), t AS (SELECT sign(CASE WHEN abs(u0) >= abs(u1) THEN u0 ELSE u1 END) AS s, * FROM u)"


@query(f"WITH {_WITHIN.format(_PAIR)} SELECT 1::BIGINT AS axis, 'e0' AS column_name, {r('s * u0')} AS weight FROM t UNION ALL SELECT 1, 'e1', {r('s * u1')} FROM t")
def embedding_discriminant(spark, d):
    """The axis that parts the first two labels, by two columns."""
    out = E.discriminant(_pair(spark, d).where(F.col("cluster") < 2), ["e0", "e1"], "cluster")
    return fine(long(out.select("axis", "column_name", "weight"), "axis"), "weight")


@query()
def embedding_discriminants(spark, d):
    """Every vector on the two axes that part the labels best, by all its numbers."""
    rows = _vectors(spark, d)
    wide = rows.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return E.discriminated(wide, E.discriminant(wide, [f"e{i}" for i in range(64)], "label", 2)).select("vec_id", "label", "axis_1", "axis_2")


@query()
def order_ensemble(spark, d):
    """What a vote of models gains over each, on the orders that are held out."""
    from tabulon.plans.pipelines import ensemble

    return ensemble(_lines(spark, d), "y", ["quantity", "price"], "key", ["linear", "tree"])["metrics"]


@query()
def embedding_gap(spark, d):
    return G.gap_statistic(_pair(spark, d).select("e0", "e1"), ["e0", "e1"], range(1, 4))


@query()
def part_graph_groups(spark, d):
    from tabulon.operators.recs import content_similarity

    parts = table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_type", "p_size")
    return G.graph_groups(content_similarity(parts, ["p_brand", "p_type", "p_size"], neighbours=5), 3, rounds=5)


# --- series ------------------------------------------------------------------------------------------------------


@query(f"WITH {_DAILY} SELECT series, {DAY} AS ts, {r('(y - avg(y) OVER (PARTITION BY series)) / stddev_pop(y) OVER (PARTITION BY series)')} AS y FROM daily")
def daily_scaled(spark, d):
    rows = _daily(spark, d)
    return fine(_key(S.scaled(rows, S.scale_factors(rows), ["y"])), "y")


@query(f"WITH {_DAILY} SELECT series, {DAY} AS ts, {r('y')} AS y FROM daily")
def daily_unscaled(spark, d):
    rows = _daily(spark, d)
    factors = S.scale_factors(rows, "robust")
    return fine(_key(S.scaled(S.scaled(rows, factors, ["y"]), factors, ["y"], back=True)), "y")


@query(f"WITH {_DAILY}, e AS (SELECT ts, count(*)::DOUBLE AS n FROM daily GROUP BY ts) SELECT series, {DAY} AS ts, n, lag(n) OVER (PARTITION BY series ORDER BY ts) AS n_lag_1 FROM daily JOIN e USING (ts)")
def daily_external(spark, d):
    rows = _daily(spark, d)
    external = rows.groupBy("ts").agg(F.count("*").cast("double").alias("n"))
    return _key(S.with_external(rows, external, ["n"]).select("series", "ts", "n", "n_lag_1"))


_AR = f"{_DAILY}, l AS (SELECT *, lag(y) OVER (PARTITION BY series ORDER BY ts) AS x FROM daily), c AS (SELECT series, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, count(x) AS n, arg_max(y, ts) AS last FROM l GROUP BY series HAVING count(x) > 2)"


@query(f"WITH {_AR} SELECT series, n, {r('a')} AS constant, {r('b')} AS slope FROM c")
def daily_autoregression(spark, d):
    found = S.autoregression(_daily(spark, d), 1).where("coefficients IS NOT NULL")
    return fine(found.select("series", "n", F.col("coefficients")[0].alias("constant"), F.col("coefficients")[1].alias("slope")), "constant", "slope")


@query(f"WITH {_AR}, f1 AS (SELECT *, a + b * last AS f1 FROM c), f2 AS (SELECT *, a + b * f1 AS f2 FROM f1) " + union([f"SELECT series, 1::BIGINT AS h, {r('f1')} AS forecast FROM f1", f"SELECT series, 2::BIGINT AS h, {r('f2')} AS forecast FROM f2", f"SELECT series, 3::BIGINT AS h, {r('a + b * f2')} AS forecast FROM f2"]))
def daily_autoregressive_forecast(spark, d):
    return fine(long(S.autoregressive_forecast(S.autoregression(_daily(spark, d), 1), 3), "h"), "forecast")


# --- texts and insights ------------------------------------------------------------------------------------------

_GRAMS = f"w AS (SELECT doc_id, {_W} AS w FROM documents), g AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w) GROUP BY ALL), b AS (SELECT term, sum(n) AS a, count(*) AS df FROM g GROUP BY term ORDER BY a DESC, term LIMIT 1000), t AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(DISTINCT doc_id) FROM documents)) / (1 + df)) + 1) AS w FROM g JOIN b USING (term)), v AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM t)"


@query(f"WITH {_GRAMS} SELECT doc_id, count(*) AS terms, {r('sum(weight)')} AS total FROM v GROUP BY doc_id")
def doc_ngram_tfidf(spark, d):
    out = X.limited_tf_idf(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("weight").alias("total"))
    return fine(out, "total")


@query(f"WITH {_TERMS}, f AS (SELECT sum(n) / (SELECT count(*) FROM documents) AS m, count(DISTINCT term) AS v FROM terms) SELECT 'short_texts' AS rule, {r('m')} AS value FROM f WHERE m < 20 UNION ALL SELECT 'large_vocabulary', {r('v')} FROM f WHERE v > 50000")
def corpus_insights(spark, d):
    return fine(I.domain_insights(X.corpus_statistics(_docs(spark, d)), "texts").select("rule", "value"), "value")


@query()
def doc_topic_choice(spark, d):
    return X.choose_topics(_docs(spark, d), (2, 4), vocabulary=500, rounds=3)


@query()
def order_model_scores(spark, d):
    """Both lines' predictions side by side with what was paid."""
    tables = _two_lines(spark, d)
    return tables["quantity"].select("key", "y", F.col("prediction").alias("by_quantity")).join(tables["price"].select("key", F.col("prediction").alias("by_price")), "key")
