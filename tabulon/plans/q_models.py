"""Queries over groups, anomalies, models and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import groups as G
from tabulon.operators import insights as I
from tabulon.operators import models as M
from tabulon.operators import quality as Q
from tabulon.plans.q_profile import NULLED, _with_nulls, fine, long, r, union
from tabulon.plans.registry import query, table

X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def _flat(spark, d, n=4):
    return _vectors(spark, d).select("vec_id", "label", *[F.col("embedding")[i].alias(f"e{i}") for i in range(n)])


@query()
def embedding_clusters(spark, d):
    return G.assign(_vectors(spark, d), ["embedding"], 10).select("vec_id", "label", "cluster")


@query()
def embedding_agreement(spark, d):
    return G.agreement(G.assign(_vectors(spark, d), ["embedding"], 10), "label", "cluster")


@query()
def embedding_mixture(spark, d):
    return G.assign(_flat(spark, d), ["e0", "e1", "e2", "e3"], 3, "mixture").select("vec_id", "cluster", "probability")


@query()
def embedding_bisecting(spark, d):
    return G.assign(_vectors(spark, d), ["embedding"], 4, "bisecting").select("vec_id", "cluster")


@query()
def embedding_choose_k(spark, d):
    return G.choose_k(_vectors(spark, d), ["embedding"], range(2, 6))


@query()
def embedding_projection(spark, d):
    return G.projected(_vectors(spark, d), ["embedding"]).select("vec_id", "projection")


@query("""WITH RECURSIVE v AS (SELECT c_custkey AS k, c_acctbal / 1000 AS x, c_nationkey / 2.0 AS y FROM customer),
near AS (SELECT a.k, b.k AS o FROM v a JOIN v b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.6 * 0.6), core AS (SELECT k FROM near GROUP BY k HAVING count(*) >= 4),
links AS (SELECT k, o FROM near WHERE k IN (FROM core) AND o IN (FROM core)),
walk AS (SELECT k, k AS c FROM core UNION SELECT l.o, min(w.c) FROM walk w JOIN links l ON l.k = w.k WHERE w.c < l.o GROUP BY l.o),
label AS (SELECT k, min(c) AS c FROM walk GROUP BY k), found AS (SELECT n.k, min(c) AS c FROM near n JOIN label l ON l.k = n.o GROUP BY n.k)
SELECT v.k AS c_custkey, coalesce(found.c, -1)::BIGINT AS "cluster" FROM v LEFT JOIN found USING (k)""")
def customer_density_groups(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_nationkey") / 2.0).alias("y"))
    return G.density_groups(rows, "c_custkey", ["x", "y"], 0.6, 4)


_E = "(SELECT label, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1 FROM embeddings)"


@query(f"""WITH s AS (SELECT label, count(*) AS n, avg(e0) AS m0, avg(e1) AS m1, var_pop(e0) * count(*) + var_pop(e1) * count(*) AS w FROM {_E} GROUP BY label), g AS (SELECT avg(e0) AS g0, avg(e1) AS g1, count(*) AS t FROM {_E}),
sp AS (SELECT label, avg(sqrt((e0 - m0) * (e0 - m0) + (e1 - m1) * (e1 - m1))) AS sp FROM {_E} JOIN s USING (label) GROUP BY label), f AS (SELECT * FROM s JOIN sp USING (label)),
db AS (SELECT avg(x) AS db FROM (SELECT a.label, max((a.sp + b.sp) / sqrt((a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1))) AS x FROM f a JOIN f b ON a.label <> b.label GROUP BY a.label))
SELECT count(*) AS clusters, {r('(sum(n * ((m0 - g0) * (m0 - g0) + (m1 - g1) * (m1 - g1))) / (count(*) - 1)) / (sum(w) / (any_value(t) - count(*)))')} AS calinski_harabasz, {r('any_value(db)')} AS davies_bouldin, {r('min(n) / max(n)')} AS balance FROM f, g, db""")
def cluster_indices(spark, d):
    return fine(G.quality(_flat(spark, d, 2), ["e0", "e1"], "label"), "calinski_harabasz", "davies_bouldin", "balance")


@query(f"WITH t AS (SELECT label AS a, vec_id % 3 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM t), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n / t * ln(n * t / (na * nb))) AS mi, any_value(t) AS t FROM c), a AS (SELECT sum(na * (na - 1) / 2) AS sa, sum(-na / t * ln(na / t)) AS ha FROM (SELECT DISTINCT a, na, t FROM c)), b AS (SELECT sum(nb * (nb - 1) / 2) AS sb, sum(-nb / t * ln(nb / t)) AS hb FROM (SELECT DISTINCT b, nb, t FROM c)) SELECT {r('(s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2))', 6)} AS adjusted_rand, {r('2 * mi / (ha + hb)', 6)} AS mutual_information FROM s, a, b")
def label_agreement(spark, d):
    return fine(G.agreement(_vectors(spark, d).withColumn("other", F.col("vec_id") % 3), "label", "other"), "adjusted_rand", "mutual_information", digits=6)


@query(f"WITH m AS (SELECT avg(e0) AS m0, avg(e1) AS m1, var_samp(e0) AS a, var_samp(e1) AS b, covar_samp(e0, e1) AS c FROM {_E}) SELECT vec_id, {r('(b * (e0 - m0) * (e0 - m0) - 2 * c * (e0 - m0) * (e1 - m1) + a * (e1 - m1) * (e1 - m1)) / (a * b - c * c)')} AS distance FROM (SELECT vec_id, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1 FROM embeddings), m")
def embedding_mahalanobis(spark, d):
    return fine(G.mahalanobis(_flat(spark, d, 2), ["e0", "e1"]).select("vec_id", "distance"), "distance")


def _scored(spark, d):
    return G.flag(G.mahalanobis(_flat(spark, d, 2), ["e0", "e1"], "score"), "score", 0.05)


_SCORED = f"""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1 FROM embeddings), m AS (SELECT avg(e0) AS m0, avg(e1) AS m1, var_samp(e0) AS a, var_samp(e1) AS b, covar_samp(e0, e1) AS c FROM e),
d AS (SELECT e.*, (b * (e0 - m0) * (e0 - m0) - 2 * c * (e0 - m0) * (e1 - m1) + a * (e1 - m1) * (e1 - m1)) / (a * b - c * c) AS score FROM e, m), s AS (SELECT d.*, score > q AS anomaly FROM d, (SELECT quantile_cont(score, 0.95) AS q FROM d))"""


@query(f"{_SCORED} SELECT count(*) FILTER (anomaly) AS anomalies, count(*) AS n, " + ", ".join(f"{r(e)} AS {n}" for e, n in (("avg(score) FILTER (anomaly)", "mean_anomaly"), ("avg(score) FILTER (NOT anomaly)", "mean_normal"), ("avg(score) FILTER (anomaly) - avg(score) FILTER (NOT anomaly)", "separation"), ("quantile_cont(score, 0.9)", "p90"), ("quantile_cont(score, 0.95)", "p95"), ("quantile_cont(score, 0.99)", "p99"))) + " FROM s")
def embedding_anomaly_metrics(spark, d):
    return fine(G.anomaly_metrics(_scored(spark, d), "score"), "mean_anomaly", "mean_normal", "separation", "p90", "p95", "p99")


@query(f"{_SCORED} SELECT vec_id, {r('score')} AS score, anomaly FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def embedding_top_anomalies(spark, d):
    return fine(G.top_anomalies(_scored(spark, d), "vec_id", "score").select("vec_id", "score", "anomaly"), "score")


@query(f"{_SCORED} " + union([f"SELECT 'e{i}' AS column_name, {r(f'abs(corr(e{i}, anomaly::INT))', 6)} AS importance FROM s" for i in range(2)]))
def embedding_anomaly_importance(spark, d):
    return fine(G.anomaly_importance(_scored(spark, d), ["e0", "e1"]), "importance", digits=6)


@query()
def orders_isolation(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day"))
    return G.flag(G.isolation_scores(rows, ["o_totalprice", "day"], trees=20, key="o_orderkey"), "score", 0.01)


@query(f"""WITH m AS (SELECT avg(c_acctbal) AS a, stddev_pop(c_acctbal) AS s, avg(c_nationkey) AS b, stddev_pop(c_nationkey) AS t FROM customer), v AS (SELECT c_custkey AS k, (c_acctbal - a) / s AS x, (c_nationkey - b) / t AS y FROM customer, m),
near AS (SELECT a.k AS a, b.k AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM v a JOIN v b ON a.k <> b.k QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.k) <= 5),
reach AS (SELECT a AS b, max(d) AS kb FROM near GROUP BY a), density AS (SELECT a, 1 / avg(greatest(d, kb, 1e-9)) AS l FROM near JOIN reach USING (b) GROUP BY a)
SELECT n.a AS c_custkey, {r('avg(o.l) / any_value(own.l)', 6)} AS lof FROM near n JOIN density o ON o.a = n.b JOIN density own ON own.a = n.a GROUP BY n.a""")
def customer_outlier_factor(spark, d):
    rows, names = G.prepare(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), "c_custkey")
    return fine(G.local_outlier_factor(rows, "c_custkey", names, 5), "lof", digits=6)


@query()
def embedding_reconstruction(spark, d):
    return G.reconstruction_error(_vectors(spark, d), ["embedding"], 8).select("vec_id", "error")


@query(f"SELECT {r('greatest(0.01, least(0.5, avg((o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a))::INT)))', 6)} AS contamination FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)")
def orders_contamination(spark, d):
    return fine(G.contamination(table(spark, d, "orders"), ["o_totalprice"]), "contamination", digits=6)


@query("""WITH m AS (SELECT avg(o_totalprice) AS m, count(*) AS n FROM orders), k AS (SELECT avg((o_totalprice - m) ** 2) AS m2, avg((o_totalprice - m) ** 3) AS m3, avg((o_totalprice - m) ** 4) AS m4, any_value(n) AS n FROM orders, m),
g AS (SELECT n, abs(m3 / m2 ** 1.5) < 1 AND abs(m4 / (m2 * m2) - 3) < 3 AS gaussian FROM k) SELECT CASE WHEN gaussian THEN 'elliptic_envelope' WHEN n > 10000 THEN 'isolation_forest' ELSE 'local_outlier_factor' END AS detector, gaussian, n FROM g""")
def orders_detector_choice(spark, d):
    return G.detector_choice(table(spark, d, "orders"), ["o_totalprice"])


# --- models ------------------------------------------------------------------------------------------------------


def _lines(spark, d):
    """One row for each order: ``key`` is unique, since order lines have no key of their own."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    first = F.min_by("p_brand", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return rows.groupBy(F.col("l_orderkey").alias("key")).agg(F.sum("l_extendedprice").alias("y"), F.sum("l_quantity").cast("double").alias("quantity"), F.avg("p_retailprice").alias("price"), F.avg("l_discount").alias("discount"), first.alias("brand"))


COLUMNS = ["quantity", "price", "discount"]


@query()
def price_models(spark, d):
    return M.compare(_lines(spark, d), "y", [*COLUMNS, "brand"], "key", ["linear", "tree", "forest"])


@query()
def price_scores(spark, d):
    rows = _lines(spark, d)
    return M.score(M.fit(rows, "y", COLUMNS), rows).select("key", "y", "prediction")


@query()
def price_search(spark, d):
    return M.search(_lines(spark, d), "y", COLUMNS, {"regParam": [0.0, 0.1], "elasticNetParam": [0.0]}, folds=2)


@query()
def price_votes(spark, d):
    rows = _lines(spark, d)
    return M.vote({n: M.score(M.fit(rows, "y", COLUMNS, n), rows) for n in ("linear", "tree")}, "key", {"linear": 2.0})


@query(f"SELECT event_id, {r('(2.0 * value + 1.0 * (value + 10)) / 3')} AS prediction FROM events")
def event_votes(spark, d):
    e = table(spark, d, "events")
    return fine(M.vote({"a": e.select("event_id", F.col("value").alias("prediction")), "b": e.select("event_id", (F.col("value") + 10).alias("prediction"))}, "event_id", {"a": 2.0}), "prediction")


@query()
def price_stacked(spark, d):
    return M.stack(_lines(spark, d), "y", COLUMNS, "key", ["linear", "tree"], 2)


@query()
def price_bagged(spark, d):
    return M.bag(_lines(spark, d), "y", COLUMNS, "key", 2)


@query()
def price_model_diversity(spark, d):
    rows = _lines(spark, d)
    return M.disagreement({n: M.score(M.fit(rows, "y", COLUMNS, n), rows) for n in ("linear", "tree")}, "key")


_ORDERS = "SELECT l_orderkey AS key, sum(l_extendedprice) AS y, sum(l_quantity)::DOUBLE AS quantity, avg(p_retailprice) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"
_LINES_OF = f"o AS ({_ORDERS}), m AS (SELECT regr_slope(y, quantity) AS bq, regr_intercept(y, quantity) AS aq, regr_slope(y, price) AS bp, regr_intercept(y, price) AS ap FROM o)"


def _two_lines(spark, d):
    """Predictions of two straight lines, over the quantity and over the price of an order."""
    rows = _lines(spark, d)
    return {c: M.score(M.fit(rows, "y", [c], "linear"), rows) for c in ("quantity", "price")}


@query(f"WITH {_LINES_OF} SELECT key, {r('(2 * (aq + bq * quantity) + ap + bp * price) / 3', 2)} AS prediction FROM o, m")
def order_line_votes(spark, d):
    return fine(M.vote(_two_lines(spark, d), "key", {"quantity": 2.0}), "prediction", digits=2)


@query(f"SELECT 'price' AS model_a, 'quantity' AS model_b, {r('1 - abs(corr(quantity, price))')} AS diversity FROM ({_ORDERS})")
def order_line_diversity(spark, d):
    return fine(M.disagreement(_two_lines(spark, d), "key"), "diversity")


@query(f"WITH {_LINES_OF} SELECT key, 'quantity' AS column_name, f AS factor, {r('bq * quantity * (f - 1)', 2)} AS change, CASE WHEN f < 1 THEN 1 ELSE 2 END::BIGINT AS rank FROM o, m, (SELECT unnest([0.9, 1.1])::DOUBLE AS f) WHERE abs(bq * quantity * (f - 1)) > 0.1")
def order_line_what_if(spark, d):
    rows = _lines(spark, d)
    # a tenth up and down move a line equally far: the tie is settled by the factor, whatever the last bit says
    out = M.what_if(M.fit(rows, "y", ["quantity"], "linear"), rows, "key", ["quantity"])
    return fine(out.withColumn("rank", F.when(F.col("factor") < 1, 1).otherwise(2).cast("long")), "change", digits=2)


@query()
def price_importance(spark, d):
    rows = _lines(spark, d)
    return spark.createDataFrame(M.importance(M.fit(rows, "y", COLUMNS, "tree"), COLUMNS), "column_name string, importance double")


@query()
def price_permutation_importance(spark, d):
    rows = _lines(spark, d)
    return M.permutation_importance(M.fit(rows, "y", COLUMNS), rows, "y", COLUMNS[:2], "key")


@query()
def price_partial_dependence(spark, d):
    rows = _lines(spark, d)
    return M.partial_dependence(M.fit(rows, "y", COLUMNS), rows, "quantity", "key", 5)


@query(f"WITH l AS (SELECT *, row_number() OVER () AS id FROM lineitem), c AS (SELECT id, l_orderkey * 10 + l_linenumber AS key, unnest([{{'n': 'discount', 'v': -5000.0 * l_discount}}, {{'n': 'quantity', 'v': 10.0 * l_quantity}}, {{'n': 'tax', 'v': 3000.0 * l_tax}}]) AS s FROM l) SELECT key, s.n AS column_name, {r('s.v')} AS contribution, row_number() OVER (PARTITION BY id ORDER BY abs(s.v) DESC, s.n) AS rank FROM c QUALIFY rank <= 2")
def price_contributions(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return fine(long(M.contributions(rows, "key", [("discount", -5000.0), ("quantity", 10.0), ("tax", 3000.0)], 2), "rank"), "contribution")


@query()
def price_what_if(spark, d):
    rows = _lines(spark, d)
    return M.what_if(M.fit(rows, "y", COLUMNS), rows, "key", COLUMNS)


# --- insights ----------------------------------------------------------------------------------------------------


@query(union([f"SELECT '{t}' AS name, {r('v')} AS value, CASE WHEN v >= 0.9 THEN 'excellent' WHEN v >= 0.8 THEN 'good' WHEN v >= 0.7 THEN 'fair' ELSE 'poor' END AS level FROM (SELECT avg(value) / 100 AS v FROM events WHERE event_type = '{t}')" for t in ("click", "view")]))
def event_metric_levels(spark, d):
    rows = table(spark, d, "events").where("event_type IN ('click', 'view')").groupBy(F.col("event_type").alias("name")).agg((F.avg("value") / 100).alias("value"))
    every = spark.sql("SELECT * FROM VALUES ('click'), ('view') AS t(name)").join(rows, "name", "left")
    return fine(I.metric_levels(every).select("name", "value", F.coalesce("level", F.lit("poor")).alias("level")), "value")


@query(f"SELECT 'few_rows' AS rule, 'warning' AS severity, 'n_rows' AS metric, count(*)::DOUBLE AS value FROM {NULLED} HAVING count(*) < 1000")
def customer_data_insights(spark, d):
    return I.data_insights(Q.table_facts(_with_nulls(spark, d))).where("metric = 'n_rows'").drop("message")


@query("SELECT 'balanced_features' AS rule, 'info' AS severity FROM (SELECT max(s) AS a FROM (SELECT sum(p_retailprice) / sum(sum(p_retailprice)) OVER () AS s FROM part GROUP BY p_brand)) WHERE a <= 0.2")
def brand_importance_insights(spark, d):
    brands = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return I.importance_insights(brands).where("rule = 'balanced_features'").select("rule", "severity")


@query(f"SELECT event_type, {r('v')} AS score, CASE WHEN v >= 0.9 THEN 'low' WHEN v >= 0.75 THEN 'medium' ELSE 'high' END AS risk, {r('v * 10 * 100', 2)} AS expected_saving FROM (SELECT event_type, avg(value) / 100 AS v FROM events GROUP BY event_type)")
def event_deployment(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg((F.avg("value") / 100).alias("score"))
    out = I.deployment(rows, saving=10.0, volume=100.0, keys=("event_type",)).select("event_type", "score", "risk", "expected_saving")
    return fine(fine(out, "score"), "expected_saving", digits=2)


@query()
def region_insight_summary(spark, d):
    found = I.data_insights(Q.table_facts(table(spark, d, "region").unionByName(table(spark, d, "region"))))
    return I.summary(found).crossJoin(I.confidence(found)).drop("n")


@query()
def price_sentences(spark, d):
    rows = _lines(spark, d)
    return I.sentences(M.contributions(rows, "key", [("discount", -5000.0), ("quantity", 10.0)], 2), "key")
