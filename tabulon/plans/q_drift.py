"""Queries over drift: lineitem shipped before June 1998 is the reference, the rest is current."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import drift as D
from tabulon.plans.q_profile import fine, r, union
from tabulon.plans.registry import query, table

COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CUT = "TIMESTAMP '1998-06-01'"


def _sides(spark, d):
    rows = table(spark, d, "lineitem")
    early = F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp")
    return rows.where(early), rows.where(~early)


_LONG = "long AS (" + union([f"SELECT '{c}' AS feature, {c} AS v, (l_shipdate >= {CUT})::INT AS side FROM lineitem WHERE {c} IS NOT NULL" for c in COLUMNS]) + ")"
_COUNTS = _LONG + ", counts AS (SELECT feature, v, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c FROM long GROUP BY ALL)"
_CDF = _COUNTS + ", cdf AS (SELECT feature, v, r, c, sum(r) OVER e AS nr, sum(c) OVER e AS nc, sum(r) OVER u / sum(r) OVER e AS fr, sum(c) OVER u / sum(c) OVER e AS fc FROM counts WINDOW e AS (PARTITION BY feature), u AS (PARTITION BY feature ORDER BY v))"
_PSI = f"""WITH {_COUNTS}, edges AS (SELECT feature, quantile_cont(v, [{', '.join(str(i / 10) for i in range(11))}]) AS e FROM long WHERE side = 0 GROUP BY feature),
raised AS (SELECT feature, list_transform(range(1, 12), lambda i: e[i] + CASE WHEN i = 11 THEN 1e-6 ELSE 0 END) AS e FROM edges),
binned AS (SELECT feature, r, c, len(list_filter(e, lambda x: x <= v)) AS bin FROM counts JOIN raised USING (feature)),
totals AS (SELECT feature, sum(r) AS nr, sum(c) AS nc FROM binned GROUP BY feature),
filled AS (SELECT t.feature, greatest(coalesce(sum(b.r), 0) / any_value(nr), 0.001) AS p, greatest(coalesce(sum(b.c), 0) / any_value(nc), 0.001) AS q FROM totals t CROSS JOIN range(1, 11) g(bin) LEFT JOIN binned b ON b.feature = t.feature AND b.bin = g.bin GROUP BY t.feature, g.bin)
SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM filled GROUP BY feature"""
_WASS = f"""WITH {_COUNTS}, lim AS (SELECT feature, min(v) FILTER (r > 0) AS lo, max(v) FILTER (r > 0) AS hi FROM counts GROUP BY feature),
m AS (SELECT feature, greatest(0.0, least(1.0, (v - lo) / (hi - lo))) AS v, sum(r) AS r, sum(c) AS c FROM counts JOIN lim USING (feature) WHERE hi > lo GROUP BY ALL),
f AS (SELECT feature, v, sum(r) OVER u / sum(r) OVER e AS fr, sum(c) OVER u / sum(c) OVER e AS fc, lead(v) OVER u - v AS step FROM m WINDOW e AS (PARTITION BY feature), u AS (PARTITION BY feature ORDER BY v))
SELECT feature, coalesce(sum(abs(fr - fc) * step), 0) AS wasserstein FROM f GROUP BY feature"""
_JS = f"""WITH {_COUNTS}, lim AS (SELECT feature, min(v) AS lo, max(v) AS hi, sum(r) AS nr, sum(c) AS nc, least(50, floor(sqrt(least(sum(r), sum(c)))))::INT AS bins FROM counts GROUP BY feature),
b AS (SELECT feature, bins, least(floor((v - lo) / (hi - lo) * bins), bins - 1)::INT AS bin, sum(r) / any_value(nr) AS p, sum(c) / any_value(nc) AS q FROM counts JOIN lim USING (feature) WHERE hi > lo GROUP BY ALL),
t AS (SELECT feature, sum(p + 1e-10) + (any_value(bins) - count(*)) * 1e-10 AS sp, sum(q + 1e-10) + (any_value(bins) - count(*)) * 1e-10 AS sq FROM b GROUP BY feature),
s AS (SELECT feature, (p + 1e-10) / sp AS a, (q + 1e-10) / sq AS b FROM b JOIN t USING (feature))
SELECT feature, sum((a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2) AS js_divergence FROM s GROUP BY feature"""


@query(union([f"SELECT '{c}' AS feature, count(*) AS n, {r(f'avg({c})', 5)} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'skewness({c})')} AS skewness, {r(f'kurtosis({c})')} AS kurtosis, {r(f'min({c})')} AS least, {r(f'max({c})')} AS most, {r(f'quantile_cont({c}, 0.1)')} AS first_edge FROM lineitem WHERE l_shipdate < {CUT}" for c in COLUMNS]))
def lineitem_reference_statistics(spark, d):
    found = D.reference_statistics(_sides(spark, d)[0], list(COLUMNS)).withColumn("first_edge", F.col("edges")[1]).drop("edges")
    return fine(fine(found, "mean", digits=5), "std", "skewness", "kurtosis", "least", "most", "first_edge")


@query(f"SELECT feature, {r('psi', 6)} AS psi FROM ({_PSI})")
def lineitem_drift_psi(spark, d):
    return fine(D.psi(*_sides(spark, d), list(COLUMNS)), "psi", digits=6)


@query(f"WITH {_CDF} SELECT feature, {r('max(abs(fr - fc))', 6)} AS ks, any_value(nr)::BIGINT AS n_reference, any_value(nc)::BIGINT AS n_current FROM cdf GROUP BY feature")
def lineitem_drift_ks(spark, d):
    return fine(D.ks(*_sides(spark, d), list(COLUMNS)).drop("p_value"), "ks", digits=6)


@query(f"SELECT feature, {r('wasserstein', 6)} AS wasserstein FROM ({_WASS})")
def lineitem_drift_wasserstein(spark, d):
    return fine(D.wasserstein(*_sides(spark, d), list(COLUMNS)), "wasserstein", digits=6)


@query(f"SELECT feature, {r('sqrt(greatest(js_divergence, 0))', 6)} AS js_distance, {r('js_divergence', 6)} AS js_divergence FROM ({_JS})")
def lineitem_drift_js(spark, d):
    return fine(D.jensen_shannon(*_sides(spark, d), list(COLUMNS)), "js_distance", "js_divergence", digits=6)


_CHI = "WITH j AS (" + union([f"SELECT '{c}' AS feature, {c} AS value, count(*) FILTER (l_shipdate < {CUT}) AS r, count(*) FILTER (l_shipdate >= {CUT}) AS c FROM lineitem GROUP BY {c}" for c in ("l_returnflag", "l_linestatus")]) + "), n AS (SELECT *, sum(r) OVER (PARTITION BY feature) AS nr, sum(c) OVER (PARTITION BY feature) AS nc FROM j)"


@query(f"{_CHI} SELECT feature, {r('coalesce(sum(CASE WHEN r > 0 THEN (c - r / nr * nc) * (c - r / nr * nc) / (r / nr * nc) END), 0)', 3)} AS chi2, count(*) FILTER (r > 0) - 1 AS dof, {r('0.5 * sum(abs(r / nr - c / nc))', 6)} AS total_variation, {r('sum(CASE WHEN r = 0 THEN c / nc ELSE 0 END)', 6)} AS unseen_ratio FROM n GROUP BY feature")
def lineitem_drift_chi2(spark, d):
    found = D.chi_square(*_sides(spark, d), ["l_returnflag", "l_linestatus"]).select("feature", "chi2", "dof", "total_variation", "unseen_ratio")
    return fine(fine(found, "chi2", digits=3), "total_variation", "unseen_ratio", digits=6)


@query()
def lineitem_drift(spark, d):
    return D.table_drift(*_sides(spark, d), list(COLUMNS), ["l_returnflag", "l_linestatus"])


@query()
def lineitem_multivariate_drift(spark, d):
    return D.multivariate_drift(*_sides(spark, d), list(COLUMNS))


@query()
def lineitem_drift_advice(spark, d):
    return D.drift_advice(D.table_drift(*_sides(spark, d), list(COLUMNS)))


@query(f"SELECT event_type AS name, {r('v')} AS value, {r('b')} AS baseline, {r('(b - v) / abs(b)', 6)} AS \"drop\", (b - v) / abs(b) > 0.05 AS drifted, CASE WHEN (b - v) / abs(b) >= 0.15 THEN 'critical' WHEN (b - v) / abs(b) >= 0.1 THEN 'high' WHEN (b - v) / abs(b) >= 0.05 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT event_type, avg(value) FILTER (event_id % 2 = 1) AS v, avg(value) FILTER (event_id % 2 = 0) AS b FROM events GROUP BY event_type)")
def events_performance_drift(spark, d):
    means = lambda k: table(spark, d, "events").where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    found = D.performance_drift(means(1), means(0))
    return fine(fine(found, "value", "baseline"), "drop", digits=6)


_ALERTS = "(SELECT ts AS timestamp, event_type AS feature, value / 100 AS drift_score, CASE WHEN value / 100 >= 0.5 THEN 'critical' WHEN value / 100 >= 0.3 THEN 'high' WHEN value / 100 >= 0.1 THEN 'medium' ELSE 'low' END AS severity FROM events)"


def _alerts(spark, d):
    rows = table(spark, d, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("feature"), (F.col("value") / 100).alias("drift_score"))
    return rows.withColumn("severity", D.severity(F.col("drift_score")))


@query(f"SELECT feature, count(*) AS n_alerts, {r('avg(drift_score)')} AS mean_score, {r('max(drift_score)')} AS top_score, count(*) FILTER (severity IN ('high', 'critical')) AS n_severe FROM {_ALERTS} WHERE timestamp >= (SELECT min(ts) FROM events) + INTERVAL 5 DAY GROUP BY feature")
def events_drift_report(spark, d):
    alerts = _alerts(spark, d)
    start = table(spark, d, "events").agg((F.min("ts") + F.expr("INTERVAL 5 DAYS")).alias("t")).first()["t"]
    return fine(D.drift_report(alerts, start, "2999-01-01"), "mean_score", "top_score")


@query("SELECT name, value, CASE WHEN value >= 60 THEN 'critical' ELSE 'warning' END AS level FROM (SELECT event_type AS name, count(*) AS value FROM events GROUP BY event_type, user_id) WHERE value >= 10 AND name IN ('click', 'view')")
def events_threshold_alerts(spark, d):
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("name"), "user_id").agg(F.count("*").alias("value")).drop("user_id")
    limits = spark.sql("SELECT * FROM VALUES ('click', 10, 60), ('view', 10, 60) AS t(name, warning, critical)")
    return D.threshold_alerts(counts, limits)


@query("SELECT CASE WHEN max(o) = 2 THEN 'critical' WHEN max(o) = 1 THEN 'warning' ELSE 'healthy' END AS status, count(*) FILTER (o > 0) AS n_failing FROM (SELECT CASE WHEN avg(value) <= 0.3 * 100 THEN 0 WHEN avg(value) <= 0.6 * 100 THEN 1 ELSE 2 END AS o FROM events GROUP BY event_type)")
def events_combined_health(spark, d):
    means = table(spark, d, "events").groupBy(F.col("event_type").alias("check")).agg((F.avg("value") / 100).alias("score"))
    return D.combined_status(means.select("check", D.health(F.col("score"), 0.3).alias("status")))
