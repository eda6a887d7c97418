"""Queries over curves of many classes, trend and unit-root tests, rating biases and density groups of wide vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import groups as G
from tabulon.operators import metrics as V
from tabulon.operators import recs as R
from tabulon.operators import series as S
from tabulon.plans.q_models import _vectors
from tabulon.plans.q_profile import fine, long, r, union
from tabulon.plans.q_series import _IDX, _daily
from tabulon.plans.q_text import _RATINGS, _ratings
from tabulon.plans.registry import query, table

# --- many classes ------------------------------------------------------------------------------------------------

_SCORES = {"A": "l_discount * 5", "N": "l_tax * 10", "R": "l_quantity / 50"}
_CLASSES = union([f"SELECT '{c}' AS class, (l_returnflag = '{c}')::INT AS y, ({s})::DOUBLE AS s FROM lineitem" for c, s in _SCORES.items()])
_CURVES = f"""rows AS ({_CLASSES}), v AS (SELECT class, s, sum(y) AS p, count(*) AS k FROM rows GROUP BY class, s),
c AS (SELECT *, sum(p) OVER w AS tp, sum(k) OVER w AS upto, sum(p) OVER (PARTITION BY class) AS pp, sum(k) OVER (PARTITION BY class) AS kk FROM v WINDOW w AS (PARTITION BY class ORDER BY s DESC)),
curves AS (SELECT class, max(pp)::BIGINT AS positives, max(kk)::BIGINT AS n, sum((k - p) * (tp - p / 2)) / (max(pp) * (max(kk) - max(pp))) AS roc_auc, sum(p / pp * tp / upto) AS average_precision,
  sum(p * (1 - s) * (1 - s) + (k - p) * s * s) / max(kk) AS brier FROM c GROUP BY class)"""


def _scored(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select("l_returnflag", (F.col("l_discount") * 5).alias("A"), (F.col("l_tax") * 10).alias("N"), (F.col("l_quantity") / 50).alias("R"))


@query(f"WITH {_CURVES} SELECT class, positives, n, {r('roc_auc', 6)} AS roc_auc, {r('average_precision', 6)} AS average_precision, {r('brier', 6)} AS brier FROM curves")
def returnflag_class_curves(spark, d):
    return fine(V.class_curves(_scored(spark, d), "l_returnflag", {c: c for c in _SCORES}), "roc_auc", "average_precision", "brier", digits=6)


@query(f"""WITH {_CURVES} SELECT {r('avg(roc_auc)', 6)} AS roc_auc_macro, {r('sum(roc_auc * positives) / sum(positives)', 6)} AS roc_auc_weighted,
{r('avg(average_precision)', 6)} AS average_precision_macro, {r('sum(average_precision * positives) / sum(positives)', 6)} AS average_precision_weighted FROM curves""")
def returnflag_curve_means(spark, d):
    found = V.class_curve_means(V.class_curves(_scored(spark, d), "l_returnflag", {c: c for c in _SCORES}))
    return fine(found, *found.columns, digits=6)


@query(f"""WITH rows AS ({_CLASSES}), b AS (SELECT class, greatest(0, least(9, floor(s * 10)))::BIGINT AS bin, count(*) AS n, avg(s) AS m, avg(y) AS share FROM rows GROUP BY ALL)
SELECT class, bin, n, {r('m', 6)} AS mean_score, {r('share', 6)} AS share, {r('sum(n * abs(m - share)) OVER (PARTITION BY class) / sum(n) OVER (PARTITION BY class)', 6)} AS error FROM b""")
def returnflag_calibration(spark, d):
    return fine(long(V.calibration(_scored(spark, d), "l_returnflag", {c: c for c in _SCORES}), "bin"), "mean_score", "share", "error", digits=6)


# --- series ------------------------------------------------------------------------------------------------------


@query(f"""WITH {_IDX}, f AS (SELECT series, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, regr_r2(y, t) AS r2, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, count(*) AS n FROM idx GROUP BY series)
SELECT series, {r('b')} AS slope, {r('a')} AS intercept, {r('r2', 6)} AS r2, n, {r('b / sqrt((syy - b * b * sxx) / (n - 2) / sxx)', 3)} AS t FROM f""")
def daily_trend_test(spark, d):
    found = S.trend_test(_daily(spark, d)).select("series", "slope", "intercept", "r2", "n", "t")
    return fine(fine(fine(found, "slope", "intercept"), "r2", digits=6), "t", digits=3)


@query(f"""WITH {_IDX}, l AS (SELECT series, t, y - avg(y) OVER (PARTITION BY series) AS y FROM idx), x AS (SELECT series, lag(y) OVER w AS x, y - lag(y) OVER w AS d, lag(y) OVER w - lag(y, 2) OVER w AS z FROM l WINDOW w AS (PARTITION BY series ORDER BY t)),
k AS (SELECT series, count(*) AS n, corr(d, x) AS dx, corr(d, z) AS dz, corr(x, z) AS xz FROM x WHERE z IS NOT NULL GROUP BY series),
p AS (SELECT series, n, (dx - dz * xz) / sqrt((1 - dz * dz) * (1 - xz * xz)) AS c FROM k), s AS (SELECT series, n, c * sqrt((n - 3) / (1 - c * c)) AS adf FROM p)
SELECT series, 1::BIGINT AS lags, n, {r('adf', 3)} AS adf, {r('-2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.04 / n ** 3', 6)} AS limit_5, adf < -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.04 / n ** 3 AS stationary FROM s""")
def daily_adf(spark, d):
    """With one lag; the twin is the t of a partial correlation."""
    found = long(S.adf(_daily(spark, d), lags=1), "lags").select("series", "lags", "n", "adf", "limit_5", "stationary")
    return fine(fine(found, "adf", digits=3), "limit_5", digits=6)


@query()
def daily_adf_chosen(spark, d):
    """With the number of lags that Akaike's criterion picks."""
    return S.adf(_daily(spark, d))


_KPSS = [(0.347, 0.1), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
_KPSS_P = "CASE WHEN k <= 0.347 THEN 0.1 " + " ".join(f"WHEN k <= {b} THEN {p} + ({q} - {p}) * (k - {a}) / ({b} - {a})" for (a, p), (b, q) in zip(_KPSS, _KPSS[1:], strict=False)) + " ELSE 0.01 END"


@query(f"""WITH {_IDX}, e AS (SELECT series, t, y - avg(y) OVER (PARTITION BY series) AS e FROM idx), s AS (SELECT *, sum(e) OVER (PARTITION BY series ORDER BY t) AS s FROM e),
n AS (SELECT series, count(*) AS n, least(ceil(12 * (count(*) / 100) ** 0.25), count(*) - 1)::BIGINT AS lags, sum(s * s) AS ss, sum(e * e) AS g FROM s GROUP BY series),
g AS (SELECT n.series, sum(2 * (1 - (a.t - b.t) / (lags + 1)) * a.e * b.e) AS g FROM e a JOIN e b USING (series) JOIN n USING (series) WHERE a.t > b.t AND a.t - b.t <= lags GROUP BY n.series),
f AS (SELECT n.series, lags, n, ss / (n * (n.g + coalesce(g.g, 0))) AS k FROM n LEFT JOIN g USING (series))
SELECT series, lags, n, {r('k', 6)} AS kpss, {r(_KPSS_P, 6)} AS p_value, k < 0.463 AS stationary FROM f""")
def daily_kpss(spark, d):
    return fine(long(S.kpss(_daily(spark, d)), "lags"), "kpss", "p_value", digits=6)


# --- ratings -----------------------------------------------------------------------------------------------------

_BIASES = f"""{_RATINGS}, d AS (SELECT "user", item, rating - (SELECT avg(rating) FROM ratings) AS d FROM ratings),
i1 AS (SELECT item, sum(d) / (count(*) + 10) AS b FROM d GROUP BY item), u1 AS (SELECT "user", sum(d - b) / (count(*) + 10) AS b FROM d JOIN i1 USING (item) GROUP BY "user"),
i2 AS (SELECT item, sum(d - b) / (count(*) + 10) AS b FROM d JOIN u1 USING ("user") GROUP BY item), u2 AS (SELECT "user", sum(d - b) / (count(*) + 10) AS b FROM d JOIN i2 USING (item) GROUP BY "user")"""


@query(f"""WITH {_BIASES} SELECT 'item' AS kind, item AS id, {r('b')} AS bias FROM i2 UNION ALL SELECT 'user', "user", {r('b')} FROM u2""")
def ratings_biases(spark, d):
    _, users, items = R.biases(_ratings(spark, d), rounds=2)
    found = items.select(F.lit("item").alias("kind"), F.col("item").alias("id"), F.col("item_bias").alias("bias"))
    return fine(found.unionByName(users.select(F.lit("user").alias("kind"), F.col("user").alias("id"), F.col("user_bias").alias("bias"))), "bias")


@query(f"""WITH {_BIASES} SELECT "user", item, {r('(SELECT avg(rating) FROM ratings) + u2.b + i2.b')} AS score FROM ratings JOIN u2 USING ("user") JOIN i2 USING (item)""")
def ratings_biased_scores(spark, d):
    ratings = _ratings(spark, d)
    return fine(R.biased_scores(ratings.select("user", "item"), *R.biases(ratings, rounds=2)), "score")


@query()
def recs_factor_errors(spark, d):
    """Errors of the mean, of biases, and of factors without and with biases on held-out ratings."""
    ratings = _ratings(spark, d)
    held = F.pmod(F.xxhash64("user", "item"), F.lit(5)) == 0
    train, test = ratings.where(~held), ratings.where(held)
    parts = R.biases(train)
    factors = lambda k: R.factorise_biased(train, test, bias_rounds=k, known=parts if k else None, keep=("rating",))
    found = {"mean": test.crossJoin(F.broadcast(parts[0])).withColumn("score", F.col("mean")), "biases": R.biased_scores(test, *parts), "factors": factors(0), "biased_factors": factors(3)}  # three rounds, as in parts
    out = None
    for name, df in found.items():
        row = df.agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.sqrt(F.avg((F.col("rating") - F.col("score")) * (F.col("rating") - F.col("score")))).alias("rmse"))
        out = row if out is None else out.unionByName(row)
    return out


# --- density -----------------------------------------------------------------------------------------------------

EPS, LEAST = 1.17, 4


@query(f"""WITH RECURSIVE v AS (SELECT vec_id AS k, embedding::DOUBLE[] AS x FROM embeddings),
near AS (SELECT a.k, b.k AS o FROM v a JOIN v b ON list_distance(a.x, b.x) <= {EPS}), core AS (SELECT k FROM near GROUP BY k HAVING count(*) >= {LEAST}),
links AS (SELECT k, o FROM near WHERE k IN (FROM core) AND o IN (FROM core)),
walk AS (SELECT k, k AS c FROM core UNION SELECT l.o, w.c FROM walk w JOIN links l ON l.k = w.k WHERE w.c < l.o),
label AS (SELECT k, min(c) AS c FROM walk GROUP BY k),
found AS (SELECT n.k, min(c) AS c FROM near n JOIN label l ON l.k = n.o GROUP BY n.k)
SELECT v.k AS vec_id, coalesce(found.c, -1)::BIGINT AS "cluster" FROM v LEFT JOIN found USING (k)""")
def embedding_density_groups(spark, d):
    """Density groups over all 64 columns."""
    return G.density_groups(_vectors(spark, d), "vec_id", ["embedding"], EPS, LEAST)
