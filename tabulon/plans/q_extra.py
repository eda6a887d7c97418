"""Queries of operators that had none: rules on results, scoring jobs and streams, targets, languages, decompositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.storage import new_path
from tabulon.operators import clean as C
from tabulon.operators import decompose as Z
from tabulon.operators import drift as D
from tabulon.operators import groups as G
from tabulon.operators import insights as I
from tabulon.operators import languages as L
from tabulon.operators import metrics as V
from tabulon.operators import models as M
from tabulon.operators import profile as P
from tabulon.operators import recs as R
from tabulon.operators import text as X
from tabulon.plans.q_drift import _CDF, _sides
from tabulon.plans.q_features import _FOLDS, _fold_scores
from tabulon.plans.q_models import _vectors
from tabulon.plans.q_profile import fine, long, r, union
from tabulon.plans.q_text import _RATINGS, _docs, _ratings
from tabulon.plans.registry import query, table
from tabulon.sources import catalog as K
from tabulon.streaming import streams as T

# --- small operators over results --------------------------------------------------------------------------------


@query("SELECT arg_max(doc_id, (n_chars, -doc_id)) AS most, arg_min(doc_id, (n_chars, doc_id)) AS least FROM documents")
def doc_longest_and_shortest(spark, d):
    return X.most_and_least(table(spark, d, "documents"), "doc_id", "n_chars")


_SEGMENTED = f"{_RATINGS}, s AS (SELECT \"user\", item, rating, c_mktsegment AS context FROM ratings JOIN customer ON c_custkey = \"user\")"


@query(f"""WITH {_SEGMENTED}, m AS (SELECT item, context, avg(rating) AS c FROM s WHERE context IN (SELECT context FROM s GROUP BY context HAVING count(*) > 10) GROUP BY ALL)
SELECT "user", item, m.context, {r('0.7 * rating + 0.3 * c')} AS score FROM ratings JOIN m USING (item)""")
def ratings_by_segment(spark, d):
    """Ratings moved towards the means of each market segment."""
    ratings = _ratings(spark, d)
    segments = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("segment"))
    return fine(R.context_blend(ratings.join(segments, "user"), "segment", ratings.select("user", "item", F.col("rating").alias("score"))), "score")


@query(f"""WITH {_RATINGS}, p AS (SELECT item, count(*) AS n, row_number() OVER (ORDER BY count(*) * avg(rating) DESC, item) AS rank FROM ratings GROUP BY item)
SELECT item, rank, 'Recommended at rank ' || rank || ' because ' || n || ' customers bought it' AS explanation FROM p WHERE rank <= 20""")
def popular_parts_explained(spark, d):
    found = R.explained(R.popular(_ratings(spark, d), 20), F.concat_ws(" ", F.col("n").cast("string"), F.lit("customers bought it")))
    return long(found.select("item", "rank", "explanation"), "rank")


@query(f"WITH f AS ({_FOLDS}) SELECT model, {r('0.6 * avg(score) + 0.2 / (1 + 2.0) + 0.1 * 0.5 + 0.1 * 0.25', 6)} AS business_score FROM f GROUP BY model")
def price_business_scores(spark, d):
    means = _fold_scores(spark, d).groupBy("model").agg(F.avg("score").alias("score"))
    return fine(means.select("model", V.business_score(F.col("score"), F.lit(2.0), F.lit(0.5), F.lit(0.25)).alias("business_score")), "business_score", digits=6)


_TRADE = "SELECT count(*) FILTER (g AND q = 1) / count(*) FILTER (g) AS p, count(*) FILTER (g AND q = 1) / count(*) FILTER (q = 1) AS c, greatest(count(*) FILTER (q = 1), count(*) FILTER (q = 0)) / least(count(*) FILTER (q = 1), count(*) FILTER (q = 0)) AS i FROM (SELECT n_chars > 1000 AS g, quality AS q FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH t AS ({_TRADE}) SELECT 'precise' AS rule, 'info' AS severity, 'precision_less_recall' AS metric, {r('p - c', 6)} AS value, 'Precision is bought with missed cases' AS message FROM t WHERE p - c > 0.1
UNION ALL SELECT 'sensitive', 'info', 'precision_less_recall', {r('p - c', 6)}, 'Recall is bought with false alarms' FROM t WHERE p - c < -0.1
UNION ALL SELECT 'imbalanced', 'warning', 'imbalance_ratio', {r('i', 6)}, 'Classes are of very different size' FROM t WHERE i > 5""")
def length_trade_offs(spark, d):
    """What a rule on the length of texts trades for what."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.col("n_chars") > 1000).alias("g"), (F.col("quality") == 1).alias("q"))
    hits, n, m = F.count_if(F.col("g") & F.col("q")), F.count_if("q"), F.count_if(~F.col("q"))
    facts = rows.agg((hits / F.count_if("g")).alias("precision"), (hits / n).alias("recall"), (F.greatest(n, m) / F.least(n, m)).alias("imbalance_ratio"))
    return fine(I.trade_offs(facts), "value", digits=6)


@query("SELECT c_custkey, balance, segment FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 2 > 0 THEN c_mktsegment END AS segment FROM customer) WHERE balance IS NOT NULL OR segment IS NOT NULL")
def customer_known_rows(spark, d):
    """Customers of whom anything but the key is known."""
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 2 > 0, F.col("c_mktsegment")).alias("segment"))
    kept = C.drop_empty_rows(rows.select(F.struct("c_custkey").alias("k"), "balance", "segment").select("balance", "segment", F.when(F.coalesce(F.col("balance").cast("string"), F.col("segment")).isNotNull(), F.col("k")).alias("k")))
    return kept.select("k.c_custkey", "balance", "segment")


_SPREAD = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"WITH v AS ({union([f'SELECT \'{c}\' AS column_name, var_samp({c}) AS v FROM lineitem' for c in _SPREAD])}) SELECT column_name, row_number() OVER (ORDER BY v DESC) AS place FROM v QUALIFY place <= 3")
def lineitem_most_variable(spark, d):
    found = C.most_variable_columns(table(spark, d, "lineitem").select(*_SPREAD), 3)
    return spark.createDataFrame([(c, i) for i, c in enumerate(found, 1)], "column_name string, place long")


@query(f"WITH n AS (SELECT count(*) AS n FROM orders) SELECT unnest(['linear', 'tree'] || CASE WHEN n >= 500 THEN ['forest'] ELSE [] END || CASE WHEN n >= 2000 THEN ['boosted'] ELSE [] END) AS model FROM n")
def order_candidates(spark, d):
    """Models worth trying by the size of the table."""
    rows = table(spark, d, "orders")
    return spark.createDataFrame([(m,) for m in M.candidates(rows.count(), len(rows.columns), "regression")], "model string")


# --- scoring -----------------------------------------------------------------------------------------------------

_LINE = "(SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)"


def _price_model(spark, d):
    return M.fit(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])


@query(f"SELECT count(*) AS rows, {r('avg(a + b * l_quantity)', 2)} AS mean, {r('stddev_samp(a + b * l_quantity)', 2)} AS std, 0::BIGINT AS nulls FROM lineitem, {_LINE}")
def lineitem_scoring_job(spark, d):
    """A saved model, files in, files out, and what was written."""
    path = new_path(spark, "model")
    M.save(_price_model(spark, d), path)
    return fine(M.scoring_job(spark, f"{d}/lineitem.parquet", path, new_path(spark, "scored"), key="l_orderkey"), "mean", "std", digits=2)


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {r('a + b * l_quantity', 2)} AS prediction FROM lineitem, {_LINE}")
def lineitem_stream_scores(spark, d):
    """A fitted model on a stream of lines."""
    stream = spark.readStream.schema(table(spark, d, "lineitem").schema).parquet(f"{d}/lineitem.parque[t]")
    path = new_path(spark, "stream")
    out = T.scored(stream, _price_model(spark, d)).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "prediction")
    return fine(run(out, path), "prediction", digits=2)


def run(stream, path):
    return T.run_once(stream, path, f"{path}-state")


@query()
def price_boosted(spark, d):
    """Boosted trees on all lines, and their errors."""
    lines = table(spark, d, "lineitem")
    found = M.score(M.fit_grouped(lines, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "boosted", maxIter=5, seed=1), lines)
    return V.regression(found, "l_extendedprice", "prediction")


@query()
def linestatus_models(spark, d):
    """Tree, Bayes, support vectors and a perceptron on the same lines, with their accuracies."""
    lines = table(spark, d, "lineitem").select((F.col("l_linestatus") == "O").cast("double").alias("y"), "l_quantity", "l_discount", "l_tax", F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("day"))
    columns = ["l_quantity", "l_discount", "l_tax", "day"]
    out = None
    for name, options in (("tree", {"seed": 1}), ("bayes", {}), ("svm", {"maxIter": 10}), ("mlp", {"layers": [4, 4, 2], "maxIter": 20, "seed": 1})):
        found = V.classification(M.score(M.fit(lines, "y", columns, name, "classification", **options), lines), "y", "prediction").select(F.lit(name).alias("model"), "n", "accuracy", "f1_macro")
        out = found if out is None else out.unionByName(found)
    return out


# --- targets and groups ------------------------------------------------------------------------------------------

_M = "median(l_extendedprice)"


@query(f"""WITH f AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem), v AS (SELECT count(*)::DOUBLE AS rows, 0.0::DOUBLE AS nulls, count(DISTINCT l_extendedprice)::DOUBLE AS "distinct", avg(l_extendedprice) AS mean,
stddev_samp(l_extendedprice) AS std, skewness(l_extendedprice) AS skewness, kurtosis(l_extendedprice) AS kurtosis, min(l_extendedprice) AS least, any_value(a) AS q1, {_M} AS median, any_value(b) AS q3, max(l_extendedprice) AS most,
count(*) FILTER (l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)) / count(*) AS outlier_share FROM lineitem, f)
SELECT measure, {r('value', 4)} AS value FROM (UNPIVOT v ON COLUMNS(*) INTO NAME measure VALUE value)""")
def price_target_summary(spark, d):
    return fine(P.target_summary(table(spark, d, "lineitem"), "l_extendedprice"), "value")


@query(f"""WITH {_CDF}, k AS (SELECT max(abs(fr - fc)) AS s FROM cdf WHERE feature = 'l_extendedprice') SELECT 'prediction' AS kind, 'l_extendedprice' AS feature, 'kolmogorov_smirnov' AS method, {r('s', 3)} AS statistic FROM k
UNION ALL SELECT 'target', 'l_returnflag', 'chi_square', {r('sum((c - r / nr * nc) * (c - r / nr * nc) / (r / nr * nc))', 3)} FROM (SELECT *, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM (SELECT count(*) FILTER (l_shipdate < TIMESTAMP '1998-06-01') AS r, count(*) FILTER (l_shipdate >= TIMESTAMP '1998-06-01') AS c FROM lineitem GROUP BY l_returnflag)) WHERE r > 0""")
def lineitem_target_drift(spark, d):
    """Drift of a target of classes and of numeric predictions."""
    found = D.target_drift(*_sides(spark, d), {"target": "l_returnflag", "prediction": "l_extendedprice"})
    return fine(found.select("kind", "feature", "method", "statistic"), "statistic", digits=3)


_TOP = "WITH p AS (SELECT p_brand AS g, 'p_type' AS c, p_type AS v FROM part UNION ALL SELECT p_brand, 'p_size', p_size::VARCHAR FROM part), n AS (SELECT g, c, v, count(*) AS n FROM p GROUP BY ALL)"


@query(f"""{_TOP} SELECT g AS "group", c AS column_name, row_number() OVER (PARTITION BY g, c ORDER BY n DESC, v) AS rank, v AS value, n, {r('n / sum(n) OVER (PARTITION BY g, c)', 6)} AS share FROM n QUALIFY rank <= 3""")
def brand_categories(spark, d):
    """The three most frequent types and sizes of each brand."""
    return fine(long(P.group_categories(table(spark, d, "part"), "p_brand", ["p_type", "p_size"]), "rank"), "share", digits=6)


@query(f"""WITH {_RATINGS}, v AS (SELECT 'user' AS side, count(*)::DOUBLE AS v FROM ratings GROUP BY "user" UNION ALL SELECT 'item', count(*)::DOUBLE FROM ratings GROUP BY item UNION ALL SELECT 'rating', rating::DOUBLE FROM ratings),
s AS (SELECT side, min(v) AS a, max(v) AS b FROM v GROUP BY side), p AS (SELECT side, a, b, coalesce(least(floor((v - a) / nullif((b - a) / 10, 0)), 9), 0)::BIGINT AS bin FROM v JOIN s USING (side))
SELECT side, bin, {r('a + bin * (b - a) / 10', 4)} AS low, {r('a + (bin + 1) * (b - a) / 10', 4)} AS high, count(*) AS n FROM p GROUP BY side, bin, a, b""")
def ratings_histograms(spark, d):
    return fine(long(R.activity_histograms(_ratings(spark, d)), "bin"), "low", "high")


_TYPED = {"c_custkey": "numeric", "c_nationkey": "numeric", "c_acctbal": "numeric"}


@query(union([f"SELECT '{c}' AS column_name, '{t}' AS simple_type" for c, t in _TYPED.items()] + [f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) / count(*) < 0.5 OR avg(length({c})) < 50 THEN 'categorical' ELSE 'text' END FROM customer" for c in ("c_name", "c_mktsegment")]))
def customer_simple_types(spark, d):
    return P.simple_types(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment"))


_STAMP = "regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}')"


@query(union([f"""SELECT '{c}' AS column_name, CASE WHEN count(*) FILTER ({_STAMP}) / count(*) > 0.8 THEN 'datetime' WHEN count(try_cast(v AS DOUBLE)) / count(*) > 0.8 THEN CASE WHEN bool_and(try_cast(v AS DOUBLE) = floor(try_cast(v AS DOUBLE))) THEN 'integer' ELSE 'float' END
WHEN count(DISTINCT v) / count(*) < 0.1 AND count(DISTINCT v) < 50 THEN 'category' ELSE 'object' END AS inferred_type FROM (SELECT {e} AS v FROM events)""" for c, e in (("kind", "event_type"), ("at", "strftime(ts, '%Y-%m-%d %H:%M:%S')"), ("amount", "value::VARCHAR"), ("user", "user_id::VARCHAR"), ("props", "props"))]))
def events_text_types(spark, d):
    """Types of columns that came as text."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("value").cast("string").alias("amount"), F.col("user_id").cast("string").alias("user"), "props")
    return P.text_column_types(rows)


_SCORED = ["l_quantity", "l_discount", "l_linenumber", "l_orderkey"]


@query(union([f"""SELECT '{c}' AS column_name, 0.0::DOUBLE AS missing_ratio, {r('u', 6)} AS unique_ratio, {r('c', 6)} AS target_correlation, {r('least(1.0, (CASE WHEN u < 0.01 THEN 0.5 WHEN u > 0.99 THEN 0.7 ELSE 1.0 END) * (1 + abs(c)))', 6)} AS score
FROM (SELECT count(DISTINCT {c}) / count(*) AS u, corr({c}, l_extendedprice) AS c FROM lineitem)""" for c in _SCORED]))
def lineitem_feature_scores(spark, d):
    found = P.feature_scores(table(spark, d, "lineitem").select(*_SCORED, "l_extendedprice"), "l_extendedprice")
    return fine(found, "missing_ratio", "unique_ratio", "target_correlation", "score", digits=6)


@query(f"""WITH {_RATINGS}, s AS (SELECT count(DISTINCT "user") AS u, count(DISTINCT item) AS i, count(*) AS n FROM ratings)
SELECT unnest(['popularity', 'matrix_factorisation'] || CASE WHEN 1 - n / (u * i) < 0.99 AND u > 100 AND i > 100 THEN ['collaborative'] ELSE [] END || ['content']) AS algorithm FROM s""")
def ratings_algorithms(spark, d):
    return R.algorithms(_ratings(spark, d), attributes=True)


_MEANS = "SELECT event_type AS name, avg(value) / 100 AS value FROM events GROUP BY event_type"


@query(f"""WITH s AS (SELECT avg(value) AS s FROM ({_MEANS})) SELECT {r('s', 6)} AS score, CASE WHEN s > 0.8 THEN 'Ready' WHEN s > 0.6 THEN 'Needs Review' ELSE 'Not Ready' END AS readiness, CASE WHEN s > 0.6 AND s <= 0.8 THEN 'Medium' ELSE 'High' END AS impact, s <= 0.8 AS actionable FROM s""")
def event_readiness(spark, d):
    means = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg((F.avg("value") / 100).alias("value"))
    return fine(I.readiness(means).drop("description"), "score", digits=6)


@query(f"""WITH i AS (SELECT p_type AS feature, sum(p_retailprice) AS importance FROM part GROUP BY p_type), s AS (SELECT *, importance / sum(importance) OVER () AS s, row_number() OVER (ORDER BY importance DESC, feature) AS k FROM i)
SELECT feature, k AS rank, {r('importance', 2)} AS importance, {r('s', 6)} AS share FROM s WHERE s > 0.15""")
def type_key_features(spark, d):
    """Types that carry much of the catalogue's price, as key features."""
    sums = table(spark, d, "part").groupBy(F.col("p_type").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return fine(fine(long(I.key_features(sums).drop("description"), "rank"), "importance", digits=2), "share", digits=6)


_RULED = "(SELECT event_type AS rule, 'mean of ' || event_type AS message, CASE WHEN avg(value) > 60 THEN 'critical' WHEN avg(value) > 50 THEN 'warning' WHEN avg(value) > 45 THEN 'medium' ELSE 'info' END AS severity FROM events GROUP BY event_type)"


@query(f"""WITH w AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS w FROM {_RULED}),
l AS (SELECT rule, message, w, CASE WHEN w < 2 THEN 'risks' ELSE 'findings' END AS list FROM w UNION ALL SELECT rule, message, w, 'next_steps' FROM w WHERE w < 3)
SELECT list, row_number() OVER (PARTITION BY list ORDER BY w, rule) AS place, rule, message FROM l QUALIFY place <= 5""")
def event_summary_lists(spark, d):
    mean = F.avg("value")
    level = F.when(mean > 60, "critical").when(mean > 50, "warning").when(mean > 45, "medium").otherwise("info")
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("rule")).agg(level.alias("severity")).withColumn("message", F.concat(F.lit("mean of "), "rule"))
    return long(I.summary_lists(rows), "place")


@query()
def embedding_best_start(spark, d):
    """The best of several starts of k-means over all columns, by its sizes."""
    return G.assign(_vectors(spark, d), ["embedding"], 8, starts=3).groupBy("cluster").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_acctbal < 0 THEN 'raised' END AS note, s_nationkey FROM supplier)
SELECT s_suppkey, s_name, s_acctbal, note FROM u WHERE s_nationkey <> 1""")
def suppliers_kept_in_a_catalog(spark, d):
    """A keyed table that is written, changed in place by key, and loses rows."""
    rows, path = table(spark, d, "supplier"), new_path(spark, "catalog")
    kept = rows.select("s_suppkey", "s_name", "s_acctbal")
    K.put(kept, path, ["s_suppkey"])
    K.put(kept.where("s_acctbal < 0").withColumns({"s_acctbal": F.lit(0.0), "note": F.lit("raised")}), path, ["s_suppkey"])
    K.delete(spark, path, rows.where("s_nationkey = 1"), ["s_suppkey"])
    return K.read(spark, path)


@query()
def doc_classified_folds(spark, d):
    """Precision and recall of a text classifier on each fold of documents."""
    joined = _docs(spark, d).join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    return X.classified_folds(joined, "label", k=2)


# --- languages and decompositions --------------------------------------------------------------------------------

_GRAMS = r"""words AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\pL+')) AS w FROM documents), wc AS (SELECT doc_id, lang, '_' || w || '_' AS w, count(*) AS k FROM words GROUP BY ALL),
grams AS (SELECT doc_id, lang, k, unnest(list_filter(flatten(list_transform([1, 2, 3], lambda s: list_transform(range(1, greatest(length(w) - s + 1, 1) + 1), lambda i: substring(w, i, s)))), lambda g: g <> '_')) AS g FROM wc),
counted AS (SELECT doc_id, any_value(lang) AS lang, g, sum(k) AS n FROM grams GROUP BY doc_id, g),
profile AS (SELECT lang AS language, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) AS r FROM counted GROUP BY lang, g QUALIFY r <= 300),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS r FROM counted QUALIFY r <= 300), size AS (SELECT doc_id, count(*) AS m FROM own GROUP BY doc_id),
points AS (SELECT doc_id, language, sum(greatest(0, 300 - abs(own.r - profile.r))) AS p FROM own JOIN profile USING (g) GROUP BY ALL),
near AS (SELECT doc_id, language, 1 - p / (m * 300) AS d, row_number() OVER w AS place, lead(1 - p / (m * 300)) OVER w AS second FROM points JOIN size USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY 1 - p / (m * 300), language)),
found AS (SELECT doc_id, near.language, d AS distance, coalesce((coalesce(second, 1) - d) / nullif(coalesce(second, 1), 0), 0) AS confidence FROM documents LEFT JOIN near USING (doc_id) WHERE coalesce(place, 1) = 1)"""


def _detected(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return L.detect_languages(docs, L.fit_languages(docs))


@query(f"WITH {_GRAMS} SELECT doc_id, language, {r('distance', 6)} AS distance, {r('CASE WHEN distance IS NOT NULL THEN confidence END', 6)} AS confidence FROM found")
def doc_languages_by_profile(spark, d):
    """Languages by n-gram profiles of the documents' own labels."""
    return fine(_detected(spark, d), "distance", "confidence", digits=6)


@query(f"""WITH {_GRAMS}, c AS (SELECT coalesce(language, 'unknown') AS language, count(*) AS n, avg(CASE WHEN distance IS NOT NULL THEN confidence ELSE 0 END) AS k FROM found GROUP BY 1)
SELECT language, n, {r('n / sum(n) OVER ()', 6)} AS share, {r('k', 6)} AS confidence, row_number() OVER (ORDER BY n DESC, language) = 1 AS "primary", count(*) FILTER (language <> 'unknown') OVER () > 1 AS multilingual FROM c""")
def corpus_languages(spark, d):
    return fine(L.corpus_languages(_detected(spark, d)), "share", "confidence", digits=6)


_TWO = "(SELECT var_samp(c_acctbal / 1000) AS a, var_samp(c_nationkey) AS b, covar_samp(c_acctbal / 1000, c_nationkey) AS c FROM customer)"


@query(f"""WITH e AS (SELECT a + b AS t, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c) AS l FROM {_TWO})
SELECT 1::BIGINT AS component, {r('l', 6)} AS variance, {r('l / t', 6)} AS share, {r('l / t', 6)} AS upto FROM e UNION ALL SELECT 2, {r('t - l', 6)}, {r('(t - l) / t', 6)}, 1.0 FROM e""")
def customer_components(spark, d):
    """As many components as explain all the variance of two columns."""
    rows = table(spark, d, "customer").select((F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").alias("y"))
    found = Z.fit_components(rows, ["x", "y"], share=1.0).select(F.col("component").cast("long").alias("component"), "variance", "share", "upto").distinct()
    return fine(found, "variance", "share", "upto", digits=6)


@query()
def doc_singular_vectors(spark, d):
    """Ten components of the TF-IDF rows of all documents: each document's scores."""
    return Z.truncated_svd(X.tf_idf(_docs(spark, d)), 10)[0]
