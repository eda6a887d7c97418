"""Queries over features, splits and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import features as E
from tabulon.operators import metrics as V
from tabulon.plans.q_profile import fine, long, r, union
from tabulon.plans.registry import query, table


@query(f"SELECT l_orderkey, l_linenumber, {r('l_extendedprice / (l_quantity + 1e-8)')} AS unit_price, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'small' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'medium' WHEN l_quantity > 30 AND l_quantity <= 100 THEN 'large' END AS size, {r('l_discount + l_tax')} AS total_rate, {r('greatest(l_discount, l_tax)')} AS top_rate, {r('l_quantity * l_discount')} AS l_quantity_x_l_discount FROM lineitem")
def lineitem_rules(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rules = [
        {"type": "ratio", "numerator": "l_extendedprice", "denominator": "l_quantity", "name": "unit_price"},
        {"type": "binning", "feature": "l_quantity", "bins": [0, 10, 30, 100], "labels": ["small", "medium", "large"], "name": "size"},
        {"type": "combination", "features": ["l_discount", "l_tax"], "operation": "sum", "name": "total_rate"},
        {"type": "combination", "features": ["l_discount", "l_tax"], "operation": "max", "name": "top_rate"},
    ]
    out = E.interactions(E.business_rules(rows, rules), ["l_quantity", "l_discount"])
    return fine(out.select("l_orderkey", "l_linenumber", "unit_price", "size", "total_rate", "top_rate", "l_quantity_x_l_discount"), "unit_price", "total_rate", "top_rate", "l_quantity_x_l_discount")


_PART_ENC = f"""WITH b AS (SELECT p_brand AS v, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY p_brand)
SELECT p_partkey, i AS brand_index, n AS brand_frequency, {r('(s + (SELECT avg(p_retailprice) FROM part)) / (n + 1)')} AS brand_price, ((i + 1) >> 0) & 1 AS p_brand_bit0, ((i + 1) >> 1) & 1 AS p_brand_bit1 FROM part JOIN b ON v = p_brand"""


@query(_PART_ENC)
def brand_encoded(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    out = E.target_encode(E.frequency_encode(E.label_encode(rows, "p_brand", "brand_index"), "p_brand", "brand_frequency"), "p_brand", "p_retailprice", "brand_price")
    return fine(E.binary_encode(out, "p_brand", 2).select("p_partkey", "brand_index", "brand_frequency", "brand_price", "p_brand_bit0", "p_brand_bit1"), "brand_price")


@query(f"SELECT p_partkey, {r('(sum(p_retailprice) OVER w - p_retailprice) / (count(*) OVER w - 1)', 3)} AS others FROM part WINDOW w AS (PARTITION BY p_brand)")
def brand_leave_one_out(spark, d):
    return fine(E.leave_one_out_encode(table(spark, d, "part"), "p_brand", "p_retailprice", "others").select("p_partkey", "others"), "others", digits=3)


@query(f"WITH c AS (SELECT o_orderpriority AS v, count(*) FILTER (o_orderstatus = 'F') AS p, count(*) FILTER (o_orderstatus != 'F') AS n FROM orders GROUP BY 1), w AS (SELECT v, ln(((p + 0.5) / sum(p) OVER ()) / ((n + 0.5) / sum(n) OVER ())) AS x FROM c) SELECT o_orderkey, {r('x')} AS woe FROM orders JOIN w ON v = o_orderpriority")
def priority_woe(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return fine(E.weight_of_evidence(rows, "o_orderpriority", "y", "woe").select("o_orderkey", "woe"), "woe")


@query("SELECT p_partkey, CASE WHEN (SELECT count(*) FROM part q WHERE q.p_type = p.p_type) >= 0.15 * (SELECT count(*) FROM part) THEN p_type ELSE 'Other' END AS p_type FROM part p")
def type_rare(spark, d):
    return E.group_rare(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", least=0.15)


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::INT AS \"o_orderstatus_{s}\"" for s in ("F", "O", "P")) + " FROM orders")
def status_onehot(spark, d):
    out = E.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")
    return out.select("o_orderkey", *[F.col(f"o_orderstatus_{s}") if f"o_orderstatus_{s}" in out.columns else F.lit(0).alias(f"o_orderstatus_{s}") for s in ("F", "O", "P")])


@query(f"SELECT c_custkey, {r('(c_acctbal - a) / s')} AS standard, {r('(c_acctbal - lo) / (hi - lo)')} AS minmax, {r('(c_acctbal - m) / (q3 - q1)')} AS robust, {r('c_acctbal / sqrt(c_acctbal * c_acctbal + c_nationkey * c_nationkey)')} AS unit FROM customer, (SELECT avg(c_acctbal) AS a, stddev_pop(c_acctbal) AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi, median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer)")
def acctbal_scaled(spark, d):
    x = F.col("c_acctbal")
    rows = table(spark, d, "customer").select("c_custkey", x.alias("standard"), x.alias("minmax"), x.alias("robust"), x.alias("unit"), F.col("c_nationkey").cast("double").alias("other"))
    out = E.scale(E.scale(E.scale(rows, ["standard"]), ["minmax"], "minmax"), ["robust"], "robust")
    return fine(E.unit_length(out, ["unit", "other"]).drop("other"), "standard", "minmax", "robust", "unit")


@query()
def acctbal_transformed(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return E.hash_encode(E.power_transform(E.quantile_transform(rows, "c_acctbal", "normal", normal=True), "c_acctbal", "power"), "c_custkey", "bucket")


@query(f"SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, isodow(o_orderdate) - 1 AS o_orderdate_weekday, dayofyear(o_orderdate) AS o_orderdate_yearday, quarter(o_orderdate) AS o_orderdate_quarter, (isodow(o_orderdate) >= 6)::BIGINT AS o_orderdate_weekend, (day(o_orderdate) = 1)::BIGINT AS o_orderdate_month_start, (last_day(o_orderdate) = o_orderdate::DATE)::BIGINT AS o_orderdate_month_end, {r('sin(2 * pi() * month(o_orderdate) / 12)')} AS o_orderdate_month_sin, {r('cos(2 * pi() * day(o_orderdate) / 31)')} AS o_orderdate_day_cos FROM orders")
def orders_datetime_features(spark, d):
    out = E.datetime_features(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    names = ("year", "weekday", "yearday", "quarter", "weekend", "month_start", "month_end")
    out = out.select("o_orderkey", *[F.col(f"o_orderdate_{n}").cast("long").alias(f"o_orderdate_{n}") for n in names], "o_orderdate_month_sin", "o_orderdate_day_cos")
    return fine(out, "o_orderdate_month_sin", "o_orderdate_day_cos")


def _f_sql(c: str) -> str:
    return f"SELECT '{c}' AS column_name, {r('(sb / (k - 1)) / ((q - g) / (n - k))', 3)} AS f FROM (SELECT count(*) AS k, sum(n) AS n, sum(q) AS q, sum(s * s / n) AS g, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS sb FROM (SELECT l_returnflag, count({c}) AS n, sum({c}) AS s, sum({c} * {c}) AS q FROM lineitem GROUP BY l_returnflag))"


@query(union([_f_sql(c) for c in ("l_quantity", "l_discount", "l_tax")]))
def returnflag_f_scores(spark, d):
    return fine(E.f_scores(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag"), "f", digits=3)


def _mi_sql(c: str) -> str:
    b = f"coalesce(least(floor(({c} - lo) * 10 / (hi - lo)), 9), 0)::BIGINT"
    return f"SELECT '{c}' AS column_name, {r('sum(n / t * ln(n * t / (nb * nl)))', 6)} AS mutual_information FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY bin) AS nb, sum(n) OVER (PARTITION BY l_linestatus) AS nl FROM (SELECT l_linestatus, {b} AS bin, count(*) AS n FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY ALL))"


@query(union([_mi_sql(c) for c in ("l_quantity", "l_linenumber")]))
def linestatus_information(spark, d):
    return fine(E.mutual_information(table(spark, d, "lineitem"), ["l_quantity", "l_linenumber"], "l_linestatus"), "mutual_information", digits=6)


_HASH = "('0x' || substr(md5(o_orderkey || ':42'), 1, 8))::BIGINT / 4294967296.0"


@query(f"SELECT o_orderkey, CASE WHEN {_HASH} < 0.2 THEN 'test' WHEN {_HASH} < 0.3 THEN 'validation' ELSE 'train' END AS part, floor({_HASH} * 5)::BIGINT AS fold, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_HASH}, o_orderkey) - 1) % 5 AS class_fold FROM orders")
def orders_split(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    out = E.folds(E.split(rows, "o_orderkey", validation=0.1), "o_orderkey")
    out = E.folds(out.withColumnRenamed("fold", "f"), "o_orderkey", stratify="o_orderstatus").withColumnRenamed("fold", "class_fold").withColumnRenamed("f", "fold")
    return long(out.drop("o_orderstatus"), "fold", "class_fold")


_PRICE = "(SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS y, p_retailprice * l_quantity AS p FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _price(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("p_retailprice") * F.col("l_quantity")).alias("p"))


@query(f"SELECT l_returnflag, count(*) AS n, {r('avg((y - p) * (y - p))', 2)} AS mse, {r('sqrt(avg((y - p) * (y - p)))')} AS rmse, {r('avg(abs(y - p))')} AS mae, {r('1 - avg((y - p) * (y - p)) / var_pop(y)')} AS r2, {r('100 * avg(abs((y - p) / y)) FILTER (y != 0)')} AS mape, {r('100 * avg(2 * abs(y - p) / (abs(y) + abs(p)))')} AS smape, {r('median(abs(y - p))')} AS median_error, {r('max(abs(y - p))')} AS max_error, {r('1 - var_pop(y - p) / var_pop(y)')} AS explained_variance, {r('corr(y, p)')} AS pearson FROM {_PRICE} GROUP BY l_returnflag")
def price_regression_metrics(spark, d):
    return fine(fine(V.regression(_price(spark, d), "y", "p", ["l_returnflag"]), "mse", digits=2), "rmse", "mae", "r2", "mape", "smape", "median_error", "max_error", "explained_variance", "pearson")


@query(f"WITH k AS (SELECT y, p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS b FROM {_PRICE}) SELECT {r('corr(a, b)')} AS spearman, count(*) AS n FROM k")
def price_rank_correlation(spark, d):
    return fine(V.spearman(_price(spark, d), "y", "p"), "spearman")


@query(f"WITH e AS (SELECT y - p AS e FROM {_PRICE}), q AS (SELECT quantile_cont(e, 0.25) AS a, quantile_cont(e, 0.75) AS b FROM e) SELECT {r('avg(e)', 3)} AS mean, {r('stddev_pop(e)', 3)} AS std, {r('kurtosis_pop(e)', 3)} AS kurtosis, {r('100 * count(*) FILTER (e < a - 1.5 * (b - a) OR e > b + 1.5 * (b - a)) / count(*)')} AS outlier_percent FROM e, q")
def price_residuals(spark, d):
    return fine(fine(V.residuals(_price(spark, d), "y", "p").drop("skewness"), "mean", "std", "kurtosis", digits=3), "outlier_percent")


@query(f"SELECT l_orderkey * 10 + l_linenumber AS key, {r('y - p')} AS residual FROM {_PRICE} ORDER BY abs(y - p) DESC, key LIMIT 10")
def price_largest_errors(spark, d):
    rows = _price(spark, d).withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return fine(V.largest_errors(rows, "key", "y", "p"), "residual")


_JUDGED = "(SELECT doc_id, quality AS y, (d.n_chars > 400)::INT AS p, least(d.n_chars, 4000) / 4000 AS s FROM labels JOIN documents d USING (doc_id))"


def _judged(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").cast("int").alias("y"), (F.col("n_chars") > 400).cast("int").alias("p"), (F.least(F.col("n_chars"), F.lit(4000)) / 4000).alias("s"))


@query(f"SELECT y AS actual, p AS predicted, count(*) AS n FROM {_JUDGED} GROUP BY ALL")
def quality_confusion(spark, d):
    return V.confusion(_judged(spark, d), "y", "p")


_REPORT = f"WITH c AS (SELECT y, p, count(*) AS n FROM {_JUDGED} GROUP BY ALL), l AS (SELECT y AS label FROM c UNION SELECT p FROM c), rep AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE y = label), 0) AS s, coalesce((SELECT sum(n) FROM c WHERE p = label), 0) AS g, coalesce((SELECT sum(n) FROM c WHERE y = label AND p = label), 0) AS h FROM l), m AS (SELECT *, CASE WHEN g > 0 THEN h / g ELSE 0 END AS pr, CASE WHEN s > 0 THEN h / s ELSE 0 END AS re, CASE WHEN s + g > 0 THEN 2 * h / (s + g) ELSE 0 END AS f FROM rep)"


@query(f"{_REPORT} SELECT label, s::BIGINT AS support, g::BIGINT AS guessed, h::BIGINT AS hit, {r('pr', 6)} AS precision, {r('re', 6)} AS recall, {r('f', 6)} AS f1 FROM m")
def quality_class_report(spark, d):
    return fine(V.class_report(_judged(spark, d), "y", "p"), "precision", "recall", "f1", digits=6)


@query(f"{_REPORT}, t AS (SELECT sum(s)::DOUBLE AS n, sum(h)::DOUBLE AS h, sum(s * g)::DOUBLE AS x, sum(s * s)::DOUBLE AS ss, sum(g * g)::DOUBLE AS gg, avg(pr) AS pm, avg(re) AS rm, avg(f) AS fm, sum(pr * s) / sum(s) AS pw, sum(re * s) / sum(s) AS rw, sum(f * s) / sum(s) AS fw, avg(re) FILTER (s > 0) AS ba FROM m) SELECT n::BIGINT AS n, {r('h / n', 6)} AS accuracy, {r('pm', 6)} AS precision_macro, {r('rm', 6)} AS recall_macro, {r('fm', 6)} AS f1_macro, {r('pw', 6)} AS precision_weighted, {r('rw', 6)} AS recall_weighted, {r('fw', 6)} AS f1_weighted, {r('ba', 6)} AS balanced_accuracy, {r('(h / n - x / (n * n)) / (1 - x / (n * n))', 6)} AS kappa, {r('(h * n - x) / sqrt((n * n - ss) * (n * n - gg))', 6)} AS mcc FROM t")
def quality_metrics(spark, d):
    out = V.classification(_judged(spark, d), "y", "p")
    return fine(out, *[c for c in out.columns if c != "n"], digits=6)


@query(f"WITH b AS (SELECT s, sum(y) AS p, count(*) AS k FROM {_JUDGED} GROUP BY s), c AS (SELECT *, sum(p) OVER u AS tp, sum(k) OVER u AS n, sum(p) OVER () AS tot, sum(k) OVER () AS m FROM b WINDOW u AS (ORDER BY s DESC)) SELECT (SELECT {r('sum((k - p) * (tp - p / 2)) / (max(tot) * (max(m) - max(tot)))', 6)} FROM c) AS roc_auc, (SELECT {r('sum(p / tot * tp / n)', 6)} FROM c) AS average_precision, {r('-avg(y * ln(greatest(1e-15, least(1 - 1e-15, s))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, s))))')} AS log_loss, {r('avg((y - s) * (y - s))', 6)} AS brier, count(*) AS n FROM {_JUDGED}")
def quality_auc(spark, d):
    return fine(fine(V.ranking_curve(_judged(spark, d), "y", "s"), "log_loss"), "roc_auc", "average_precision", "brier", digits=6)


_FOLDS = f"SELECT (l_orderkey % 5)::BIGINT AS fold, 'price' AS model, 1 - avg((y - p) * (y - p)) / var_pop(y) AS score FROM {_PRICE} GROUP BY 1 UNION ALL SELECT l_orderkey % 5, 'mean', 1 - avg((y - 38000) * (y - 38000)) / var_pop(y) FROM {_PRICE} GROUP BY 1"


def _fold_scores(spark, d):
    rows = _price(spark, d).withColumn("f", F.col("l_orderkey") % 5)
    a = V.fold_scores(rows, "f", "y", "p").withColumn("model", F.lit("price"))
    return a.unionByName(V.fold_scores(rows.withColumn("p", F.lit(38000.0)), "f", "y", "p").withColumn("model", F.lit("mean")))


@query(f"WITH f AS ({_FOLDS}) SELECT model, count(*) AS n, {r('avg(score)')} AS mean, {r('stddev_samp(score)')} AS std, {r('avg(score) - 2.776 * stddev_samp(score) / sqrt(5)')} AS lower, {r('avg(score) + 2.776 * stddev_samp(score) / sqrt(5)')} AS upper FROM f GROUP BY model")
def price_fold_interval(spark, d):
    return fine(V.fold_interval(_fold_scores(spark, d), ["model"]), "mean", "std", "lower", "upper")


@query(f"WITH f AS ({_FOLDS}), p AS (SELECT a.model AS model_a, b.model AS model_b, a.score - b.score AS x FROM f a JOIN f b ON a.fold = b.fold AND a.model < b.model) SELECT model_a, model_b, count(*) AS folds, {r('avg(x)')} AS mean_difference, {r('avg(x) / (stddev_samp(x) / sqrt(count(*)))', 1)} AS t FROM p GROUP BY ALL")
def price_model_comparison(spark, d):
    return fine(fine(V.paired_comparison(_fold_scores(spark, d)).drop("p_value"), "mean_difference"), "t", digits=1)


@query(f"SELECT {r('sqrt(avg((y - p) * (y - p)))', 3)} AS model, {r('stddev_pop(y)', 3)} AS baseline, {r('(stddev_pop(y) - sqrt(avg((y - p) * (y - p)))) / stddev_pop(y)')} AS improvement FROM {_PRICE}")
def price_baseline(spark, d):
    return fine(fine(V.baseline(_price(spark, d), "y", "p"), "model", "baseline", digits=3), "improvement")


@query(f"WITH s AS (SELECT p_brand AS feature, sum(p_retailprice) AS i FROM part GROUP BY 1), w AS (SELECT feature, i / sum(i) OVER () AS share FROM s) SELECT feature, {r('share', 6)} AS share, {r('share * 1000')} AS worth, {r('CASE WHEN feature < \'Brand#3\' THEN 10.0 ELSE 0.0 END')} AS cost, {r('share * 1000 - CASE WHEN feature < \'Brand#3\' THEN 10.0 ELSE 0.0 END')} AS net, {r('CASE WHEN feature < \'Brand#3\' THEN (share * 1000 - 10.0) / 10.0 END')} AS roi FROM w")
def brand_value(spark, d):
    brands = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    costs = brands.where("feature < 'Brand#3'").select("feature", F.lit(10.0).alias("cost"))
    return fine(fine(V.feature_value(brands, costs, 1000.0), "worth", "cost", "net", "roi"), "share", digits=6)


@query(f"SELECT event_type AS model, 'value' AS metric, count(*) AS n, {r('avg(value)')} AS mean, {r('max(value)')} AS best, {r('arg_max(value, (ts, value))')} AS latest FROM events GROUP BY 1")
def events_metric_history(spark, d):
    logged = table(spark, d, "events").select(F.col("event_type").alias("model"), F.lit("value").alias("metric"), "value", "ts")
    return fine(V.history(logged, "1970-01-01"), "mean", "best", "latest")
