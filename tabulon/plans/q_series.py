"""Queries over time series: daily events and revenue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import series as S
from tabulon.plans.q_profile import fine, long, r, union
from tabulon.plans.registry import query, table

_DAILY = "daily AS (SELECT event_type AS series, date_trunc('day', ts) AS ts, sum(value) AS y FROM events GROUP BY ALL)"
_IDX = f"{_DAILY}, idx AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS t FROM daily)"


def _daily(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.date_trunc("day", "ts").alias("ts")).agg(F.sum("value").alias("y"))


def _key(df):
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


DAY = "strftime(ts, '%Y-%m-%d')"


@query(f"WITH {_DAILY} SELECT series, {DAY} AS ts, {r('y')} AS y FROM daily WHERE series IN (SELECT series FROM daily GROUP BY series HAVING count(*) >= 10)")
def daily_series(spark, d):
    return fine(_key(S.clean(_daily(spark, d))), "y")


@query(f"WITH {_DAILY}, g AS (SELECT series, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series ORDER BY ts)) AS gap FROM daily) SELECT series, {r('median(gap)')} AS gap_seconds, CASE WHEN median(gap) < 60 THEN 'S' WHEN median(gap) < 3600 THEN 'T' WHEN median(gap) < 86400 THEN 'H' WHEN median(gap) < 432000 THEN 'D' ELSE 'W' END AS frequency FROM g GROUP BY series")
def daily_frequency(spark, d):
    return fine(S.frequency(_daily(spark, d)), "gap_seconds")


@query(f"""WITH {_DAILY}, thin AS (SELECT * FROM daily WHERE day(ts) % 3 != 0), span AS (SELECT series, min(ts) AS a, max(ts) AS b FROM thin GROUP BY series),
cal AS (SELECT series, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM span), j AS (SELECT c.series, c.ts, y FROM cal c LEFT JOIN thin USING (series, ts)),
q AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER b AS t0, last_value(y IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN y IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER a AS t1, first_value(y IGNORE NULLS) OVER a AS v1 FROM j
 WINDOW b AS (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, {DAY} AS ts, {r('coalesce(y, v0 + coalesce((v1 - v0) / nullif(t1 - t0, 0), 0) * (epoch(ts) - t0))')} AS y FROM q""")
def daily_regularised(spark, d):
    return fine(_key(S.regularise(_daily(spark, d).where(F.dayofmonth("ts") % 3 != 0))), "y")


@query(f"WITH {_DAILY}, q AS (SELECT series, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM daily GROUP BY series) SELECT series, {DAY} AS ts, {r('CASE WHEN b > a THEN least(greatest(y, a - 1.5 * (b - a)), b + 1.5 * (b - a)) ELSE y END')} AS y FROM daily JOIN q USING (series)")
def daily_clipped(spark, d):
    return fine(_key(S.treat_outliers(_daily(spark, d))), "y")


_LAGS = (1, 2, 3, 7)


@query(f"WITH {_DAILY}, l AS (SELECT series, y, {', '.join(f'lag(y, {k}) OVER w AS l{k}' for k in _LAGS)} FROM daily WINDOW w AS (PARTITION BY series ORDER BY ts)) " + union([f"SELECT series, {k} AS lag, {r(f'corr(y, l{k})', 6)} AS acf, abs(corr(y, l{k})) > 0.1 AS significant FROM l GROUP BY series" for k in _LAGS]))
def daily_acf(spark, d):
    return fine(long(S.autocorrelation(_daily(spark, d), list(_LAGS)), "lag"), "acf", digits=6)


@query(f"WITH {_DAILY}, l AS (SELECT series, y, lag(y, 2) OVER w AS l2, lag(y, 7) OVER w AS l7 FROM daily WINDOW w AS (PARTITION BY series ORDER BY ts)), c AS (SELECT series, 2 AS p, corr(y, l2) AS x, count(*) AS n FROM l GROUP BY series UNION ALL SELECT series, 7, corr(y, l7), count(*) FROM l GROUP BY series) SELECT series, CASE WHEN max(x) FILTER (n > 2 * p AND x > 0.05) IS NOT NULL THEN arg_max(p, x) FILTER (n > 2 * p AND x > 0.05) END AS period, {r('max(x) FILTER (n > 2 * p AND x > 0.05)', 6)} AS strength FROM c GROUP BY series")
def daily_seasonality(spark, d):
    return fine(long(S.seasonality(_daily(spark, d), (2, 7), limit=0.05), "period"), "strength", digits=6)


@query(f"""WITH {_DAILY} SELECT series, {DAY} AS ts, month(ts) AS month, isodow(ts) - 1 AS weekday, {r('lag(y, 1) OVER w')} AS lag_1, {r('lag(y, 7) OVER w')} AS lag_7, {r('y - lag(y) OVER w')} AS diff,
 {r('CASE WHEN count(y) OVER f = 7 THEN avg(y) OVER f END')} AS mean_7, {r('CASE WHEN count(y) OVER f = 7 THEN stddev_samp(y) OVER f END')} AS std_7 FROM daily WINDOW w AS (PARTITION BY series ORDER BY ts), f AS (PARTITION BY series ORDER BY ts ROWS 6 PRECEDING)""")
def daily_features(spark, d):
    found = S.features(_daily(spark, d), lags=(1, 7), windows=(7,)).select("series", "ts", "month", "weekday", "lag_1", "lag_7", "diff", "mean_7", "std_7")
    return fine(long(_key(found), "month", "weekday"), "lag_1", "lag_7", "diff", "mean_7", "std_7")


@query(f"WITH {_DAILY} SELECT series, ts, inputs, target FROM (SELECT series, {DAY} AS ts, array_to_string(list_transform(list(round(y, 3)) OVER f, lambda x: printf('%.3f', x)), ',') AS inputs, len(list(y) OVER f) AS n, {r('y', 3)} AS target FROM daily WINDOW f AS (PARTITION BY series ORDER BY daily.ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE n = 3")
def daily_windows(spark, d):
    found = S.windows(_daily(spark, d).withColumn("y", F.round("y", 3)), 3)
    text = F.array_join(F.transform("inputs", lambda x: F.format_string("%.3f", x)), ",")
    return fine(_key(found.withColumn("inputs", text)), "target", digits=3)


@query(f"WITH {_DAILY} SELECT series, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS start, strftime(max(ts), '%Y-%m-%d') AS \"end\", {r('avg(y)')} AS mean, {r('stddev_samp(y)')} AS std, {r('min(y)')} AS least, {r('max(y)')} AS most, {r('kurtosis_pop(y)')} AS kurtosis, {r('skewness(y)')} AS sample_skewness, {r('kurtosis(y)')} AS sample_kurtosis FROM daily GROUP BY series")
def daily_summary(spark, d):
    found = S.summary(_daily(spark, d)).drop("skewness").withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end")})
    return fine(found, "mean", "std", "least", "most", "kurtosis", "sample_skewness", "sample_kurtosis")


@query(f"WITH {_IDX} SELECT series, {r('regr_slope(y, t)')} AS slope, {r('regr_r2(y, t)', 6)} AS r2, count(*) AS n, CASE WHEN regr_slope(y, t) > 0 THEN 'increasing' WHEN regr_slope(y, t) < 0 THEN 'decreasing' ELSE 'flat' END AS direction FROM idx GROUP BY series")
def daily_trend(spark, d):
    return fine(fine(S.trend(_daily(spark, d)), "slope"), "r2", digits=6)


@query(f"""WITH {_IDX}, tr AS (SELECT *, CASE WHEN count(y) OVER f = 7 THEN avg(y) OVER f END AS trend FROM idx WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
se AS (SELECT *, avg(y - trend) OVER (PARTITION BY series, t % 7) AS s FROM tr), ce AS (SELECT series, avg(s) AS c FROM (SELECT DISTINCT series, t % 7 AS k, s FROM se) GROUP BY series)
SELECT series, {DAY} AS ts, {r('trend')} AS trend, {r('s - c')} AS seasonal, {r('y - trend - (s - c)')} AS residual FROM se JOIN ce USING (series)""")
def daily_decomposition(spark, d):
    return fine(_key(S.decompose(_daily(spark, d), 7).select("series", "ts", "trend", "seasonal", "residual")), "trend", "seasonal", "residual")


@query(f"""WITH {_DAILY}, w AS (SELECT series, ts, y, lag(y) OVER o AS x, y - lag(y) OVER o AS dd, y - avg(y) OVER (PARTITION BY series) AS e FROM daily WINDOW o AS (PARTITION BY series ORDER BY ts)),
s AS (SELECT *, sum(e) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cs FROM w), a AS (SELECT series, regr_slope(dd, x) AS b, regr_sxx(dd, x) AS sxx, regr_syy(dd, x) AS syy, count(dd) AS m, count(y) AS n, sum(cs * cs) AS ss, sum(e * e) AS ee FROM s GROUP BY series),
q AS (SELECT series, b / sqrt((syy - b * b * sxx) / (m - 2) / sxx) AS adf, ss / (n * ee) AS kpss FROM a)
SELECT series, {r('adf', 3)} AS adf, {r('kpss', 3)} AS kpss, adf < -2.86 AND kpss < 0.463 AS stationary FROM q""")
def daily_stationarity(spark, d):
    return fine(S.stationarity(_daily(spark, d)), "adf", "kpss", digits=3)


@query(f"""WITH {_IDX}, m AS (SELECT series, max(t) AS tm, max(ts) AS last, stddev_samp(e) AS sg FROM (SELECT *, y - lag(y, 7) OVER (PARTITION BY series ORDER BY ts) AS e FROM idx) GROUP BY series)
SELECT m.series, h AS h, strftime(last + h * INTERVAL 1 DAY, '%Y-%m-%d') AS ts, {r('y')} AS forecast, {r('y - 1.96 * sg * sqrt(ceil(h / 7.0))')} AS lower, {r('y + 1.96 * sg * sqrt(ceil(h / 7.0))')} AS upper FROM m CROSS JOIN range(1, 11) g(h) JOIN idx ON idx.series = m.series AND idx.t > tm - 7 AND idx.t % 7 = (tm + h) % 7""")
def daily_naive_forecast(spark, d):
    return fine(long(_key(S.forecast(_daily(spark, d), 10)), "h"), "forecast", "lower", "upper")


@query(f"""WITH {_IDX}, m AS (SELECT series, max(t) AS tm, max(ts) AS last, stddev_samp(e) AS sg, arg_max(y, t) AS y1, arg_min(y, t) AS y0 FROM (SELECT *, y - lag(y, 1) OVER (PARTITION BY series ORDER BY ts) AS e FROM idx) GROUP BY series)
SELECT series, h AS h, strftime(last + h * INTERVAL 1 DAY, '%Y-%m-%d') AS ts, {r('y1 + h * (y1 - y0) / tm')} AS forecast, {r('y1 + h * (y1 - y0) / tm - 1.96 * sg * sqrt(h)')} AS lower, {r('y1 + h * (y1 - y0) / tm + 1.96 * sg * sqrt(h)')} AS upper FROM m CROSS JOIN range(1, 11) g(h)""")
def daily_drift_forecast(spark, d):
    return fine(long(_key(S.forecast(_daily(spark, d), 10, method="drift")), "h"), "forecast", "lower", "upper")


@query(f"""WITH {_IDX}, l AS (SELECT series, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM idx GROUP BY series), e AS (SELECT idx.series, t, ts, y - a - b * t AS e, a, b FROM idx JOIN l USING (series)),
k AS (SELECT series, t % 7 AS k, avg(e) AS v FROM e GROUP BY ALL), m AS (SELECT series, any_value(a) AS a, any_value(b) AS b, stddev_samp(e) AS s, max(t) AS t, max(ts) AS last FROM e GROUP BY series)
SELECT m.series, h AS h, strftime(last + h * INTERVAL 1 DAY, '%Y-%m-%d') AS ts, {r('a + b * (t + h) + coalesce(v, 0)')} AS forecast, {r('a + b * (t + h) + coalesce(v, 0) - 1.96 * s')} AS lower, {r('a + b * (t + h) + coalesce(v, 0) + 1.96 * s')} AS upper
FROM m CROSS JOIN range(1, 11) g(h) LEFT JOIN k ON k.series = m.series AND k.k = (t + h) % 7""")
def daily_trend_forecast(spark, d):
    return fine(long(_key(S.forecast(_daily(spark, d), 10, method="trend")), "h"), "forecast", "lower", "upper")


@query(f"WITH {_DAILY}, p AS (SELECT series, y AS a, lag(y, 7) OVER (PARTITION BY series ORDER BY ts) AS p FROM daily) SELECT series, count(*) AS n, {r('sqrt(avg((a - p) * (a - p)))')} AS rmse, {r('avg(abs(a - p))')} AS mae, {r('100 * avg(abs((a - p) / a)) FILTER (a != 0)')} AS mape, {r('100 * avg(2 * abs(a - p) / (abs(a) + abs(p)))')} AS smape, {r('1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*))')} AS r2 FROM p WHERE p IS NOT NULL GROUP BY series")
def daily_forecast_accuracy(spark, d):
    from pyspark.sql import Window

    rows = _daily(spark, d).withColumn("forecast", F.lag("y", 7).over(Window.partitionBy("series").orderBy("ts")))
    return fine(S.accuracy(rows, "y", "forecast", ["series"]), "rmse", "mae", "mape", "smape", "r2")


@query()
def daily_backtest(spark, d):
    return S.backtest(_daily(spark, d), folds=2, horizon=5)


@query(f"SELECT event_type AS series, count(*) AS n, {r('count(*) FILTER (event_id % 4 = 0) / count(*)', 6)} AS missing_share, count(*) - count(DISTINCT ts) AS duplicate_times, count(*) >= 10 AND count(*) FILTER (event_id % 4 = 0) / count(*) <= 0.2 AS usable FROM events GROUP BY event_type")
def event_series_checks(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("series"), "ts", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("y"))
    return fine(S.checks(rows), "missing_share", digits=6)


@query(f"SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, {r('sum(o_totalprice)', 2)} AS revenue, {r('sum(o_totalprice) / sum(sum(o_totalprice)) OVER ()', 6)} AS share FROM orders GROUP BY 1")
def monthly_revenue_share(spark, d):
    months = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("revenue"))
    return fine(fine(S.share_of_total(months, "revenue"), "share", digits=6), "revenue", digits=2)
