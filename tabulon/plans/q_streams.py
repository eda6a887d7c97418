"""Queries over sources and over events in time (batch twins of the streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.plans.q_profile import fine, long, r
from tabulon.plans.registry import query, table
from tabulon.sources import files as S
from tabulon.streaming import streams as T

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _text(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


@query(f"SELECT event_type, {TS.format('s')} AS start, count(value) AS n, {r('sum(value)')} AS total, {r('avg(value)')} AS mean, {r('min(value)')} AS least, {r('max(value)')} AS most FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS s FROM events) GROUP BY event_type, s")
def events_window(spark, d):
    return fine(_text(T.windowed(table(spark, d, "events"), "6 hours").drop("end"), "start"), "total", "mean", "least", "most")


@query(f"SELECT event_type, {TS.format('s')} AS start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01 03:00:00')]) AS s FROM events) GROUP BY event_type, s")
def events_sliding_window(spark, d):
    return _text(T.windowed(table(spark, d, "events"), "6 hours", "3 hours").select("event_type", "start", "n"), "start")


@query(f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, {TS.format('min(ts)')} AS start, count(*) AS n FROM s GROUP BY user_id, k")
def events_session(spark, d):
    return _text(T.sessions(table(spark, d, "events"), "6 hours").select("user_id", "start", "n"), "start")


@query(f"SELECT {TS.format('date_trunc(\'day\', ts)')} AS start, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS slow_count, {r('100.0 * count(*) FILTER (event_type = \'error\') / count(*)')} AS error_percent FROM events GROUP BY 1")
def events_request_windows(spark, d):
    out = T.requests(table(spark, d, "events"), "1 day", failed=F.col("event_type") == "error", slow=50.0).drop("p95")
    return fine(_text(out, "start"), "error_percent")


@query(f"SELECT {TS.format('date_trunc(\'day\', ts)')} AS start, count(*) AS n, {r('count(*) FILTER (event_id % 4 = 0) / (2 * count(*))', 6)} AS missing_ratio FROM events GROUP BY 1")
def events_quality_windows(spark, d):
    rows = table(spark, d, "events").select("ts", "user_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"))
    return fine(_text(T.quality(rows, ["user_id", "value"]).drop("distinct_ratio"), "start"), "missing_ratio", digits=6)


EDGES = [0.0, 10.0, 25.0, 50.0, 100.0]


@query(f"SELECT {TS.format('date_trunc(\'day\', ts)')} AS start, CASE WHEN value >= 0 AND value < 100 THEN CASE WHEN value < 10 THEN 1 WHEN value < 25 THEN 2 WHEN value < 50 THEN 3 ELSE 4 END END::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def events_bucket_windows(spark, d):
    return long(_text(T.bucket_counts(table(spark, d, "events"), EDGES), "start"), "bin")


@query(f"""WITH b AS (SELECT date_trunc('day', ts) AS s, CASE WHEN value >= 0 AND value < 100 THEN CASE WHEN value < 10 THEN 1 WHEN value < 25 THEN 2 WHEN value < 50 THEN 3 ELSE 4 END END AS bin FROM events),
n AS (SELECT s, count(*) AS n FROM b GROUP BY s HAVING count(*) >= 10), c AS (SELECT s, bin, count(*) AS k FROM b GROUP BY ALL),
p AS (SELECT n.s, n, greatest(coalesce(k, 0) / n, 0.001) AS c FROM n CROSS JOIN range(1, 5) g(bin) LEFT JOIN c ON c.s = n.s AND c.bin = g.bin)
SELECT {TS.format('s')} AS start, n, {r('sum((c - 0.25) * ln(c / 0.25))', 6)} AS psi FROM p GROUP BY s, n""")
def events_window_psi(spark, d):
    found = T.window_psi(T.bucket_counts(table(spark, d, "events"), EDGES), [0.25, 0.25, 0.25, 0.25], least=10)
    return fine(_text(found, "start"), "psi", digits=6)


@query(f"""WITH RECURSIVE a AS (SELECT event_type AS key, ts, value AS score, epoch(ts) AS sec, floor(epoch(ts) / 86400) AS day, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS i FROM events WHERE value > 20),
w AS (SELECT key, ts, score, i, true AS sent, sec AS last, day, 1 AS k FROM a WHERE i = 1
UNION ALL SELECT a.key, a.ts, a.score, a.i, s, CASE WHEN s THEN a.sec ELSE w.last END, a.day, CASE WHEN a.day = w.day THEN w.k ELSE 0 END + s::INT
  FROM w JOIN a ON a.key = w.key AND a.i = w.i + 1, LATERAL (SELECT a.sec - w.last >= 3600 AND (a.day <> w.day OR w.k < 5) AS s))
SELECT key, {TS.format('ts')} AS ts, score FROM w WHERE sent""")
def events_alerts(spark, d):
    alerts = table(spark, d, "events").where("value > 20").select(F.col("event_type").alias("key"), "ts", F.col("value").alias("score"))
    return _text(T.limited_alerts(alerts, cooldown_seconds=3600, daily=5), "ts")


@query("SELECT user_id, event_type, min(ts)::DATE::VARCHAR AS day FROM events GROUP BY user_id, event_type")
def events_deduplicated(spark, d):
    return T.deduplicated(table(spark, d, "events"), ["user_id", "event_type"]).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, c_mktsegment AS segment FROM events LEFT JOIN customer ON user_id = c_custkey")
def events_enriched(spark, d):
    features = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return T.enriched(table(spark, d, "events").select("event_id", "user_id"), features, "user_id").drop("user_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def events_retained(spark, d):
    events = table(spark, d, "events")
    last = events.agg(F.max("ts").alias("t")).first()["t"]
    return T.retained(events, 3, last).select("event_id")


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS \"p.k\" FROM events")
def event_props_flat(spark, d):
    parsed = table(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT").alias("p"))
    return S.flatten(parsed)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE ts >= TIMESTAMP '1990-01-01' GROUP BY user_id")
def events_materialised(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id")
    return S.materialise(rows, "user_id", "ts", "1990-01-01", "2999-01-01").select("user_id", "event_id")


@query("SELECT c_custkey AS user_id, e AS event_id FROM customer LEFT JOIN (SELECT user_id AS u, max(event_id) AS e FROM events GROUP BY user_id) ON u = c_custkey")
def customers_online_features(spark, d):
    latest = table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return S.online(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), latest, "user_id")


@query("SELECT doc_id AS file, CASE WHEN c >= greatest(s, t, p) THEN 'comma' WHEN s >= greatest(t, p) THEN 'semicolon' WHEN t >= p THEN 'tab' ELSE 'pipe' END AS delimiter FROM (SELECT doc_id, len(text) - len(replace(text, ',', '')) AS c, len(text) - len(replace(text, ';', '')) AS s, len(text) - len(replace(text, chr(9), '')) AS t, len(text) - len(replace(text, '|', '')) AS p FROM documents)")
def documents_delimiter(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("value"), F.lit(0).alias("position"))
    return S.detect_delimiter(lines)


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(csv|tsv|txt)$') THEN 'csv' WHEN regexp_matches(lower(url), '\\.json$') THEN 'json' ELSE 'csv' END AS format FROM pages")
def pages_format(spark, d):
    return table(spark, d, "pages").select("page_id", S.detect_format(F.col("url")).alias("format"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name FROM customer")
def customer_null_tokens(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, " N/A ").otherwise(F.col("c_name")).alias("c_name"))
    return S.null_tokens(rows)
