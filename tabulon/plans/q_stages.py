"""Queries through own pipeline stages that were saved and loaded, own metrics, and row-expanding functions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tabulon.functions.storage import new_path
from tabulon.operators import custom, stages
from tabulon.plans.q_profile import fine, r, union
from tabulon.plans.registry import query, table
from tabulon.streaming.streams import run_once


def _again(spark, model: PipelineModel) -> PipelineModel:
    """The model as another program gets it: saved and loaded."""
    path = new_path(spark, "stages")
    model.write().save(path)
    return PipelineModel.load(path)


@query(f"""
WITH given AS (SELECT CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS x, c_nationkey::DOUBLE AS y FROM customer),
filled AS (SELECT coalesce(x, (SELECT avg(x) FROM given)) AS x, y FROM given),
q AS (SELECT quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.8) AS hi, quantile_cont(y, 0.1) AS ylo, quantile_cont(y, 0.8) AS yhi FROM filled),
clipped AS (SELECT greatest(lo, least(hi, x)) AS x, greatest(ylo, least(yhi, y)) AS y FROM filled, q),
s AS (SELECT median(x) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS w, median(y) AS ym, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS yw FROM clipped),
new AS (SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END, (SELECT avg(x) FROM given)) AS x, s_nationkey AS y FROM supplier)
SELECT s_suppkey, {r('(greatest(lo, least(hi, x)) - m) / w')} AS balance, {r('(greatest(ylo, least(yhi, y)) - ym) / yw')} AS nation FROM new, q, s
""")
def suppliers_through_saved_stages(spark, d):
    """Filling, clipping and scaling learned on customers, saved, loaded, applied to suppliers."""
    known = lambda key, n, x: F.when(F.col(key) % n > 0, F.col(x))
    names = ["balance", "nation"]
    train = table(spark, d, "customer").select(known("c_custkey", 7, "c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    model = Pipeline(stages=[stages.Fill(inputCols=names), stages.Clip(inputCols=names, lower=0.1, upper=0.8), stages.Scale(inputCols=names, method="robust")]).fit(train)
    new = table(spark, d, "supplier").select("s_suppkey", known("s_suppkey", 5, "s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return fine(_again(spark, model).transform(new), *names)


@query(f"""
WITH n AS (SELECT c_nationkey::VARCHAR AS v, count(*) AS n, sum(c_acctbal) AS s FROM customer GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(s) AS s FROM n),
grouped AS (SELECT CASE WHEN n.n < 0.04 * t.n THEN 'Other' ELSE v END AS v, n.n AS k, n.s AS s FROM n, t),
codes AS (SELECT v, sum(k) AS k, sum(s) AS s FROM grouped GROUP BY v)
SELECT s_suppkey, coalesce(g.v, s_nationkey::VARCHAR) AS nation, {r('coalesce(c.k / t.n, 0)', 6)} AS share, {r('coalesce((c.s + 5 * t.s / t.n) / (c.k + 5), t.s / t.n)', 3)} AS balance
FROM supplier CROSS JOIN t LEFT JOIN (SELECT n.v AS old, CASE WHEN n.n < 0.04 * t.n THEN 'Other' ELSE n.v END AS v FROM n, t) g ON g.old = s_nationkey::VARCHAR LEFT JOIN codes c ON c.v = coalesce(g.v, s_nationkey::VARCHAR)
""")
def suppliers_coded_by_saved_stages(spark, d):
    """Rare nations of customers grouped, then coded by share and by mean balance; saved, loaded, applied to suppliers."""
    train = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), "c_acctbal")
    model = Pipeline(
        stages=[
            stages.GroupRare(inputCols=["nation"], threshold=0.04),
            stages.Encode(inputCols=["nation"], outputCols=["share"]),
            stages.Encode(inputCols=["nation"], outputCols=["balance"], method="target", target="c_acctbal", smoothing=5.0),
        ]
    ).fit(train)
    out = _again(spark, model).transform(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation")))
    return fine(fine(out, "share", digits=6), "balance", digits=3)


@query(f"""
WITH q AS (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events),
c AS (SELECT event_id, event_type, greatest(lo, least(hi, value)) AS v FROM events, q),
m AS (SELECT min(v) AS a, max(v) - min(v) AS w FROM c),
k AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS code FROM events GROUP BY event_type)
SELECT event_id, {r('(v - a) / w', 6)} AS value, {r('code', 6)} AS event_type FROM c JOIN k USING (event_type), m
""")
def events_stream_through_saved_stages(spark, d):
    """The same stages on a stream: learned on the table, saved, loaded, applied to the files as they come."""
    events = table(spark, d, "events")
    model = Pipeline(stages=[stages.Clip(inputCols=["value"], fences=True), stages.Scale(inputCols=["value"], method="minmax"), stages.Encode(inputCols=["event_type"])]).fit(events)
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")  # a pattern may match a file or a folder
    out = _again(spark, model).transform(stream).select("event_id", "value", "event_type")
    path = new_path(spark, "stream")
    return fine(run_once(out, path, f"{path}-state"), "value", "event_type", digits=6)


@stages.transformer("net_price")
def net_price(df, discount: str, price: str, out: str = "net"):
    """A function of the user's own, as a stage: the price less the discount."""
    return df.withColumn(out, F.col(price) * (1 - F.col(discount)))


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {r('l_extendedprice * (1 - l_discount)')} AS net, {r('l_extendedprice * (1 - l_discount) / (l_quantity + 1e-8)')} AS unit, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'few' WHEN l_quantity > 10 AND l_quantity <= 50 THEN 'many' END AS size FROM lineitem")
def lineitem_own_stages(spark, d):
    """A function and rules of the user's own, as stages that were saved and loaded."""
    rules = [{"type": "ratio", "numerator": "net", "denominator": "l_quantity", "name": "unit"}, {"type": "binning", "feature": "l_quantity", "bins": [0, 10, 50], "labels": ["few", "many"], "name": "size"}]
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity", "l_extendedprice", "l_discount")
    model = Pipeline(stages=[stages.Apply(function="net_price", options={"discount": "l_discount", "price": "l_extendedprice"}), stages.Rules(rules=rules)]).fit(lines)
    return fine(_again(spark, model).transform(lines).select("l_orderkey", "l_linenumber", "net", "unit", "size"), "net", "unit")


_ERROR = "abs(l_extendedprice - p)"
_OWN = {
    "mae": (f"avg({_ERROR})", False),
    "r2": ("1 - avg((l_extendedprice - p) ** 2) / var_pop(l_extendedprice)", True),
    "pinball(quantile=0.9)": ("avg(CASE WHEN l_extendedprice >= p THEN 0.9 * (l_extendedprice - p) ELSE 0.1 * (p - l_extendedprice) END)", False),
    "within(share=0.25)": (f"avg(({_ERROR} <= 0.25 * abs(l_extendedprice))::INT)", True),
    "largest": (f"max({_ERROR})", False),
}


@custom.metric("largest", higher_is_better=False)
def largest(y, p):
    return F.max(F.abs(y - p))


@query(f"WITH m AS (SELECT *, l_quantity * 1100.0 AS p FROM lineitem)\n" + union([f"SELECT l_returnflag, count(*) AS n, '{name}' AS metric, {r(sql, 3)} AS value, {str(up).lower()} AS higher_is_better FROM m GROUP BY l_returnflag" for name, (sql, up) in _OWN.items()]))
def price_own_metrics(spark, d):
    """Built-in metrics, some with options, and one of the user's own, in one aggregate."""
    lines = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1100.0)
    found = custom.evaluate(lines, "l_extendedprice", "p", ["mae", "r2", ("pinball", {"quantile": 0.9}), ("within", {"share": 0.25}), "largest"], ["l_returnflag"])
    return fine(found, "value", digits=3)


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, unnest(range(0, len(parts)))::BIGINT AS position, unnest(parts) AS sentence FROM s
""")
def doc_sentences(spark, d):
    """One row for each sentence, by a table function."""
    return custom.expand(table(spark, d, "documents"), "sentences", "text", keep=["doc_id"]).withColumn("position", F.col("position").cast("long"))


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def event_prop_items(spark, d):
    """One row for each member of the events' JSON, by a table function."""
    return custom.expand(table(spark, d, "events"), "json_items", "props", keep=["event_id"])
