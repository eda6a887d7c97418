"""Queries through forests that are kept as tables of nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.storage import new_path
from tabulon.operators import fitted, forest
from tabulon.plans.q_profile import fine, r
from tabulon.plans.registry import query, table

_TREES, _SAMPLE = 12, 64


def _u(what: str) -> str:
    """A number from 0 to 1 of seed, tree and node."""
    return f"('0x' || substr(md5('7:' || t || ':' || path || ':{what}'), 1, 13))::BIGINT / 4503599627370496.0"


def _path(n: str) -> str:
    return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649) - 2 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1 ELSE 0 END"


#: Grows the trees level by level over ``given`` (k, x, y) and walks them for ``asked`` (id, x, y).
_WALK = f"""
share AS (
  SELECT {2 * _TREES * _SAMPLE}.0 / count(*) AS share FROM given
), pool AS (
  SELECT k, x, y FROM given, share WHERE share >= 1 OR md5(k || ':pool:7') < lower(lpad(to_hex(floor(share * 1152921504606846976.0)::BIGINT), 15, '0'))
), drawn AS (
  SELECT t, x, y FROM pool, range({_TREES}) AS r(t)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY md5(k || ':' || t || ':7'), k) <= {_SAMPLE}
), most AS (
  SELECT t, count(*) AS drawn, greatest(1, ceil(log2(greatest(2, count(*)))))::INT AS deepest FROM drawn GROUP BY t
), seen AS (
  SELECT t, x, y, 1::BIGINT AS path, 0 AS depth FROM drawn
  UNION ALL
  SELECT t, x, y, 2 * path + (CASE WHEN on_x THEN x > x0 + u * (x1 - x0) ELSE y > y0 + u * (y1 - y0) END)::INT, depth + 1
  FROM (SELECT *, {_u("cut")} AS u, x1 > x0 AND (y1 = y0 OR {_u("column")} < 0.5) AS on_x
    FROM (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM seen WINDOW w AS (PARTITION BY t, path)))
  JOIN most USING (t) WHERE depth < deepest AND (x1 > x0 OR y1 > y0)
), spans AS (
  SELECT t, path, depth, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM seen GROUP BY t, path, depth
), nodes AS (
  SELECT t, path, depth < deepest AND (x1 > x0 OR y1 > y0) AS inner_, x1 > x0 AND (y1 = y0 OR {_u("column")} < 0.5) AS on_x,
    x0 + {_u("cut")} * (x1 - x0) AS cut_x, y0 + {_u("cut")} * (y1 - y0) AS cut_y, depth + {_path("n")} AS length FROM spans JOIN most USING (t)
), walk AS (
  SELECT id, x, y, t, 1::BIGINT AS path FROM asked, range({_TREES}) AS r(t)
  UNION ALL
  SELECT id, x, y, t, 2 * path + (CASE WHEN on_x THEN x > cut_x ELSE y > cut_y END)::INT FROM walk JOIN nodes USING (t, path) WHERE inner_
), scored AS (
  SELECT id, pow(2, -avg(length) / (SELECT max({_path("drawn")}) FROM most)) AS score FROM walk JOIN nodes USING (t, path) WHERE NOT inner_ GROUP BY id
)"""


@query(f"""WITH RECURSIVE given AS (SELECT c_custkey AS k, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer),
asked AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier), {_WALK}
SELECT id AS s_suppkey, {r("score", 6)} AS score FROM scored""")
def suppliers_isolated_among_customers(spark, d):
    """A forest grown on customers, saved, read again, scores suppliers."""
    given = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    path = new_path(spark, "forest")
    fitted.save(forest.fit_forest(given, ["x", "y"], "c_custkey", trees=_TREES, sample=_SAMPLE), path)
    asked = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("y"))
    return fine(forest.forest_scores(asked, spark.read.parquet(path)).select("s_suppkey", "score"), "score", digits=6)


@query(f"""WITH RECURSIVE given AS (SELECT o_orderkey AS k, o_totalprice AS x, (epoch(o_orderdate) / 86400)::DOUBLE AS y FROM orders),
asked AS (SELECT k AS id, x, y FROM given), {_WALK}
SELECT id AS o_orderkey, {r("score", 6)} AS score FROM scored""")
def orders_forest_scores(spark, d):
    """A forest grown on orders scores all of them."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000).alias("y"))
    nodes = forest.fit_forest(rows, ["x", "y"], "o_orderkey", trees=_TREES, sample=_SAMPLE)
    return fine(forest.forest_scores(rows, nodes).select("o_orderkey", "score"), "score", digits=6)
