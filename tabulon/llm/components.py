"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them; ``a > b`` in every link."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    kept = least.select("a", F.col("m").alias("b"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(moved).distinct()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) as ``node, root``: each node that has a link, with the smallest node it is connected to.

    Links count both ways; nulls, repeated links and links of a node with itself are ignored. Alternating large and
    small stars need about log n rounds; every round is checkpointed, and only a count and a checksum of the links reach
    the driver. An empty table gives no rows.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = cut(now), None
    for _ in range(most_rounds):
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(row) == mark or not row[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(row)
        now = cut(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
