"""Isolation forests as a table of nodes: grown once, saved, and applied to any rows by array expressions.

Everything random comes from hashes of (seed, tree, node) and of (seed, tree, key), so that the same rows give the same
forest however they are partitioned.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.storage import cut

NODES = "tree int, node int, path long, column_name string, cut double, left int, right int, length double, drawn int, n int"
#: Nodes that the one-row table of a forest may hold when it is broadcast.
MOST_NODES = 2_000_000


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows, by which path lengths are measured."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _chance(seed: int, tree: int, path: int, what: str) -> float:
    return int(hashlib.md5(f"{seed}:{tree}:{path}:{what}".encode()).hexdigest()[:13], 16) / 16**13


def _drawn(df: DataFrame, columns: list[str], key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """``tree, x, key`` of the ``sample`` rows of each tree whose hashes are lowest.

    A pool of about twice as many rows as all trees take together is drawn first, by one hash for each row; what then goes
    to each tree is at most ``sample`` rows of each partition (Spark cuts ranks before it shuffles) and ``sample`` in the end.
    """
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), x.alias("x")).where(F.col("key").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    total = rows.count()
    share = min(1.0, 2 * trees * sample / max(1, total))
    if share < 1:
        rows = rows.where(F.md5(F.concat(F.col("key"), F.lit(f":pool:{seed}"))) < F.lit(format(int(share * 16**15), "015x")))
    h = F.md5(F.concat_ws(":", "key", F.col("tree").cast("string"), F.lit(str(seed))))
    dealt = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", h)
    w = Window.partitionBy("tree").orderBy("h", "key", "x")
    return dealt.withColumn("i_", F.row_number().over(w)).where(F.col("i_") <= sample).select("tree", "x", "i_")


def fit_forest(df: DataFrame, columns: list[str], key: str, *, trees: int = 50, sample: int = 256, seed: int = 7) -> DataFrame:
    """The nodes of a forest grown on ``columns``; a tree sees ``sample`` rows and has less than twice as many nodes.

    A node of ``path`` p splits into 2p (values up to ``cut`` of ``column_name``) and 2p + 1; ``left`` and ``right`` are
    their places among the tree's nodes. A leaf has no column; its ``length`` is its depth and what its ``n`` rows would add.
    Rows with a null in the key or a column aren't drawn; an empty table gives no nodes.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows.sort_values("i_")["x"].tolist(), float)
        tree, most = int(rows["tree"].iloc[0]), math.ceil(math.log2(max(2, len(x))))
        out: list[tuple] = []

        def add(part: np.ndarray, path: int, depth: int) -> int:
            at = len(out)
            out.append(())
            low, high = part.min(axis=0), part.max(axis=0)
            split = np.flatnonzero(high > low)
            if depth >= most or not len(split):
                out[at] = (tree, at, path, None, None, None, None, depth + average_path(len(part)), len(x), len(part))
                return at
            j = int(split[int(_chance(seed, tree, path, "column") * len(split))])
            value = float(low[j] + _chance(seed, tree, path, "cut") * (high[j] - low[j]))
            below = part[:, j] <= value
            left, right = add(part[below], 2 * path, depth + 1), add(part[~below], 2 * path + 1, depth + 1)
            out[at] = (tree, at, path, columns[j], value, left, right, None, len(x), len(part))
            return at

        add(x, 1, 0)
        frame = pd.DataFrame(out, columns=[part.split()[0] for part in NODES.split(", ")])
        return frame.astype({"left": "Int32", "right": "Int32"})

    return cut(_drawn(df, columns, key, trees, sample, seed).groupBy("tree").applyInPandas(build, NODES))


def _length(tree: Column, x: Column, depth: int) -> Column:
    """Length of the leaf that a row falls to, by following ``left`` and ``right`` for ``depth`` steps."""

    def step(at: Column, _: Column) -> Column:
        j = tree["feature"][at]
        return F.when(j < 0, at).when(x[j] <= tree["cut"][at], tree["left"][at]).otherwise(tree["right"][at])

    return tree["length"][F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)]


def forest_scores(df: DataFrame, nodes: DataFrame, out: str = "score") -> DataFrame:
    """``df`` with ``out`` in 0 to 1, higher for rows that the forest's splits isolate sooner (Liu, Ting and Zhou 2008).

    The forest is one row of arrays that every row meets; its size is checked before it is broadcast, and no Python runs
    on the rows. Null and NaN count as 0. A forest without nodes scores null.
    """
    about = nodes.agg(F.count("*").alias("n"), F.collect_set("column_name").alias("names"), F.max(F.col("path")).alias("deepest"), F.max("drawn").alias("drawn")).first()
    if not about["n"]:
        return df.withColumn(out, F.lit(None).cast("double"))
    if about["n"] > MOST_NODES:
        raise ValueError(f"a forest has at most {MOST_NODES} nodes")
    names = sorted(about["names"])
    depth = max(1, int(about["deepest"]).bit_length() - 1)
    feature = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("column_name")) - 1, F.lit(-1)).cast("int") if names else F.lit(-1)
    fields = ("feature", "cut", "left", "right", "length")
    tree = F.sort_array(F.collect_list(F.struct("node", feature.alias("feature"), "cut", "left", "right", "length")))
    trees = nodes.groupBy("tree").agg(tree.alias("t")).select(F.struct(*[F.col(f"t.{f}").alias(f) for f in fields]).alias("t"))
    one = F.broadcast(trees.agg(F.collect_list("t").alias("forest_")))
    value = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0))
    met = df.withColumn("x_", F.array(*[value(c) for c in names]) if names else F.array().cast("array<double>")).crossJoin(one)
    total = F.aggregate("forest_", F.lit(0.0), lambda s, t: s + _length(t, F.col("x_"), depth))
    norm = average_path(max(2, about["drawn"])) or 1.0
    return met.withColumn(out, F.pow(F.lit(2.0), -total / F.size("forest_") / norm)).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)
