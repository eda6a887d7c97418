"""Grouping and anomaly detection on numeric columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import functions as MF
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.stats import correlation, numeric_columns
from tabulon.functions.storage import cut
from tabulon.operators.clean import drop_constant_columns, drop_correlated_columns, fill_values
from tabulon.operators.decompose import fit_components, on_components
from tabulon.operators.features import scale

# --- preparation and grouping ------------------------------------------------------------------------------------


def prepare(df: DataFrame, key: str, columns: list[str] | None = None, method: str = "standard", most: int = 50) -> tuple[DataFrame, list[str]]:
    """Numeric columns filled with their means, without constant and correlated ones, scaled; and their names.

    More than ``most`` columns become as many principal components.
    """
    columns = columns or [c for c in numeric_columns(df) if c != key]
    rows = fill_values(df.select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]), dict.fromkeys(columns, "mean"))
    rows = drop_correlated_columns(drop_constant_columns(rows.select(*columns))).columns
    kept = [c for c in columns if c in rows]
    filled = fill_values(df.select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in kept]), dict.fromkeys(kept, "mean"))
    scaled = scale(filled, kept, method)
    if len(kept) <= most:
        return scaled, kept
    reduced = on_components(scaled, fit_components(scaled, kept, share=1.0, most=most))
    names = [c for c in reduced.columns if c.startswith("pc_") and c not in kept]
    return reduced.select(key, *names), names


def vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``features`` assembled from columns, or from one array column."""
    if len(columns) == 1 and dict(df.dtypes)[columns[0]].startswith("array"):
        return df.withColumn("features", MF.array_to_vector(F.col(columns[0]).cast("array<double>")))
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def assign(df: DataFrame, columns: list[str], k: int, method: str = "kmeans", seed: int = 1, starts: int = 1) -> DataFrame:
    """``df`` with ``cluster`` (and ``probability`` for mixtures): kmeans, bisecting or mixture of ``k`` groups.

    Of several ``starts`` the one with the least cost (the largest likelihood for mixtures) counts; each is a fit of its own.
    """
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans

    made = {"kmeans": KMeans, "bisecting": BisectingKMeans, "mixture": GaussianMixture}[method]
    rows = vectors(df, columns)
    cost = lambda m: -m.summary.logLikelihood if method == "mixture" else m.summary.trainingCost
    fitted = [made(k=k, seed=seed + i, predictionCol="cluster").fit(rows) for i in range(starts)]
    out = (fitted[0] if starts == 1 else min(fitted, key=cost)).transform(rows)
    if method == "mixture":
        out = out.withColumn("probability", F.array_max(MF.vector_to_array("probability")))
    return out.drop("features")


def density_groups(df: DataFrame, key: str, columns: list[str], eps: float, least: int = 5) -> DataFrame:
    """``key, cluster`` by density (DBSCAN); noise is -1, a cluster is its smallest core key.

    Up to three columns go through :func:`tabulon.operators.density.grid_groups`, which is exact; more columns, or one array column,
    through :func:`tabulon.operators.density.density_groups`.
    """
    from tabulon.operators import density

    if len(columns) > 3 or dict(df.dtypes)[columns[0]].startswith("array"):
        return density.density_groups(df, key, columns, eps, least)
    return density.grid_groups(df, key, columns, eps, least)


def quality(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """One row ``clusters, calinski_harabasz, davies_bouldin, balance`` from grouped sums."""
    d = len(columns)
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    sums = df.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[(F.var_pop(v) * F.count(v)).alias(f"w{i}") for i, v in enumerate(x)])
    total = df.where(F.col(cluster) >= 0).agg(*[F.avg(v).alias(f"g{i}") for i, v in enumerate(x)])
    means = df.join(sums, cluster)
    spread = means.groupBy(cluster).agg(F.avg(F.sqrt(sum(((v - F.col(f"m{i}")) * (v - F.col(f"m{i}")) for i, v in enumerate(x)), F.lit(0.0)))).alias("s"))
    full = sums.crossJoin(F.broadcast(total)).join(spread, cluster)
    between = sum(((F.col(f"m{i}") - F.col(f"g{i}")) * (F.col(f"m{i}") - F.col(f"g{i}")) for i in range(d)), F.lit(0.0)) * F.col("n")
    within = sum((F.col(f"w{i}") for i in range(d)), F.lit(0.0))
    ch = full.agg(F.count("*").alias("clusters"), F.sum(between).alias("b"), F.sum(within).alias("w"), F.sum("n").alias("all"), (F.min("n") / F.max("n")).alias("balance"))
    a, b = full.select(F.col(cluster).alias("ca"), F.col("s").alias("sa"), *[F.col(f"m{i}").alias(f"a{i}") for i in range(d)]), full.select(F.col(cluster).alias("cb"), F.col("s").alias("sb"), *[F.col(f"m{i}").alias(f"b{i}") for i in range(d)])
    gap = F.sqrt(sum(((F.col(f"a{i}") - F.col(f"b{i}")) * (F.col(f"a{i}") - F.col(f"b{i}")) for i in range(d)), F.lit(0.0)))
    # pairs of clusters, a few dozen rows
    db = a.join(F.broadcast(b), F.col("ca") != F.col("cb")).groupBy("ca").agg(F.max((F.col("sa") + F.col("sb")) / gap).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    score = F.try_divide(F.col("b") / (F.col("clusters") - 1), F.col("w") / (F.col("all") - F.col("clusters")))
    return ch.crossJoin(F.broadcast(db)).select("clusters", score.alias("calinski_harabasz"), "davies_bouldin", "balance")


def silhouette(df: DataFrame, columns: list[str], cluster: str = "cluster") -> float:
    """Mean silhouette with squared Euclidean distance."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(predictionCol=cluster).evaluate(vectors(df, columns))


def choose_k(df: DataFrame, columns: list[str], ks: range = range(2, 7), seed: int = 1) -> DataFrame:
    """``k, cost, silhouette, elbow`` for each number of groups; the elbow has the largest second difference of cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    held = vectors(df, columns).select("features").cache()
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(held)
        rows.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(held)))))
    held.unpersist()
    bend = {rows[i][0]: rows[i - 1][1] - 2 * rows[i][1] + rows[i + 1][1] for i in range(1, len(rows) - 1)}
    best = max(bend, key=bend.get) if bend else rows[0][0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "k int, cost double, silhouette double, elbow boolean")


def agreed_k(choice: DataFrame, gaps: DataFrame | None = None) -> int:
    """The number of groups that most of elbow, silhouette and gap choose (see :func:`choose_k`, :func:`gap_statistic`); the middle
    one if each says something else, the lower of two."""
    rows = choice.collect()  # a row for each number of groups
    votes = [next(r["k"] for r in rows if r["elbow"]), max(rows, key=lambda r: (r["silhouette"], -r["k"]))["k"]]
    if gaps is not None:
        votes.append(gaps.orderBy(F.desc("gap"), "k").first()["k"])
    most = max(votes, key=lambda k: (votes.count(k), -k))
    return most if votes.count(most) > 1 else sorted(votes)[(len(votes) - 1) // 2]


def gap_statistic(df: DataFrame, columns: list[str], ks: range = range(1, 6), *, references: int = 2, seed: int = 1) -> DataFrame:
    """``k, gap, spread, best``: log cost of k-means on evenly spread rows in the columns' ranges less that on ``df``; the best
    is the least k whose gap is not a standard error below the next one's."""
    from pyspark.ml.clustering import KMeans

    limits = df.agg(*[e for i, c in enumerate(columns) for e in (F.min(f"`{c}`").cast("double").alias(f"lo{i}"), F.max(f"`{c}`").cast("double").alias(f"hi{i}"))])
    spread_out = lambda s: df.select().crossJoin(F.broadcast(limits)).select(*[(F.col(f"lo{i}") + F.rand(seed * 1000 + s * 100 + i) * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias(c) for i, c in enumerate(columns)])
    tables = [cut(vectors(t, columns).select("features")) for t in (df, *(spread_out(s) for s in range(references)))]
    rows = []
    for k in ks:
        logs = [math.log(max(KMeans(k=k, seed=seed).fit(t).summary.trainingCost, 1e-300)) if k > 1 else _log_cost(t) for t in tables]
        mean = sum(logs[1:]) / references
        rows.append((k, mean - logs[0], math.sqrt(sum((x - mean) ** 2 for x in logs[1:]) / references * (1 + 1 / references))))
    best = next((a[0] for a, b in zip(rows, rows[1:], strict=False) if a[1] >= b[1] - b[2]), rows[-1][0])
    return df.sparkSession.createDataFrame([(*x, x[0] == best) for x in rows], "k int, gap double, spread double, best boolean")


def _log_cost(t: DataFrame) -> float:
    """Log of the squared distances from the mean, the cost of one group."""
    x = MF.vector_to_array("features")
    width = t.select(F.size(x).alias("n")).first()["n"]
    row = t.select(x.alias("x")).agg(F.sum(F.lit(1.0)).alias("n"), *[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(width)]).first()
    return math.log(max(row["n"] * sum(row[f"v{i}"] for i in range(width)), 1e-300))


def graph_groups(edges: DataFrame, k: int, *, rounds: int = 10) -> DataFrame:
    """``id, cluster`` of a graph of similarities (a, b, similarity; integer ids) by power iteration on its normalised matrix."""
    from pyspark.ml.clustering import PowerIterationClustering

    rows = edges.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.col("similarity").cast("double").alias("weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return PowerIterationClustering(k=k, maxIter=rounds, initMode="degree", weightCol="weight").assignClusters(rows)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``adjusted_rand, mutual_information`` (normalised by the mean of the entropies) of two labelings."""
    table = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    w = Window.partitionBy
    t = table.withColumns({"na": F.sum("n").over(w("a")), "nb": F.sum("n").over(w("b")), "t": F.sum("n").over(w())})
    two = lambda n: n * (n - 1) / 2
    cells = t.agg(F.sum(two(F.col("n"))).alias("s"), F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), F.first("t").alias("t"))
    side = lambda c: table.groupBy(c).agg(F.sum("n").alias("n")).withColumn("t", F.sum("n").over(w())).agg(F.sum(two(F.col("n"))).alias(f"s{c}"), F.sum(-F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t"))).alias(f"h{c}"))
    row = cells.crossJoin(F.broadcast(side("a"))).crossJoin(F.broadcast(side("b")))
    expected = F.col("sa") * F.col("sb") / two(F.col("t"))
    return row.select(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("adjusted_rand"), F.coalesce(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")), F.lit(1.0)).alias("mutual_information"))


def projected(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """``df`` with ``projection``, the first principal components."""
    from pyspark.ml.feature import PCA

    v = vectors(df, columns)
    return PCA(k=k, inputCol="features", outputCol="p").fit(v).transform(v).withColumn("projection", MF.vector_to_array("p")).drop("features", "p")


def reconstruction_error(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """``df`` with ``error``: the squared rest after projecting to ``k`` components and back."""
    from pyspark.ml.feature import PCA, StandardScaler

    v = StandardScaler(withMean=True, inputCol="features", outputCol="z").fit(vectors(df, columns)).transform(vectors(df, columns))
    out = PCA(k=k, inputCol="z", outputCol="p").fit(v).transform(v)
    square = lambda c: F.aggregate(MF.vector_to_array(c), F.lit(0.0), lambda s, x: s + x * x)
    return out.withColumn("error", F.greatest(square("z") - square("p"), F.lit(0.0))).drop("features", "z", "p")


# --- anomalies ---------------------------------------------------------------------------------------------------


def contamination(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``contamination``: the share of rows outside any column's fences, between 0.01 and 0.5."""
    from tabulon.operators.clean import outlier_flags

    share = F.avg(F.col("outlier_any").cast("double"))
    return outlier_flags(df.select(*columns), columns).agg(F.greatest(F.lit(0.01), F.least(F.lit(0.5), share)).alias("contamination"))


def mahalanobis(df: DataFrame, columns: list[str], out: str = "distance") -> DataFrame:
    """``df`` with the squared Gaussian distance of each row: one aggregate for mean and covariance, a small inverse."""
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    d = len(columns)
    row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    inverse = np.linalg.pinv(cov)
    centred = [v - F.lit(row[f"m{i}"]) for i, v in enumerate(x)]
    return df.withColumn(out, sum((F.lit(float(inverse[i, j])) * centred[i] * centred[j] for i in range(d) for j in range(d)), F.lit(0.0)))


def isolation_scores(df: DataFrame, columns: list[str], *, trees: int = 50, sample: int = 256, seed: int = 7, key: str | None = None) -> DataFrame:
    """``df`` with ``score`` in 0 to 1, higher for rows that random splits isolate sooner (Liu, Ting and Zhou 2008).

    Each tree grows on the ``sample`` rows whose hashes of ``key`` (without one, of the row's place) and tree are lowest, cut
    before any group reaches its task; the small trees are broadcast and the rows are scored in Arrow batches.
    """
    place = F.xxhash64(F.col(key) if key else F.monotonically_increasing_id())
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns], place.alias("place")).na.drop()
    total = numbers.count()
    limit = -(2**63) + min(2**64 - 1, 2**64 * 2 * sample // max(1, total))  # of about twice as many rows as needed
    drawn = numbers.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", F.xxhash64("place", "tree", F.lit(seed))).where(F.col("h") <= F.lit(limit))
    drawn = drawn.withColumn("i_", F.row_number().over(Window.partitionBy("tree").orderBy("h"))).where(F.col("i_") <= sample)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("h")[columns].to_numpy()
        rng = np.random.default_rng(seed + int(pdf["tree"].iloc[0]))
        most = math.ceil(math.log2(max(2, len(x))))
        rows: list[tuple] = []

        def add(part, depth: int) -> int:
            at = len(rows)
            rows.append(None)
            spread = part.max(0) - part.min(0) if len(part) > 1 else np.zeros(x.shape[1])
            if depth >= most or not (spread > 0).any():
                n = len(part)
                rest = 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
                rows[at] = (at, -1, 0.0, at, at, depth + rest)
                return at
            j = int(rng.choice(np.flatnonzero(spread > 0)))
            at_value = float(rng.uniform(part[:, j].min(), part[:, j].max()))
            low = part[:, j] <= at_value
            left, right = add(part[low], depth + 1), add(part[~low], depth + 1)
            rows[at] = (at, j, at_value, left, right, 0.0)
            return at

        add(x, 0)
        return pd.DataFrame([(int(pdf["tree"].iloc[0]), len(x), *r) for r in rows], columns=["tree", "size", "node", "feature", "cut", "left", "right", "length"])

    grown = drawn.groupBy("tree").applyInPandas(build, "tree int, size int, node int, feature int, cut double, left int, right int, length double").toPandas()  # at most 2 * sample nodes a tree
    forest = [(g["feature"].to_numpy(), g["cut"].to_numpy(), g["left"].to_numpy(), g["right"].to_numpy(), g["length"].to_numpy()) for _, g in grown.sort_values(["tree", "node"]).groupby("tree")]
    size = float(grown["size"].max()) if len(grown) else 2.0
    norm = 2 * (math.log(max(size - 1, 1)) + 0.5772156649) - 2 * (size - 1) / size
    held = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(rows: pd.DataFrame) -> pd.Series:
        x = rows.to_numpy(float)
        total = np.zeros(len(x))
        for feature, cut_at, left, right, length in held.value:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                below = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut_at[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
            total += length[at]
        return pd.Series(2.0 ** (-total / max(1, len(held.value)) / norm))

    return df.withColumn("score", score(F.struct(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])))


def local_outlier_factor(df: DataFrame, key: str, columns: list[str], k: int = 10) -> DataFrame:
    """``key, lof`` from the exact ``k`` nearest neighbours, ties by key; 1 is ordinary, null only for a single row.

    Equal rows are one class, as their factors are equal. The smallest cell, of halved sides, that holds over ``k`` rows
    bounds a class's reach; all within that reach lie in the neighbouring cells of a grid at least as wide.
    """
    from itertools import product

    levels = 40
    v = vectors(df, columns).select(F.col(key).alias("k"), MF.vector_to_array("features").alias("x"))
    classes = cut(v.groupBy("x").agg(F.min("k").alias("c"), F.count("*").alias("m")))
    edges = classes.select(F.posexplode("x").alias("i", "value")).groupBy("i").agg(F.min("value").alias("low"), F.max("value").alias("high")).orderBy("i").collect()
    if not edges:
        return v.select(F.col("k").alias(key), F.lit(None).cast("double").alias("lof"))
    d, wide = len(edges), max(r["high"] - r["low"] for r in edges) * 1.000001 or 1.0
    up = math.ceil(math.log2(math.sqrt(d)))
    at = lambda i, level: F.floor((F.col("x")[i] - edges[i]["low"]) / (wide / F.pow(F.lit(2.0), level)))
    cells = classes.select("c", "m", F.col("x"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    cells = cells.select("c", "m", "level", F.array(*[at(i, F.col("level")) for i in range(d)]).alias("cell"))
    full = cells.groupBy("level", "cell").agg(F.sum("m").alias("n")).where(F.col("n") > k).select("level", "cell")
    depth = cells.join(full, ["level", "cell"]).groupBy("c").agg(F.max("level").alias("level"))
    asking = cut(classes.join(depth, "c", "left").withColumn("level", F.coalesce("level", F.lit(0)) - up))
    used = [r["level"] for r in asking.select("level").distinct().collect()]  # at most 41
    grid = range(min(d, 3))
    moves = F.array(*[F.array(*[at(i, F.col("level")) + step for i, step in zip(grid, move)]) for move in product((-1, 0, 1), repeat=len(grid))])
    left = asking.select(F.col("c").alias("a"), F.col("x").alias("xa"), "level", F.explode(moves).alias("cell"))
    right = classes.select(F.col("c").alias("b"), "x", F.explode(F.array(*[F.lit(n) for n in used])).alias("level"))
    right = right.select("b", F.col("x").alias("xb"), "level", F.array(*[at(i, F.col("level")) for i in grid]).alias("cell"))
    squared = sum(((F.col("xa")[i] - F.col("xb")[i]) * (F.col("xa")[i] - F.col("xb")[i]) for i in range(d)), F.lit(0.0))
    met = left.join(right, ["level", "cell"]).where("a <> b").select("a", "b", F.sqrt(squared).alias("d"))
    # each of the k nearest classes gives its smallest key at least, so a farther one gives no neighbour
    first = met.withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("i") <= k).drop("i")
    rows = v.withColumn("i", F.row_number().over(Window.partitionBy("x").orderBy("k"))).where(F.col("i") <= k).join(classes.select("x", F.col("c").alias("b")), "x").select("b", "k")
    own = classes.where("m > 1").select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(0.0).alias("d"), F.explode(F.sequence(F.lit(1), F.least(F.col("m") - 1, F.lit(k)).cast("int"))).alias("k"))
    every = first.join(rows, "b").select("a", "b", "d", "k").unionByName(own.withColumn("k", F.col("b")))
    near = cut(every.withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy("d", "k"))).where(F.col("i") <= k))
    reach = near.groupBy("a").agg(F.max("d").alias("kd"))
    density = near.join(reach.select(F.col("a").alias("b"), F.col("kd").alias("kb")), "b").groupBy("a").agg((1 / F.avg(F.greatest("d", "kb", F.lit(1e-9)))).alias("lrd"))
    ratio = near.join(density.select(F.col("a").alias("b"), F.col("lrd").alias("lb")), "b").groupBy("a").agg(F.avg("lb").alias("mb")).join(density, "a")
    scored = classes.join(ratio, classes["c"] == ratio["a"], "left").select("x", (F.col("mb") / F.col("lrd")).alias("lof"))
    return v.join(scored, "x").select(F.col("k").alias(key), "lof")


def flag(df: DataFrame, score: str, share: float) -> DataFrame:
    """``df`` with ``anomaly``: the ``share`` of highest scores, by an exact percentile."""
    limit = F.broadcast(df.agg(F.percentile(score, F.lit(1 - share)).alias("limit_")))
    return df.crossJoin(limit).withColumn("anomaly", F.col(score) > F.col("limit_")).drop("limit_")


def anomaly_metrics(df: DataFrame, score: str, anomaly: str = "anomaly") -> DataFrame:
    """One row: counts, mean scores of both kinds, their distance, and the 90th, 95th and 99th percentiles."""
    is_ = F.col(anomaly)
    a = df.agg(F.count_if(is_).alias("anomalies"), F.count("*").alias("n"), F.avg(F.when(is_, F.col(score))).alias("mean_anomaly"), F.avg(F.when(~is_, F.col(score))).alias("mean_normal"), F.percentile(score, F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99))).alias("p"))
    return a.select("anomalies", "n", "mean_anomaly", "mean_normal", (F.col("mean_anomaly") - F.col("mean_normal")).alias("separation"), F.col("p")[0].alias("p90"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"))


def top_anomalies(df: DataFrame, key: str, score: str, k: int = 10) -> DataFrame:
    """The ``k`` most anomalous rows; ties go to the smaller key."""
    return df.orderBy(F.desc(score), key).limit(k)


def anomaly_importance(df: DataFrame, columns: list[str], anomaly: str = "anomaly") -> DataFrame:
    """``column_name, importance``: absolute correlation of each column with the flag."""
    from tabulon.functions.stats import spread_rows

    y = F.col(anomaly).cast("double")
    row = df.agg(*[F.abs(correlation(F.col(f"`{c}`").cast("double"), y)).alias(f"r{i}") for i, c in enumerate(columns)])
    return spread_rows(row, {c: [("importance", F.coalesce(F.col(f"r{i}"), F.lit(0.0)))] for i, c in enumerate(columns)})


def detector_choice(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``detector, gaussian, n``: by size, width and whether every column looks Gaussian."""
    looks = F.lit(True)
    for c in columns:
        looks = looks & (F.abs(F.skewness(c)) < 1) & (F.abs(F.kurtosis(c)) < 3)
    row = df.agg(F.count("*").alias("n"), looks.alias("gaussian"))
    return row.select(F.when(F.col("gaussian") & F.lit(len(columns) <= 20), "elliptic_envelope").when(F.col("n") > 10_000, "isolation_forest").otherwise("local_outlier_factor").alias("detector"), "gaussian", "n")
