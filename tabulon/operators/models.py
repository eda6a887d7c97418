"""Models on tables: training, comparison, ensembles and explanations, all through ``pyspark.ml``."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import functions as MF
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.stats import correlation
from tabulon.functions.storage import cut, stored
from tabulon.operators import features as E
from tabulon.operators import metrics as V


def estimator(name: str, kind: str, **options):
    """An estimator by name for ``regression`` or ``classification``."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    known = {
        "regression": {"linear": R.LinearRegression, "tree": R.DecisionTreeRegressor, "forest": R.RandomForestRegressor, "boosted": R.GBTRegressor},
        "classification": {"linear": C.LogisticRegression, "tree": C.DecisionTreeClassifier, "forest": C.RandomForestClassifier, "boosted": C.GBTClassifier, "bayes": C.NaiveBayes, "svm": C.LinearSVC, "mlp": C.MultilayerPerceptronClassifier},
    }
    return known[kind][name](**options)


def fit(df: DataFrame, target: str, columns: list[str], name: str = "linear", kind: str = "regression", **options) -> PipelineModel:
    """A fitted pipeline: string columns are indexed (unseen values get their own number), then assembled, then learned."""
    kinds = dict(df.dtypes)
    texts = [c for c in columns if kinds[c] == "string"]
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__index", handleInvalid="keep") for c in texts]
    stages.append(VectorAssembler(inputCols=[f"{c}__index" if c in texts else c for c in columns], outputCol="features", handleInvalid="keep"))
    model = estimator(name, kind, **options)
    model.setLabelCol(target)
    return Pipeline(stages=[*stages, model]).fit(df.where(F.col(target).isNotNull()))


def fit_grouped(df: DataFrame, target: str, columns: list[str], name: str = "boosted", **options) -> PipelineModel:
    """:func:`fit` for trees by least squares, on one row for each combination of ``columns``: the mean of the target,
    weighted by its rows.

    Squared errors around a mean differ from those of the rows by a constant, so splits and leaves are the same as on all
    rows; only the thresholds to choose from come from all combinations, where Spark would draw rows. Forests are
    left to :func:`fit`, as their samples are of rows.
    """
    if name not in ("tree", "boosted"):
        raise ValueError(f"{name} is not a tree that whole groups of rows can fit")
    grouped = cut(df.where(F.col(target).isNotNull()).groupBy(*columns).agg(F.avg(target).alias(target), F.count("*").cast("double").alias("weight_")))
    return fit(grouped, target, columns, name, weightCol="weight_", **options)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction`` and, for classifiers, ``confidence``; indexing columns are dropped."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("confidence", F.array_max(MF.vector_to_array("probability")))
    return out.select(*df.columns, *[c for c in ("prediction", "confidence") if c in out.columns])


def candidates(n_rows: int, n_columns: int, kind: str) -> list[str]:
    """Names worth trying, by size."""
    names = ["linear", "tree"]
    if n_rows >= 500:
        names.append("forest")
    if n_rows >= 2000 and kind == "regression":
        names.append("boosted")
    if kind == "classification" and n_columns <= 50:
        names.append("svm")
    return names


def compare(df: DataFrame, target: str, columns: list[str], key: str, names: list[str], kind: str = "regression") -> DataFrame:
    """``model, test, rank``: R² or accuracy of each model on the rows that the hash of ``key`` holds out."""
    parts = stored(E.split(df, key, test=0.25), "parts")  # each model reads them several times
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    rows = []
    for name in names:
        out = score(fit(train, target, columns, name, kind), test)
        value = V.r_squared(out, target, "prediction") if kind == "regression" else V.classification(out.withColumn(target, F.col(target).cast("double")), target, "prediction").first()["accuracy"]
        rows.append((name, float(value or 0.0)))
    out = df.sparkSession.createDataFrame(rows, "model string, test double")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("test"), "model")))


def search(df: DataFrame, target: str, columns: list[str], grid: dict[str, list], name: str = "linear", kind: str = "regression", folds: int = 3, seed: int = 1) -> DataFrame:
    """``params, score, best`` of a grid by cross-validation (RMSE or log loss)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    made = estimator(name, kind)
    made.setLabelCol(target)
    builder = ParamGridBuilder()
    for p, values in grid.items():
        builder = builder.addGrid(made.getParam(p), values)
    maps = builder.build()
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(df).select("features", target)
    judge = RegressionEvaluator(labelCol=target) if kind == "regression" else MulticlassClassificationEvaluator(labelCol=target, metricName="logLoss")
    found = CrossValidator(estimator=made, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, seed=seed, parallelism=2).fit(data)
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(s)) for m, s in zip(maps, found.avgMetrics, strict=True)]
    best = min(s for _, s in rows)
    return df.sparkSession.createDataFrame([(p, s, s == best) for p, s in rows], "params string, score double, best boolean")


def vote(tables: dict[str, DataFrame], key: str, weights: dict[str, float] | None = None, kind: str = "regression") -> DataFrame:
    """``key, prediction`` from several prediction tables: weighted mean, or the class of largest weight (the smaller wins)."""
    rows = reduce(DataFrame.unionByName, [t.select(key, "prediction", F.lit(float((weights or {}).get(n, 1.0))).alias("w")) for n, t in sorted(tables.items())])
    if kind == "regression":
        return rows.groupBy(key).agg((F.sum(F.col("w") * F.col("prediction")) / F.sum("w")).alias("prediction"))
    by_class = rows.groupBy(key, "prediction").agg(F.sum("w").alias("w"))
    return by_class.groupBy(key).agg(F.max_by("prediction", F.struct("w", -F.col("prediction"))).alias("prediction"))


def stack(df: DataFrame, target: str, columns: list[str], key: str, names: list[str], folds: int = 3) -> DataFrame:
    """``key, prediction, target``: a ridge over out-of-fold predictions of the base models (regression).

    The ridge that scores a fold is fitted on the other folds, so no row is scored by a model that saw its target.
    """
    dealt = E.folds(df, key, folds).cache()
    outs = []
    for f in range(folds):
        train, rest = dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f)
        part = rest.select(key, target, *columns)
        for name in names:
            part = score(fit(train, target, columns, name), part).withColumnRenamed("prediction", f"p_{name}")
        outs.append(part.select(key, target, F.lit(f).alias("fold"), *[f"p_{n}" for n in names]))
    base = cut(reduce(DataFrame.unionByName, outs))
    meta = lambda f: fit(base.where(F.col("fold") != f), target, [f"p_{n}" for n in names], "linear", regParam=0.1, elasticNetParam=0.0)
    return reduce(DataFrame.unionByName, [score(meta(f), base.where(F.col("fold") == f)) for f in range(folds)]).select(key, target, "prediction")


def bag(df: DataFrame, target: str, columns: list[str], key: str, bags: int = 3, seed: int = 1) -> DataFrame:
    """``key, prediction``: the mean of trees fitted on bootstrap samples."""
    tables = {str(b): score(fit(df.sample(True, 1.0, seed + b), target, columns, "tree"), df) for b in range(bags)}
    return vote(tables, key)


def disagreement(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """``model_a, model_b, diversity``: 1 less the absolute correlation of two models' predictions."""
    names = sorted(tables)
    joined = reduce(lambda a, b: a.join(b, key), [tables[n].select(key, F.col("prediction").alias(f"p_{n}")) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = joined.agg(*[(1 - F.abs(correlation(f"p_{a}", f"p_{b}"))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"d{i}").alias("diversity")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def importance(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    """Columns with the trees' importance or the absolute coefficient, largest first."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else abs(last.coefficientMatrix.toArray()).mean(0)
    return sorted(zip(columns, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


def permutation_importance(model: PipelineModel, df: DataFrame, target: str, columns: list[str], key: str, seed: int = 1, repeats: int = 1) -> DataFrame:
    """``column_name, importance, spread``: the mean rise in RMSE when a column is dealt anew among the rows, and its deviation
    over ``repeats`` (null for one).

    Rows get one place each, by hash; a repeat gives every row the values of the one some places on, and all columns are
    judged by one scoring of as many variants of each row. No single task orders all rows.
    """
    import random

    from tabulon.operators.clean import positions

    placed = positions(df.withColumn("h_", F.xxhash64(key, F.lit(seed))), ["h_", key]).drop("h_")
    n, rng, parts = placed.count(), random.Random(seed), []
    for repeat in range(repeats):
        step = rng.randrange(1, n) if n > 1 else 0
        other = placed.select(F.pmod(F.col("position") - step, F.lit(n)).alias("position"), *[F.col(f"`{c}`").alias(f"new_{i}") for i, c in enumerate(columns)])
        variant = lambda name, i: F.struct(F.lit(name).alias("variant_"), *[F.col(f"new_{j}" if j == i else f"`{c}`").alias(c) for j, c in enumerate(columns)])
        every = F.array(variant(None, -1), *[variant(c, i) for i, c in enumerate(columns)])
        rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
        parts.append(placed.join(other, "position").select(*rest, F.explode(every).alias("v_"), F.lit(repeat).alias("repeat_")).select(*rest, "repeat_", "v_.*"))
    judged = V.regression(score(model, reduce(DataFrame.unionByName, parts)), target, "prediction", ["repeat_", "variant_"]).select("repeat_", "variant_", "rmse")
    base = judged.where("variant_ IS NULL").select("repeat_", F.col("rmse").alias("base_"))
    rise = judged.where("variant_ IS NOT NULL").join(F.broadcast(base), "repeat_").groupBy(F.col("variant_").alias("column_name"))
    return rise.agg(F.avg(F.col("rmse") - F.col("base_")).alias("importance"), F.stddev_samp(F.col("rmse") - F.col("base_")).alias("spread"))


def partial_dependence(model: PipelineModel, df: DataFrame, column: str, key: str, points: int = 10, share: float | None = None) -> DataFrame:
    """``value, prediction``: mean prediction of all rows (or a hash sample of ``share``) with ``column`` set to each point of a grid between its 5 % tails."""
    from tabulon.operators.clean import sample_by_key

    low, high = df.agg(F.percentile(column, F.array(F.lit(0.05), F.lit(0.95))).alias("q")).first()["q"]
    grid = [low + (high - low) * i / max(1, points - 1) for i in range(points)]
    some = (df if share is None else sample_by_key(df, key, share)).withColumn("value", F.explode(F.array(*[F.lit(float(g)) for g in grid]))).withColumn(column, F.col("value"))
    return model.transform(some).groupBy("value").agg(F.avg("prediction").alias("prediction"))


def contributions(df: DataFrame, key: str, coefficients: list[tuple[str, float]], top: int = 3) -> DataFrame:
    """``key, column_name, contribution, rank``: coefficient times value, the largest of each row."""
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.lit(float(w)) * F.col(c)).alias("contribution")) for c, w in coefficients])
    ordered = F.array_sort(parts, lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).when(a["column_name"] < b["column_name"], -1).otherwise(1))
    return df.select(key, F.posexplode(F.slice(ordered, 1, top)).alias("i", "p")).select(key, "p.*", (F.col("i") + 1).alias("rank"))


def what_if(model: PipelineModel, df: DataFrame, key: str, columns: list[str], least: float = 0.1, top: int = 3) -> DataFrame:
    """``key, column_name, factor, change``: changes by a tenth up or down that move the prediction most."""
    base = model.transform(df).select(key, *columns, F.col("prediction").alias("base_"))
    moves = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(f).alias("factor")) for c in columns for f in (0.9, 1.1)])
    varied = base.withColumn("move_", F.explode(moves))
    varied = varied.withColumns({c: F.when(F.col("move_.column_name") == c, F.col(c) * F.col("move_.factor")).otherwise(F.col(c).cast("double")) for c in columns})
    out = model.transform(varied).select(key, "move_.*", (F.col("prediction") - F.col("base_")).alias("change")).where(F.abs("change") > least)
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("change")), "column_name", "factor")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# --- saved models, jobs, validation ------------------------------------------------------------------------------


def save(model: PipelineModel, path: str) -> None:
    """A fitted pipeline, to be loaded with :func:`load`."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def probabilities(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """``key, class, probability`` for every class of a classifier."""
    listed = MF.vector_to_array("probability")
    return model.transform(df).select(key, F.posexplode(listed).alias("class", "probability"))


def scoring_job(spark, source: str, model_path: str, out: str, *, key: str) -> DataFrame:
    """Reads rows, scores them with a saved model, writes them, and returns one row ``rows, mean, std, nulls`` of what was written."""
    scored = score(load(model_path), spark.read.parquet(source))
    scored.write.mode("overwrite").parquet(out)
    p = F.col("prediction")
    return spark.read.parquet(out).agg(F.count(key).alias("rows"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"), F.count_if(p.isNull()).alias("nulls"))


def cross_validated(df: DataFrame, target: str, columns: list[str], key: str, names: list[str], kind: str = "regression", *, k: int = 3, repeats: int = 1, seed: int = 42) -> DataFrame:
    """``model, fold, score``: R² or accuracy of each model on each fold of each repetition. Folds go by the hash of
    ``key``: rows of one key (or group) stay together."""
    dealt = cut(E.repeated_folds(df.where(F.col(target).isNotNull()), key, k, repeats, seed=seed))
    rows = []
    for repeat in range(repeats):
        for fold in range(k):
            inside = F.col(f"fold_{repeat}") == fold
            train, test = dealt.where(~inside).select(*df.columns), dealt.where(inside).select(*df.columns)
            for name in names:
                judged = score(fit(train, target, columns, name, kind), test)
                value = V.fold_scores(judged.withColumn("f_", F.lit(0)).withColumn(target, F.col(target).cast("double")), "f_", target, "prediction", kind).first()
                rows.append((name, repeat * k + fold, float(value["score"]) if value and value["score"] is not None else None))
    return df.sparkSession.createDataFrame(rows, "model string, fold int, score double")


def random_search(df: DataFrame, target: str, columns: list[str], space: dict[str, tuple[float, float]], name: str = "linear", kind: str = "regression", *, tries: int = 5, folds: int = 3, seed: int = 1) -> DataFrame:
    """``params, score, best`` of ``tries`` settings drawn evenly from ranges, by cross-validation."""
    import random

    rng = random.Random(seed)
    drawn = {p: [round(rng.uniform(*limits), 6) for _ in range(tries)] for p, limits in sorted(space.items())}
    parts = [search(df, target, columns, {p: [values[t]] for p, values in drawn.items()}, name, kind, folds, seed).drop("best") for t in range(tries)]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("best", F.col("score") == F.min("score").over(Window.partitionBy()))
