"""Entry points that compose operators into whole jobs; each returns DataFrames and leaves the writing to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.stats import datetime_columns, numeric_columns, string_columns
from tabulon.functions.storage import stored
from tabulon.operators import clean, drift, features, groups, insights, metrics, models, profile, quality, recs, series, text
from tabulon.sources import files


def load(spark: SparkSession, path: str, *, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A file as a table, and its quality report."""
    df = files.read_any(spark, path, schema=schema)
    return df, quality.quality_report(df)


def process(spark: SparkSession, path: str, out: str, *, schema: str | None = None) -> dict[str, DataFrame]:
    """The batch cleaning job: read, clean, write to ``out``, and report before and after, with what is left to do."""
    raw = files.read_any(spark, path, schema=schema)
    before = quality.table_facts(raw)
    cleaned, log = clean.preprocess(raw)
    files.write(cleaned, out)
    after = spark.read.parquet(out)
    steps = spark.createDataFrame([(i, s) for i, s in enumerate(log)], "step int, what string")
    return {"data": after, "before": before, "after": quality.table_facts(after), "log": steps, "left": quality.final_check(after)}


def validate(df: DataFrame, *, required: list[str] | None = None, expected: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Issue records and the validation score of a table."""
    return {"issues": quality.issues(df, required=required, expected=expected), "score": quality.validation_score(df)}


def prepare(df: DataFrame, target: str | None = None, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """A table made ready for models: sparse and constant columns go, gaps are filled, times become parts, texts become
    numbers (target means where there is a target), numbers are scaled. Keys stay as they are."""
    keep = (*keys, target) if target else keys
    out = clean.drop_constant_columns(clean.drop_sparse_columns(clean.drop_incomplete_rows(df, [target]) if target else df, 0.5, keep=keep))
    out = clean.fill_values(out)
    for c in [c for c in datetime_columns(out) if c not in keep]:
        out = features.datetime_features(out, c).drop(c)
    for c in [c for c in string_columns(out) if c not in keep]:
        if target and target in numeric_columns(out):
            out = features.target_encode(out, c, target, f"{c}_mean").drop(c)
        else:
            out = features.label_encode(out, c, f"{c}_index").drop(c)
    return features.scale(out, [c for c in numeric_columns(out) if c not in keep])


def quick_drift(reference: DataFrame, current: DataFrame, categories: list[str] | None = None) -> dict[str, DataFrame]:
    """Drift by feature, and advice."""
    found = drift.table_drift(reference, current, None, categories)
    return {"features": found, "advice": drift.drift_advice(found)}


def model_health(reference: DataFrame, current: DataFrame, limit: float = 0.1) -> DataFrame:
    """One row ``status, n_failing`` from drift and data quality."""
    data = drift.table_drift(reference, current).agg(F.max("table_score").alias("s")).select(F.lit("data_drift").alias("check"), drift.health(F.col("s"), limit).alias("status"))
    score = quality.scores(current).select(F.lit("quality").alias("check"), F.when(F.col("monitoring_score") >= 0.9, "healthy").when(F.col("monitoring_score") >= 0.7, "warning").otherwise("critical").alias("status"))
    return drift.combined_status(data.unionByName(score))


def analyse_series(df: DataFrame, horizon: int = 30) -> dict[str, DataFrame]:
    """Everything about many series (series, ts, y): summary, frequency, trend, season, stationarity, forecast."""
    rows = series.clean(df)
    return {"checks": series.checks(df), "frequency": series.frequency(rows), "summary": series.summary(rows), "trend": series.trend(rows), "seasonality": series.seasonality(rows), "stationarity": series.stationarity(rows), "models": series.backtest(rows, folds=2, horizon=7), "forecast": series.forecast(rows, horizon)}


def recommend(ratings: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """Recommendations for all users from (user, item, rating), with statistics and the choice of algorithm."""
    similar = recs.similarity(ratings)
    top = recs.with_fallback(recs.top_n(recs.predict_items(ratings, similar), ratings, n), ratings, ratings, n)
    return {"recommendations": top, "similar_items": similar, "popular": recs.popular(ratings), "statistics": recs.statistics(ratings), "choice": recs.algorithm_choice(ratings)}


def analyse_texts(df: DataFrame) -> dict[str, DataFrame]:
    """Features, readability, style, language, quality and corpus statistics of (doc_id, text)."""
    return {"features": text.basic_features(df), "readability": text.readability(df), "style": text.stylometry(df), "language": text.language(df), "quality": text.text_quality(df), "issues": text.quality_issues(df), "corpus": text.corpus_statistics(df), "top_words": text.top_words(df)}


def cluster(df: DataFrame, key: str, k: int | None = None) -> dict[str, DataFrame]:
    """Groups of rows, their quality, and the figures behind the number of groups (that most criteria agree on)."""
    rows, columns = groups.prepare(df, key)
    choice = groups.choose_k(rows, columns)
    k = k or groups.agreed_k(choice)
    found = groups.assign(rows, columns, k)
    return {"groups": found, "choice": choice, "quality": groups.quality(found, columns)}


def anomalies(df: DataFrame, key: str, share: float | None = None) -> dict[str, DataFrame]:
    """Scores and flags of rows, the most anomalous ones, and the columns that matter."""
    rows, columns = groups.prepare(df, key, method="robust")
    share = share if share is not None else groups.contamination(rows, columns).first()["contamination"]
    found = groups.flag(groups.isolation_scores(rows, columns, key=key), "score", share)
    return {"rows": found, "top": groups.top_anomalies(found, key, "score"), "metrics": groups.anomaly_metrics(found, "score"), "importance": groups.anomaly_importance(found, columns)}


def tabular(df: DataFrame, target: str, columns: list[str], key: str) -> dict[str, DataFrame]:
    """Models compared on held-out rows, predictions of the best, its baseline and explanations."""
    kind = profile.task_type(df, target, "small").first()["task"]
    names = models.candidates(df.count(), len(columns), kind)
    ranked = models.compare(df, target, columns, key, names, kind)
    best = ranked.where("rank = 1").first()["model"]
    model = models.fit(df, target, columns, best, kind)
    scored = models.score(model, df)
    spark = df.sparkSession
    weights = spark.createDataFrame(models.importance(model, columns), "feature string, importance double")
    return {"models": ranked, "predictions": scored, "baseline": metrics.baseline(scored, target, "prediction", kind), "importance": weights, "insights": insights.importance_insights(weights)}


def engineer(df: DataFrame, target: str, *, share: float = 0.8, most: int = 50) -> dict[str, DataFrame]:
    """Features made ready and selected: the chosen columns with the target, what was measured of each, and metrics of the result."""
    made = prepare(df, target)
    columns = [c for c in numeric_columns(made) if c != target]
    numeric = target in numeric_columns(made)
    scores = features.f_regression(made, columns, target) if numeric else features.f_scores(made, columns, target)
    chosen = features.select_best(scores, "f", share, most)
    data = made.select(*chosen, target)
    return {"data": data, "scores": scores, "metrics": features.transformed_metrics(data.drop(target))}


def train(df: DataFrame, target: str, columns: list[str], key: str, name: str = "linear", *, path: str | None = None) -> dict[str, DataFrame]:
    """One model fitted on three quarters of the rows: predictions and metrics of the rest; saved where a path is given."""
    kind = profile.task_type(df, target, "small").first()["task"]
    parts = features.split(df, key, test=0.25)
    model = models.fit(parts.where("part = 'train'"), target, columns, name, kind)
    if path:
        models.save(model, path)
    scored = models.score(model, parts.where("part = 'test'").drop("part"))
    return {"predictions": scored, **evaluate(scored, target, kind=kind)}


def evaluate(scored: DataFrame, target: str, prediction: str = "prediction", kind: str = "regression") -> dict[str, DataFrame]:
    """Metrics, baseline and error structure of predictions."""
    if kind == "regression":
        return {"metrics": metrics.regression(scored, target, prediction), "baseline": metrics.baseline(scored, target, prediction, kind), "residuals": metrics.residuals(scored, target, prediction)}
    rows = scored.withColumn(target, F.col(target).cast("double"))
    return {"metrics": metrics.classification(rows, target, prediction), "baseline": metrics.baseline(rows, target, prediction, kind), "classes": metrics.class_report(rows, target, prediction), "confusion": metrics.confusion(rows, target, prediction)}


def explain(model, df: DataFrame, target: str, columns: list[str], key: str) -> dict[str, DataFrame]:
    """What a regression model rests on: its own importances, permutation importance, dependence on the first column, insights."""
    spark = df.sparkSession
    weights = models.importance(model, columns)
    own = spark.createDataFrame(weights, "feature string, importance double")
    return {"importance": own, "permutation": models.permutation_importance(model, df, target, columns, key), "dependence": models.partial_dependence(model, df, weights[0][0], key), "insights": insights.importance_insights(own)}


def ensemble(df: DataFrame, target: str, columns: list[str], key: str, names: list[str]) -> dict[str, DataFrame]:
    """Models fitted on three quarters of the rows vote on the rest: the vote, its metrics, each model's, and their diversity."""
    parts = stored(features.split(df, key, test=0.25), "parts")  # each model reads them several times
    test = parts.where("part = 'test'").drop("part")
    tables = {n: models.score(models.fit(parts.where("part = 'train'"), target, columns, n), test) for n in names}
    voted = models.vote(tables, key).join(test.select(key, target), key)
    of = lambda t, n: metrics.regression(t, target, "prediction").withColumn("model", F.lit(n))
    ranked = of(voted, "vote")
    for n, t in tables.items():
        ranked = ranked.unionByName(of(t, n))
    return {"predictions": voted, "metrics": ranked, "diversity": models.disagreement(tables, key)}


def automl(df: DataFrame, target: str, key: str) -> dict[str, DataFrame]:
    """From a raw table to ranked models: preparation, selection of features, comparison, the best model and its insights."""
    made = prepare(df, target, keys=(key,))
    columns = [c for c in numeric_columns(made) if c not in (target, key)]
    scores = features.f_regression(made, columns, target) if target in numeric_columns(made) else features.f_scores(made, columns, target)
    chosen = features.select_best(scores, "f")
    return {"scores": scores, **tabular(made, target, chosen, key)}


def report(df: DataFrame) -> dict[str, DataFrame]:
    """What a table says by itself: insights on its facts, their confidence, and the few that matter most."""
    found = insights.data_insights(quality.table_facts(df))
    return {"insights": found, "confidence": insights.confidence(found), "summary": insights.summary(found), "recommendations": quality.recommendations(df)}


def analyse(df: DataFrame, *, target: str | None = None, key: str | None = None) -> dict[str, DataFrame]:
    """What suits a table best, with its profile, quality, insights and recommendations."""
    facts = quality.table_facts(df)
    out = {"kinds": profile.dataset_kind_scores(df, target=target), "profile": profile.column_profile(df), "quality": quality.scores(df), "insights": insights.data_insights(facts), "recommendations": quality.recommendations(df)}
    if target:
        out["task"] = profile.task_type(df, target)
    if key and len([c for c in numeric_columns(df) if c != key]) >= 2:
        out |= {f"groups_{n}": t for n, t in cluster(df, key).items()}
    return out
