"""Insights: rule tables over result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.rules import Rule, apply_rules, banded

#: Levels of metrics where higher is better.
METRIC_BANDS = [(0.9, "excellent"), (0.8, "good"), (0.7, "fair")]

DATA_RULES = [
    Rule("much_missing", "missing_ratio", ">", 0.3, "Much of the data is missing", "critical", "missing"),
    Rule("some_missing", "missing_ratio", ">", 0.1, "Some of the data is missing", "warning", "missing"),
    Rule("few_rows", "n_rows", "<", 1000, "Few rows: results may not hold", "warning"),
    Rule("wide_table", "columns_per_row", ">", 1.0, "More columns than rows", "critical"),
    Rule("duplicates", "duplicate_ratio", ">", 0.1, "Many rows are repeated", "warning"),
]
TRADE_RULES = [
    Rule("precise", "precision_less_recall", ">", 0.1, "Precision is bought with missed cases", "info", "balance"),
    Rule("sensitive", "precision_less_recall", "<", -0.1, "Recall is bought with false alarms", "info", "balance"),
    Rule("imbalanced", "imbalance_ratio", ">", 5.0, "Classes are of very different size", "warning"),
]
IMPORTANCE_RULES = [
    Rule("one_feature_dominates", "top_share", ">", 0.5, "One feature carries over half the model", "warning", "share"),
    Rule("balanced_features", "top3_share", "<", 0.6, "No few features dominate", "info", "share"),
    Rule("idle_features", "n_tiny", ">", 5, "Several features hardly matter", "info"),
]


def metric_levels(metrics: DataFrame, inverse: tuple[str, ...] = ("rmse", "mae", "mape", "log_loss")) -> DataFrame:
    """``name, value, level`` of metrics (name, value): excellent, good, fair or poor; errors count as 1 less the value."""
    value = F.when(F.col("name").isin(*inverse), 1 - F.col("value")).otherwise(F.col("value"))
    return metrics.select("name", "value", banded(value, METRIC_BANDS, "poor").alias("level"), F.format_string("%s is %.3f", "name", F.col("value").cast("double")).alias("text"))


def data_insights(facts: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Insights about a table from its facts (see ``quality.table_facts``)."""
    return apply_rules(facts.withColumn("columns_per_row", F.try_divide("n_columns", "n_rows")), rules or DATA_RULES)


def importance_insights(importances: DataFrame) -> DataFrame:
    """Insights about the spread of importances (feature, importance)."""
    from pyspark.sql import Window

    share = F.try_divide("importance", F.sum("importance").over(Window.partitionBy()))
    ranked = importances.select(share.alias("s")).withColumn("i", F.row_number().over(Window.orderBy(F.desc("s"))))
    return apply_rules(ranked.agg(F.max("s").alias("top_share"), F.sum(F.when(F.col("i") <= 3, F.col("s"))).alias("top3_share"), F.count_if(F.col("s") < 0.01).alias("n_tiny")), IMPORTANCE_RULES)


def trade_offs(metrics: DataFrame) -> DataFrame:
    """Insights about precision, recall and class sizes from one row of metrics."""
    return apply_rules(metrics.withColumn("precision_less_recall", F.col("precision") - F.col("recall")), TRADE_RULES)


def deployment(score_row: DataFrame, *, saving: float, volume: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``score, risk, readiness, expected_saving`` of a model by its score, behind the columns ``keys``."""
    s = F.col("score")
    return score_row.select(*keys, "score", banded(s, [(0.9, "low"), (0.75, "medium")], "high").alias("risk"), banded(s, [(0.9, "ready"), (0.75, "pilot")], "not_ready").alias("readiness"), (s * saving * volume).alias("expected_saving"))


#: Bands of the mean score for deployment: lower limit, readiness, impact, text.
READINESS = [(0.8, "Ready", "High", "Model meets performance criteria for deployment"), (0.6, "Needs Review", "Medium", "Model performance is acceptable but should be reviewed"), (-1e300, "Not Ready", "High", "Model performance is below deployment threshold")]


def readiness(metrics: DataFrame) -> DataFrame:
    """One row ``score, readiness, impact, description, actionable`` from the mean of metrics (name, value); without any the
    readiness is unknown."""
    s = F.col("score")
    pick = lambda k, other: F.coalesce(*[F.when(s > band[0], band[k]) for band in READINESS], F.lit(other))
    row = metrics.agg(F.avg("value").alias("score"))
    return row.select("score", pick(1, "Unknown").alias("readiness"), pick(2, "Medium").alias("impact"), pick(3, "Cannot assess deployment readiness without performance metrics").alias("description"), (pick(1, "Unknown") != "Ready").alias("actionable"))


def key_features(importances: DataFrame, share: float = 0.15) -> DataFrame:
    """``feature, rank, importance, share, description`` of the features with over ``share`` of all importance (feature,
    importance); a row for each feature goes through one window."""
    from pyspark.sql import Window

    every = importances.withColumn("share", F.try_divide("importance", F.sum("importance").over(Window.partitionBy())))
    ranked = every.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))).where(F.col("share") > share)
    return ranked.select("feature", "rank", "importance", "share", F.format_string("'%s' ranks #%d with %.1f%% importance", "feature", "rank", 100 * F.col("share")).alias("description"))


def summary_lists(insights: DataFrame, k: int = 5) -> DataFrame:
    """``list, place, rule, message``: the ``k`` most severe rows of each list. Critical and warning rows are ``risks``, the rest
    ``findings``; rules of ``action`` in their severity's order are ``next_steps``."""
    from pyspark.sql import Window

    weight = F.when(F.col("severity") == "critical", 0).when(F.col("severity").isin("warning", "high"), 1).when(F.col("severity") == "medium", 2).otherwise(3)
    lists = F.array(F.when(weight < 2, "risks").otherwise("findings"), F.when(weight < 3, "next_steps"))
    rows = insights.select("rule", "message", weight.alias("w"), F.explode(F.filter(lists, lambda x: x.isNotNull())).alias("list"))
    place = F.row_number().over(Window.partitionBy("list").orderBy("w", "rule"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("list", "place", "rule", "message")


def confidence(insights: DataFrame) -> DataFrame:
    """One row ``confidence, n, n_critical``: mean weight of the severities (1, .7, .3)."""
    weight = F.when(F.col("severity") == "critical", 1.0).when(F.col("severity") == "warning", 0.7).otherwise(0.3)
    return insights.agg(F.coalesce(F.avg(weight), F.lit(0.0)).alias("confidence"), F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("n_critical"))


def summary(insights: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most severe insights, by name within a severity."""
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return insights.orderBy(order, "rule").limit(k)


def sentences(contributions: DataFrame, key: str) -> DataFrame:
    """``key, text``: contributions (column_name, contribution, rank) in words."""
    word = F.format_string("%s %s it by %.3f", "column_name", F.when(F.col("contribution") >= 0, "raises").otherwise("lowers"), F.abs("contribution"))
    parts = contributions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", word.alias("w")))).alias("p"))
    return parts.select(key, F.array_join(F.col("p.w"), "; ").alias("text"))


def prediction_summary(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row: count, mean, deviation, extremes of predictions."""
    p = F.col(prediction)
    return df.agg(F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"), F.min(p).alias("least"), F.max(p).alias("most"))


#: What results of a kind of work say, and what to do about it (name of a fact, limit, message).
DOMAIN_RULES = {
    "series": [
        Rule("strong_trend", "trend_strength", ">", 0.6, "The level moves: model the trend", "info", "trend"),
        Rule("strong_season", "seasonal_strength", ">", 0.5, "The season repeats: use a seasonal model", "info", "season"),
        Rule("noisy", "residual_strength", ">", 0.7, "Most of the movement is noise: widen the bands", "warning", "noise"),
        Rule("gaps", "missing_share", ">", 0.1, "Many times are missing: check the source", "warning"),
        Rule("short", "n", "<", 30, "Few times: forecasts are uncertain", "warning"),
    ],
    "recommendations": [
        Rule("sparse", "sparsity", ">", 0.99, "Hardly any pair is rated: use factors or attributes", "warning"),
        Rule("low_coverage", "coverage", "<", 0.1, "Few items are ever shown: mix in the long tail", "warning", "coverage"),
        Rule("uniform_lists", "diversity", "<", 0.3, "Lists hold much of the same: re-rank for diversity", "warning", "diversity"),
        Rule("precise", "precision", ">", 0.2, "A fifth of what is shown is wanted", "info", "precision"),
    ],
    "texts": [
        Rule("short_texts", "mean_words", "<", 20, "Texts are short: prefer word features to topics", "info"),
        Rule("narrow_words", "diversity", "<", 0.3, "Texts repeat few words: look for templates", "warning"),
        Rule("large_vocabulary", "vocabulary", ">", 50_000, "Many words: limit or hash the features", "info"),
        Rule("hard_to_read", "flesch_ease", "<", 30, "Texts are hard to read", "info"),
    ],
}


def domain_insights(facts: DataFrame, domain: str) -> DataFrame:
    """Insights about one row of facts of ``series``, ``recommendations`` or ``texts``; facts that are not there are passed over."""
    known = [rule for rule in DOMAIN_RULES[domain] if rule.metric in facts.columns]
    return apply_rules(facts, known)
