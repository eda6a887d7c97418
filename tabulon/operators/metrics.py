"""Evaluation of predictions: one aggregate or one confusion table, exact with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.selection import exact_quantiles
from tabulon.functions.stats import chi2_p, correlation, signed_rank_p, t_two_sided, with_p_value
from tabulon.functions.storage import stored
from tabulon.operators.clean import grouped_running_totals, running_totals

#: Two-sided 95 % points of Student's t for 1 to 29 degrees of freedom (fixed values of the distribution).
T_95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045)


def _selected(rows: DataFrame, value: Column, at: list[float]) -> list[Column]:
    """Exact quantiles of a column as literals, found by passes over ``rows`` and without a map of its values; infinite values
    and NaN, which rank last, are left to Spark's percentile."""
    if rows.where(~F.coalesce(F.abs(value) < float("inf"), F.lit(True))).isEmpty():
        return [F.lit(v).cast("double") for v in exact_quantiles(rows, [value], at)[0]]
    return [F.percentile(value, q) for q in at]


def regression(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """MSE, RMSE, MAE, R², MAPE, sMAPE, median and largest error, explained variance and Pearson, in one aggregate.

    Without ``by``, both columns are written once, since the median error is selected in passes.
    """
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    known = df.where(y.isNotNull() & p.isNotNull())
    if not by:
        known = stored(known.select(y.alias("y_"), p.alias("p_")), "errors")
        y, p = F.col("y_"), F.col("p_")
    e = y - p
    var = F.var_pop(y)
    middle = F.median(F.abs(e)) if by else _selected(known, F.abs(e), [0.5])[0]
    return known.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.avg(e * e), var)).alias("r2"), (100 * F.avg(F.when(y != 0, F.abs(e / y)))).alias("mape"),
        (100 * F.avg(F.try_divide(2 * F.abs(e), F.abs(y) + F.abs(p)))).alias("smape"), middle.alias("median_error"), F.max(F.abs(e)).alias("max_error"), (1 - F.try_divide(F.var_pop(e), var)).alias("explained_variance"), correlation(y, p).alias("pearson"),
    )


def r_squared(df: DataFrame, actual: str, predicted: str) -> float | None:
    """R² of :func:`regression` by itself, in one pass: for comparisons that need no other measure."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return df.where(y.isNotNull() & p.isNotNull()).agg(1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))).first()[0]


def _mid_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with average ranks of ``value``, from running counts over its distinct values."""
    counts = df.groupBy(F.col(value).alias("v_")).agg(F.count("*").alias("k_"))
    ranks = running_totals(counts, ["v_"], {"upto_": "k_"}).select("v_", (F.col("upto_") - (F.col("k_") - 1) / 2).alias(out))
    return df.join(ranks, F.col(value) == F.col("v_")).drop("v_")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``spearman, n``: Pearson correlation of average ranks."""
    rows = df.select(F.col(a).cast("double").alias("a_"), F.col(b).cast("double").alias("b_")).na.drop()
    return _mid_rank(_mid_rank(rows, "a_", "ra"), "b_", "rb").agg(correlation("ra", "rb").alias("spearman"), F.count("*").alias("n"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``actual, predicted, n`` for each pair that occurs."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``label, support, precision, recall, f1`` of each class, from the confusion table."""
    table = confusion(df, actual, predicted)
    rows = table.select(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    rows = rows.unionByName(table.select(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")))
    sums = rows.groupBy("label").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    part = lambda k: F.coalesce(F.try_divide(F.col("hit"), F.col(k)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("support") + F.col("guessed")), F.lit(0.0))
    return sums.select("label", "support", "guessed", "hit", part("guessed").alias("precision"), part("support").alias("recall"), f1.alias("f1"))


def classification(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: accuracy, macro and weighted precision, recall, F1, balanced accuracy, kappa and Matthews correlation."""
    r = class_report(df, actual, predicted)
    s, n = F.col("support"), F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * s) / n
    hits, cross = F.sum("hit"), F.sum(s * F.col("guessed"))
    ss, gg = F.sum(s * s), F.sum(F.col("guessed") * F.col("guessed"))
    expected = cross / (n * n)
    return r.agg(
        n.alias("n"), (hits / n).alias("accuracy"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"), weighted("precision").alias("precision_weighted"), weighted("recall").alias("recall_weighted"), weighted("f1").alias("f1_weighted"),
        F.avg(F.when(s > 0, F.col("recall"))).alias("balanced_accuracy"), F.try_divide(hits / n - expected, 1 - expected).alias("kappa"), F.try_divide(1.0 * hits * n - cross, F.sqrt((1.0 * n * n - ss) * (1.0 * n * n - gg))).alias("mcc"),
    )


def ranking_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row ``roc_auc, average_precision, log_loss, brier, n``: labels 0/1, scores as probabilities; ties are exact."""
    rows = df.select(F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("s")).na.drop()
    by_score = rows.groupBy("s").agg(F.sum("y").alias("p"), F.count("*").alias("k"))
    totals = F.broadcast(rows.agg(F.sum("y").alias("positives"), F.count("*").alias("all_")))
    c = running_totals(by_score, [F.desc("s")], {"tp": "p", "upto": "k"}).crossJoin(totals)
    negatives = F.col("k") - F.col("p")
    auc = F.sum(negatives * (F.col("tp") - F.col("p") / 2))
    ap = F.sum(F.col("p") / F.col("positives") * F.col("tp") / F.col("upto"))
    curve = c.agg(F.try_divide(auc, F.first("positives") * (F.first("all_") - F.first("positives"))).alias("roc_auc"), ap.alias("average_precision"))
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("s")))
    loss = rows.agg((-F.avg(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))).alias("log_loss"), F.avg((F.col("y") - F.col("s")) * (F.col("y") - F.col("s"))).alias("brier"), F.count("*").alias("n"))
    return curve.crossJoin(F.broadcast(loss))


def _by_class(df: DataFrame, actual: str, scores: dict[str, str]) -> DataFrame:
    """``class, y, s``: for each row with a known class and score, one row for each class of ``scores`` (class: column)."""
    y = F.col(f"`{actual}`").cast("string")
    each = F.array(*[F.struct(F.lit(c).alias("class"), (y == c).cast("long").alias("y"), F.col(f"`{s}`").cast("double").alias("s")) for c, s in scores.items()])
    return df.where(y.isNotNull()).select(F.explode(each).alias("r")).select("r.*").where(F.col("s").isNotNull() & ~F.isnan("s"))


def class_curves(df: DataFrame, actual: str, scores: dict[str, str]) -> DataFrame:
    """``class, positives, n, roc_auc, average_precision, brier``: each class against the rest, ties exact.

    ``scores`` names the score column of each class. Values of all classes are counted once and placed in ranges together;
    a class without positives or without others has no area (null).
    """
    rows = _by_class(df, actual, scores)
    counted = rows.groupBy("class", "s").agg(F.sum("y").alias("p"), F.count("*").alias("k"))
    c = grouped_running_totals(counted, "class", [F.desc("s")], {"tp": "p", "upto": "k"})
    negatives = F.col("k") - F.col("p")
    area = F.sum(negatives * (F.col("tp") - F.col("p") / 2))
    precision = F.sum(F.try_divide(F.col("p"), F.col("tp_all")) * F.col("tp") / F.col("upto"))
    square = F.sum(F.col("p") * (1 - F.col("s")) * (1 - F.col("s")) + negatives * F.col("s") * F.col("s"))
    a = c.groupBy("class").agg(F.first("tp_all").alias("positives"), F.first("upto_all").alias("n"), area.alias("a_"), precision.alias("average_precision"), square.alias("b_"))
    return a.select("class", "positives", "n", F.try_divide("a_", F.col("positives") * (F.col("n") - F.col("positives"))).alias("roc_auc"), "average_precision", (F.col("b_") / F.col("n")).alias("brier"))


def class_curve_means(curves: DataFrame) -> DataFrame:
    """One row: macro means and means weighted by positives of the areas and precisions of :func:`class_curves`."""
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("positives")), F.sum(F.when(F.col(c).isNotNull(), F.col("positives"))))
    return curves.agg(F.avg("roc_auc").alias("roc_auc_macro"), weighted("roc_auc").alias("roc_auc_weighted"), F.avg("average_precision").alias("average_precision_macro"), weighted("average_precision").alias("average_precision_weighted"))


def calibration(df: DataFrame, actual: str, scores: dict[str, str], bins: int = 10) -> DataFrame:
    """``class, bin, n, mean_score, share, error``: scores in equal bins of [0, 1] against the share of rows of the class;
    ``error`` is the class's expected calibration error, on each of its rows. One aggregate."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("s") * bins))).cast("int")
    binned = _by_class(df, actual, scores).groupBy("class", at.alias("bin")).agg(F.count("*").alias("n"), F.avg("s").alias("mean_score"), F.avg("y").alias("share"))
    every = Window.partitionBy("class")  # at most ``bins`` rows of each class
    return binned.withColumn("error", F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("share"))).over(every) / F.sum("n").over(every))


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mean, deviation, skewness and kurtosis (both biased) of the residuals, and the share beyond both fences."""
    e = (F.col(actual) - F.col(predicted)).cast("double")
    rows = stored(df.select(e.alias("e")).na.drop(), "residuals")
    q1, q3 = F.col("q")[0], F.col("q")[1]
    q = rows.agg(F.array(*_selected(rows, F.col("e"), [0.25, 0.75])).alias("q"))
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return rows.crossJoin(F.broadcast(q)).agg(F.avg("e").alias("mean"), F.stddev_pop("e").alias("std"), F.skewness("e").alias("skewness"), F.kurtosis("e").alias("kurtosis"), (100 * F.try_divide(F.count_if((F.col("e") < low) | (F.col("e") > high)), F.count("*"))).alias("outlier_percent"))


def largest_errors(df: DataFrame, key: str, actual: str, predicted: str, k: int = 10) -> DataFrame:
    """The ``k`` rows of largest absolute residual; ties go to the smaller key."""
    e = F.col(actual) - F.col(predicted)
    return df.select(key, e.alias("residual")).orderBy(F.desc(F.abs("residual")), key).limit(k)


def fold_interval(scores: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, mean, std, lower, upper`` of fold scores: Student's t below thirty folds, else the normal."""
    a = scores.groupBy(*by).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))
    t = F.when(F.col("n") < 2, None).when(F.col("n") <= 30, F.element_at(F.array(*[F.lit(x) for x in T_95]), F.greatest(F.least(F.col("n") - 1, F.lit(29)), F.lit(1)).cast("int"))).otherwise(1.96)
    half = t * F.col("std") / F.sqrt("n")
    return a.withColumns({"lower": F.col("mean") - half, "upper": F.col("mean") + half})


def paired_comparison(scores: DataFrame, model: str = "model", fold: str = "fold", score: str = "score") -> DataFrame:
    """``model_a, model_b, folds, mean_difference, t, p_value``: paired t over the folds that two models share."""
    a, b = (scores.select(F.col(model).alias(f"model_{s}"), F.col(fold).alias("fold_"), F.col(score).alias(f"score_{s}")) for s in "ab")
    d = F.col("score_a") - F.col("score_b")
    pairs = a.join(b, "fold_").where("model_a < model_b").groupBy("model_a", "model_b").agg(F.count(d).alias("folds"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("s_"))
    t = pairs.withColumn("t", F.try_divide("mean_difference", F.col("s_") / F.sqrt("folds"))).withColumn("dof_", F.col("folds") - 1).drop("s_")
    return with_p_value(t, "p_value", t_two_sided, "t", "dof_").drop("dof_")


def wilcoxon(scores: DataFrame, model: str = "model", fold: str = "fold", score: str = "score") -> DataFrame:
    """``model_a, model_b, n, w, z, p_value``: signed ranks of the differences over shared folds, zeros left out, ties at
    their mean rank; the p-value is exact for up to 25 folds without ties, else the normal one with the correction for ties."""
    a, b = (scores.select(F.col(model).alias(f"model_{s}"), F.col(fold).alias("fold_"), F.col(score).alias(f"score_{s}")) for s in "ab")
    pairs = a.join(b, "fold_").where("model_a < model_b").select("model_a", "model_b", F.round(F.col("score_a") - F.col("score_b"), 12).alias("d")).where("d <> 0")
    by = Window.partitionBy("model_a", "model_b")
    size = F.count("*").over(Window.partitionBy("model_a", "model_b", F.abs("d")))
    ranked = pairs.withColumns({"ties": size, "r": F.rank().over(by.orderBy(F.abs("d"))) + (size - 1) / 2})
    sums = ranked.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("down"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48)
    out = sums.select("model_a", "model_b", "n", F.least("up", "down").alias("w"), F.coalesce(F.try_divide(F.least("up", "down") - n * (n + 1) / 4, spread), F.lit(0.0)).alias("z"), F.col("t").cast("double").alias("t_"))
    return with_p_value(out, "p_value", signed_rank_p, "w", "n", "z", "t_").drop("t_")


def friedman(scores: DataFrame, model: str = "model", fold: str = "fold", score: str = "score") -> DataFrame:
    """One row ``models, folds, statistic, p_value``: do mean ranks of models over complete folds differ; with correction for ties."""
    k = F.count("*").over(Window.partitionBy(fold))
    size = F.count("*").over(Window.partitionBy(fold, score))
    ranked = scores.where(F.col(score).isNotNull()).withColumns({"k_": k, "ties_": size, "r_": F.rank().over(Window.partitionBy(fold).orderBy(score)) + (size - 1) / 2})
    full = ranked.withColumn("most_", F.max("k_").over(Window.partitionBy())).where("k_ = most_")
    by_model = full.groupBy(model).agg(F.sum("r_").alias("r"), F.count("*").alias("n"))
    ties = full.agg(F.sum(F.col("ties_") * F.col("ties_") - 1).alias("t"))
    row = by_model.agg(F.count("*").alias("models"), F.max("n").alias("folds"), F.sum(F.col("r") * F.col("r")).alias("rr")).crossJoin(F.broadcast(ties))
    m, n = F.col("models"), F.col("folds")
    plain = 12 / (n * m * (m + 1)) * F.col("rr") - 3 * n * (m + 1)
    value = F.try_divide(plain, 1 - F.col("t") / (n * m * (m * m - 1)))
    return with_p_value(row.select("models", "folds", F.coalesce(value, F.lit(0.0)).alias("statistic"), (m - 1).alias("dof_")), "p_value", chi2_p, "statistic", "dof_").drop("dof_")


def model_ranking(results: DataFrame, *, higher_is_better: bool = True) -> DataFrame:
    """``results`` (model, test, cv, seconds, size) with ``combined`` (.4 test, .3 cv, .2 speed, .1 smallness) and ``rank``."""
    every = Window.partitionBy()
    norm = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(every), F.max(c).over(every) - F.min(c).over(every)), F.lit(1.0))
    good = (lambda c: norm(c)) if higher_is_better else (lambda c: 1 - norm(c))
    score = 0.4 * good("test") + 0.3 * good("cv") + 0.2 * (1 - norm("seconds")) + 0.1 * (1 - norm("size"))
    return results.withColumn("combined", score).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("combined"), "model")))


def business_score(score: Column, seconds: Column, interpretable: Column, efficiency: Column) -> Column:
    """.6 score, .2 speed (one over one plus seconds), .1 interpretability, .1 efficiency."""
    return 0.6 * score + 0.2 / (1 + seconds) + 0.1 * interpretable + 0.1 * efficiency


def baseline(df: DataFrame, actual: str, predicted: str, kind: str = "regression") -> DataFrame:
    """One row ``model, baseline, improvement``: RMSE against the deviation, or accuracy against the largest class."""
    if kind == "regression":
        e = F.col(actual) - F.col(predicted)
        row = df.agg(F.sqrt(F.avg(e * e)).alias("model"), F.stddev_pop(actual).alias("baseline"))
        return row.withColumn("improvement", F.try_divide(F.col("baseline") - F.col("model"), "baseline"))
    classes = df.groupBy(F.col(actual).alias("a_")).agg(F.count("*").alias("n"), F.count_if(F.col(actual) == F.col(predicted)).alias("hit"))
    row = classes.agg((F.sum("hit") / F.sum("n")).alias("model"), (F.max("n") / F.sum("n")).alias("baseline"))
    return row.withColumn("improvement", F.try_divide(F.col("model") - F.col("baseline"), "baseline"))


def feature_value(importances: DataFrame, costs: DataFrame, value: float) -> DataFrame:
    """``feature, share, worth, cost, net, roi`` of features for a model worth ``value``."""
    shares = importances.withColumn("share", F.try_divide("importance", F.sum("importance").over(Window.partitionBy())))
    joined = shares.join(costs, "feature", "left").withColumn("cost", F.coalesce("cost", F.lit(0.0))).withColumn("worth", F.col("share") * value)
    return joined.select("feature", "share", "worth", "cost", (F.col("worth") - F.col("cost")).alias("net"), F.try_divide(F.col("worth") - F.col("cost"), "cost").alias("roi"))


def fold_scores(df: DataFrame, fold: str, actual: str, predicted: str, kind: str = "regression") -> DataFrame:
    """``fold, n, score``: R² or accuracy of each fold."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    score = 1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y)) if kind == "regression" else F.avg((F.col(actual) == F.col(predicted)).cast("double"))
    return df.groupBy(F.col(fold).alias("fold")).agg(F.count("*").alias("n"), score.alias("score"))


def history(metrics: DataFrame, since, model: str = "model") -> DataFrame:
    """``model, metric, n, mean, best, latest`` of logged metrics (model, metric, value, ts) from ``since`` on."""
    return metrics.where(F.col("ts") >= F.lit(since)).groupBy(model, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("best"), F.max_by("value", F.struct("ts", "value")).alias("latest"))
