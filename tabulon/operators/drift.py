"""Drift between a reference table and a current one: all numeric columns in long form, aggregated before shuffles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.rules import Rule, apply_rules, banded
from tabulon.functions.selection import quantile_arrays
from tabulon.functions.stats import chi2_p, ks_p, null_out_nan, numeric_columns, sample_kurtosis, sample_skewness, spread_rows, with_p_value
from tabulon.functions.storage import cut
from tabulon.operators.clean import in_ranges

PSI_BINS, PSI_FLOOR, PSI_LIMIT = 10, 0.001, 0.2
WASSERSTEIN_LIMIT = JS_LIMIT = 0.1
P_LIMIT = 0.1
SEVERITIES = [(0.5, "critical"), (0.3, "high"), (0.1, "medium")]


def _long(df: DataFrame, columns: list[str], side: int) -> DataFrame:
    """``feature, v, side`` rows without nulls and NaN."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    return null_out_nan(df).select(F.explode(pairs).alias("p")).select("p.*", F.lit(side).alias("side")).where("v IS NOT NULL")


def both_sides(reference: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``feature, v, r, c``: how often each value occurs in the reference and in the current table."""
    columns = columns or [c for c in numeric_columns(reference) if c in current.columns]
    rows = _long(reference, columns, 0).unionByName(_long(current, columns, 1))
    return rows.groupBy("feature", "v").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))


def reference_statistics(df: DataFrame, columns: list[str] | None = None, *, exact: bool = True) -> DataFrame:
    """What drift needs of a reference: moments, quartiles and PSI bin edges, one row for each numeric column."""
    columns = columns or numeric_columns(df)
    df = null_out_nan(df)
    points = [i / PSI_BINS for i in range(PSI_BINS + 1)]
    aggs, parts = [], {}
    edges = quantile_arrays(df, [F.col(f"`{c}`").cast("double") for c in columns], points, exact=exact)
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        named = {"n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "skewness": sample_skewness(x), "kurtosis": sample_kurtosis(x), "least": F.min(x), "most": F.max(x), "edges": edges[i]}
        aggs += [e.alias(f"{i}_{n}") for n, e in named.items()]
        parts[c] = [(n, F.col(f"{i}_{n}")) for n in named]
    return spread_rows(df.agg(*aggs), parts, "feature")


def category_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, category, n, share`` of each categorical column."""
    from tabulon.operators.profile import value_counts

    counts = value_counts(df, columns)
    total = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), "column_name").select(F.col("column_name").alias("feature"), F.col("value").alias("category"), "n", (F.col("n") / F.col("total")).alias("share"))


def _bin(v: Column, edges: Column) -> Column:
    """Number of the half-open bin that holds ``v`` (the last edge raised by 1e-6), or null outside."""
    last = F.size(edges)
    raised = F.transform(edges, lambda e, i: F.when(i == last - 1, e + 1e-6).otherwise(e))
    at = F.size(F.filter(raised, lambda e: e <= v))
    return F.when((at > 0) & (at < last), at)


def psi(reference: DataFrame, current: DataFrame, columns: list[str] | None = None, *, exact: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """``feature, psi``: population stability over ten quantile bins of the reference, shares at least 0.001.

    Current values beyond the edges stay in the denominator only. Here and below ``counts`` is :func:`both_sides` of the
    tables, where a caller has it.
    """
    columns = columns or [c for c in numeric_columns(reference) if c in current.columns]
    edges = F.broadcast(reference_statistics(reference, columns, exact=exact).select("feature", "edges"))
    counts = both_sides(reference, current, columns) if counts is None else counts
    binned = counts.join(edges, "feature").withColumn("bin", _bin(F.col("v"), F.col("edges"))).groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    totals = binned.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    bins = F.broadcast(reference.sparkSession.range(1, PSI_BINS + 1).select(F.col("id").cast("int").alias("bin")))
    every = totals.crossJoin(bins).join(binned.where("bin IS NOT NULL"), ["feature", "bin"], "left")
    share = lambda k, n: F.greatest(F.coalesce(F.try_divide(F.coalesce(k, F.lit(0)), n), F.lit(0.0)), F.lit(PSI_FLOOR))
    r, c = share(F.col("r"), F.col("nr")), share(F.col("c"), F.col("nc"))
    return every.groupBy("feature").agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))


_PLACES = "range_ int, feature string, r0 long, c0 long, nr long, nc long, next_v double"


def _cumulated(counts: DataFrame) -> DataFrame:
    """Value counts with both empirical distribution functions and ``step``, the distance to the feature's next value.

    Values of all features lie in ranges together, so that no feature is one task; what a range needs of the ones before and
    behind it is a row for each range and feature that meet.
    """
    placed = in_ranges(counts, ["feature", "v"])
    met = placed.groupBy("feature", "range_").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.min("v").alias("v")).collect()
    met = sorted(met, key=lambda m: (m["feature"], m["range_"]))
    totals: dict[str, list[int]] = {}
    places = []
    for m, after in zip(met, [*met[1:], None], strict=True):
        upto = totals.setdefault(m["feature"], [0, 0])
        same = after is not None and after["feature"] == m["feature"]
        places.append([m["range_"], m["feature"], *upto, 0, 0, after["v"] if same else None])
        upto[0] += m["r"]
        upto[1] += m["c"]
    for place in places:
        place[4:6] = totals[place[1]]
    found = placed.join(F.broadcast(counts.sparkSession.createDataFrame(places, _PLACES)), ["range_", "feature"])
    w = Window.partitionBy("range_", "feature").orderBy("v")
    part = lambda k: (F.sum(k).over(w) + F.col(f"{k}0")) / F.col(f"n{k}")
    return found.select("feature", "v", "r", "c", "nr", "nc", part("r").alias("fr"), part("c").alias("fc"), (F.coalesce(F.lead("v").over(w), F.col("next_v")) - F.col("v")).alias("step"))


def ks(reference: DataFrame, current: DataFrame, columns: list[str] | None = None, *, counts: DataFrame | None = None) -> DataFrame:
    """``feature, ks, n_reference, n_current, p_value``: the largest distance of the distribution functions."""
    counts = both_sides(reference, current, columns) if counts is None else counts
    found = _cumulated(counts).groupBy("feature").agg(F.max(F.abs(F.col("fr") - F.col("fc"))).alias("ks"), F.first("nr").alias("n_reference"), F.first("nc").alias("n_current"))
    return with_p_value(found, "p_value", ks_p, "ks", "n_reference", "n_current")


def wasserstein(reference: DataFrame, current: DataFrame, columns: list[str] | None = None, *, counts: DataFrame | None = None) -> DataFrame:
    """``feature, wasserstein``: on the reference's range scaled to [0, 1], the current values clipped to it."""
    counts = both_sides(reference, current, columns) if counts is None else counts
    known = F.when(F.col("r") > 0, F.col("v"))
    limits = F.broadcast(counts.groupBy("feature").agg(F.min(known).alias("lo"), F.max(known).alias("hi")))
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    merged = counts.join(limits, "feature").where("hi > lo").groupBy("feature", x.alias("v")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    return _cumulated(merged).groupBy("feature").agg(F.coalesce(F.sum(F.abs(F.col("fr") - F.col("fc")) * F.col("step")), F.lit(0.0)).alias("wasserstein"))


def jensen_shannon(reference: DataFrame, current: DataFrame, columns: list[str] | None = None, *, counts: DataFrame | None = None) -> DataFrame:
    """``feature, js_distance, js_divergence`` over min(50, root of the smaller count) equal bins of the joint range."""
    counts = both_sides(reference, current, columns) if counts is None else counts
    spans = F.broadcast(counts.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("r").alias("nr"), F.sum("c").alias("nc")).where("hi > lo"))
    bins = F.least(F.lit(50), F.floor(F.sqrt(F.least("nr", "nc"))).cast("int"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), bins - 1).cast("int")
    binned = counts.join(spans, "feature").groupBy("feature", bins.alias("bins"), at.alias("bin")).agg((F.sum("r") / F.first("nr")).alias("p"), (F.sum("c") / F.first("nc")).alias("q"))
    p, q = F.col("p") + 1e-10, F.col("q") + 1e-10
    total = binned.groupBy("feature").agg(F.first("bins").alias("bins"), F.count("*").alias("k"), F.sum(p).alias("sp"), F.sum(q).alias("sq"))
    empty = (F.col("bins") - F.col("k")) * 1e-10  # bins without any value count with the added share
    joined = binned.join(F.broadcast(total), ["feature", "bins"])
    a, b = p / (F.col("sp") + empty), q / (F.col("sq") + empty)
    m = (a + b) / 2
    divergence = joined.groupBy("feature").agg(F.sum((a * F.ln(a / m) + b * F.ln(b / m)) / 2).alias("js_divergence"))
    return divergence.select("feature", F.sqrt(F.greatest("js_divergence", F.lit(0.0))).alias("js_distance"), "js_divergence")


def chi_square(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, chi2, dof, total_variation, unseen_ratio, p_value, drift_score, drifted`` of categorical columns.

    Expected counts follow the reference; categories unseen there count for the total variation and ``unseen_ratio`` only.
    """
    from tabulon.operators.profile import value_counts

    side = lambda df, n: value_counts(df, columns).select(F.col("column_name").alias("feature"), "value", F.col("n").alias(n))
    joined = side(reference, "r").join(side(current, "c"), ["feature", "value"], "full_outer").na.fill(0, ["r", "c"])
    every = Window.partitionBy("feature")
    shared = joined.withColumns({"nr": F.sum("r").over(every), "nc": F.sum("c").over(every)})
    expected = F.col("r") / F.col("nr") * F.col("nc")
    found = shared.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("r") > 0, (F.col("c") - expected) * (F.col("c") - expected) / expected)), F.lit(0.0)).alias("chi2"),
        (F.count_if(F.col("r") > 0) - 1).alias("dof"),
        (0.5 * F.sum(F.abs(F.col("r") / F.col("nr") - F.col("c") / F.col("nc")))).alias("total_variation"),
        F.sum(F.when(F.col("r") == 0, F.col("c") / F.col("nc")).otherwise(0.0)).alias("unseen_ratio"),
    )
    scored = with_p_value(found, "p_value", chi2_p, "chi2", "dof")
    by_test = (F.col("dof") > 0) & (F.col("p_value") < P_LIMIT)
    score = F.when(by_test, F.least(F.lit(1.0), F.col("chi2") / (5.0 * F.col("dof")))).when(F.col("total_variation") > 0.1, F.col("total_variation")).otherwise(0.0)
    return scored.withColumns({"drift_score": score, "drifted": by_test | (F.col("total_variation") > 0.1)})


def numeric_drift(reference: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each feature with all four statistics, the score and the first method that found drift.

    The score is the largest ratio of statistic and limit among the methods that found drift (KS counts as it is).
    """
    counts = cut(both_sides(reference, current, columns))
    found = ks(reference, current, columns, counts=counts)
    for part in (psi(reference, current, columns, counts=counts), wasserstein(reference, current, columns, counts=counts), jensen_shannon(reference, current, columns, counts=counts).drop("js_divergence")):
        found = found.join(part, "feature", "left")
    tests = [("kolmogorov_smirnov", F.col("p_value") < P_LIMIT, F.col("ks")), ("psi", F.col("psi") > PSI_LIMIT, F.col("psi") / PSI_LIMIT), ("wasserstein", F.col("wasserstein") > WASSERSTEIN_LIMIT, F.col("wasserstein") / WASSERSTEIN_LIMIT), ("jensen_shannon", F.col("js_distance") > JS_LIMIT, F.col("js_distance") / JS_LIMIT)]
    score = F.greatest(*[F.coalesce(F.when(holds, value), F.lit(0.0)) for _, holds, value in tests])
    method = F.coalesce(*[F.when(holds, F.lit(name)) for name, holds, _ in tests])
    return found.withColumns({"drift_score": score, "primary_method": method, "drifted": method.isNotNull()})


def multivariate_drift(reference: DataFrame, current: DataFrame, columns: list[str] | None = None, p: float = 0.05) -> DataFrame:
    """One row ``drifted, least_p, n_features``: KS on every dimension with Bonferroni's correction."""
    return ks(reference, current, columns).agg((F.min("p_value") < F.lit(p) / F.count("*")).alias("drifted"), F.min("p_value").alias("least_p"), F.count("*").alias("n_features"))


def target_drift(reference: DataFrame, current: DataFrame, targets: dict[str, str]) -> DataFrame:
    """``kind, feature, method, statistic, p_value, drift_score, drifted, severity`` of the target and of predictions.

    ``targets`` maps a kind (``target``, ``prediction``) to its column. Numbers are judged by the Kolmogorov-Smirnov distance,
    which is the score where it is significant; classes by the chi-square test of :func:`chi_square`.
    """
    numeric = set(numeric_columns(reference))
    numbers, classes = [c for c in targets.values() if c in numeric], [c for c in targets.values() if c not in numeric]
    found = None
    if numbers:
        found = ks(reference, current, numbers).select("feature", F.lit("kolmogorov_smirnov").alias("method"), F.col("ks").alias("statistic"), "p_value", F.when(F.col("p_value") < P_LIMIT, F.col("ks")).otherwise(0.0).alias("drift_score"), (F.col("p_value") < P_LIMIT).alias("drifted"))
    if classes:
        part = chi_square(reference, current, classes).select("feature", F.lit("chi_square").alias("method"), F.col("chi2").alias("statistic"), "p_value", "drift_score", "drifted")
        found = part if found is None else found.unionByName(part)
    named = reference.sparkSession.createDataFrame(list(targets.items()), "kind string, feature string")
    return F.broadcast(named).join(found, "feature").select("kind", "feature", "method", "statistic", "p_value", "drift_score", "drifted", severity(F.col("drift_score")).alias("severity"))


def severity(score: Column) -> Column:
    return banded(score, SEVERITIES, "low")


def health(score: Column, limit: float) -> Column:
    return F.when(score <= limit, "healthy").when(score <= 2 * limit, "warning").otherwise("critical")


def table_drift(reference: DataFrame, current: DataFrame, numbers: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """One row for each feature and the table's mean score, verdict and severity on every row."""
    numeric = numeric_drift(reference, current, numbers).select("feature", "drift_score", "primary_method", "drifted")
    if categories:
        named = chi_square(reference, current, categories)
        numeric = numeric.unionByName(named.select("feature", "drift_score", F.when(F.col("drifted"), "chi_square").alias("primary_method"), "drifted"))
    whole = numeric.agg(F.avg("drift_score").alias("table_score"), F.bool_or("drifted").alias("table_drifted"))
    return numeric.crossJoin(F.broadcast(whole)).withColumns({"severity": severity(F.col("drift_score")), "table_severity": severity(F.col("table_score"))})


def performance_drift(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """``metrics`` (name, value) against ``baseline`` (name, value): relative drop; over 5 % drift, 10 % high, 15 % critical."""
    joined = metrics.alias("m").join(baseline.alias("b"), "name").select("name", F.col("m.value").alias("value"), F.col("b.value").alias("baseline"))
    drop = F.try_divide(F.col("baseline") - F.col("value"), F.abs("baseline"))
    return joined.withColumn("drop", drop).withColumns({"drifted": F.col("drop") > 0.05, "severity": banded(F.col("drop"), [(0.15, "critical"), (0.10, "high"), (0.05, "medium")], "low")})


def combined_status(parts: DataFrame) -> DataFrame:
    """One row ``status`` from rows ``(check, status)``: the worst of healthy, warning and critical, and the failing checks."""
    order = F.when(F.col("status") == "critical", 2).when(F.col("status") == "warning", 1).otherwise(0)
    row = parts.agg(F.max(order).alias("worst"), F.count_if(order > 0).alias("n_failing"))
    return row.select(F.when(F.col("worst") == 2, "critical").when(F.col("worst") == 1, "warning").otherwise("healthy").alias("status"), "n_failing")


def drift_report(alerts: DataFrame, since, until) -> DataFrame:
    """Alerts of a period by feature: count, mean and largest score, and how many are high or critical."""
    some = alerts.where((F.col("timestamp") >= F.lit(since)) & (F.col("timestamp") < F.lit(until)))
    return some.groupBy("feature").agg(F.count("*").alias("n_alerts"), F.avg("drift_score").alias("mean_score"), F.max("drift_score").alias("top_score"), F.count_if(F.col("severity").isin("high", "critical")).alias("n_severe"))


def threshold_alerts(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """``metrics`` (name, value, ...) that reach ``limits`` (name, warning, critical), with their level."""
    level = F.when(F.col("value") >= F.col("critical"), "critical").when(F.col("value") >= F.col("warning"), "warning")
    return metrics.join(F.broadcast(limits), "name").withColumn("level", level).where("level IS NOT NULL").select("name", "value", "level")


DRIFT_RULES = [
    Rule("retrain_now", "table_score", ">=", 0.5, "Retrain the model on recent data", "critical", "action"),
    Rule("plan_retraining", "table_score", ">=", 0.3, "Plan retraining and watch the features", "high", "action"),
    Rule("watch", "table_score", ">=", 0.1, "Watch the drifting features", "medium", "action"),
    Rule("none", "table_score", ">=", 0.0, "No action needed", "low", "action"),
]


def drift_advice(drift: DataFrame) -> DataFrame:
    """Advice for a :func:`table_drift` result."""
    return apply_rules(drift.agg(F.max("table_score").alias("table_score")), DRIFT_RULES)


def js_bins(n: int) -> int:
    """Bins that :func:`jensen_shannon` uses for ``n`` values on the smaller side."""
    return min(50, int(math.sqrt(n)))
