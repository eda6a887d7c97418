"""Edge cases of core operators on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from tabulon.functions import stats
from tabulon.functions.rules import Rule, apply_rules
from tabulon.operators import clean, drift, features, metrics, profile, quality


def test_p_values_match_known_points():
    assert stats.chi2_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_p(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert stats.ks_p(0.0, 10, 10) == 1.0 and stats.ks_p(1.0, 100, 100) < 1e-10


def test_shape_is_bias_corrected(spark):
    row = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double").agg(stats.sample_skewness(F.col("x")).alias("s"), stats.sample_kurtosis(F.col("x")).alias("k")).first()
    assert row["s"] == pytest.approx(1.763632614803888) and row["k"] == pytest.approx(3.228)


def test_nan_counts_as_missing_and_empty_tables_work(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None)], "x double, s string")
    assert {r["column_name"]: r["null_count"] for r in profile.missing_summary(df).collect()} == {"x": 1, "s": 1}
    empty = df.limit(0)
    assert {r["null_ratio"] for r in profile.missing_summary(empty).collect()} == {0.0}
    assert quality.quality_report(empty).count() == 2
    assert profile.duplicate_summary(empty).first()["duplicate_ratio"] == 0.0


def test_names_are_cleaned():
    assert clean.clean_names([" a b ", "a-b", "", "a__b"]) == ["a_b", "a_b_1", "column_2", "a_b_2"]
    assert profile.named_as_id("user_id") and not profile.named_as_id("width") and profile.named_as_id("width", compat=True)


def test_positions_are_total(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert sorted((r["k"], r["position"]) for r in clean.positions(df, ["k"]).collect()) == [(i, i) for i in range(1000)]


def test_order_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"))
        assert clean.positions(df, ["k"]).where("k <> position").count() == 0
        out = clean.running_totals(df.withColumn("one", F.lit(1)), ["k"], {"upto": "one"})
        assert out.where("upto <> k + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_as_of_takes_the_latest_within_the_time_to_live(spark):
    left = spark.sql("SELECT * FROM VALUES ('a', timestamp'2020-01-02'), ('a', timestamp'2020-01-01'), ('b', timestamp'2020-01-01') AS t(k, ts)")
    right = spark.sql("SELECT * FROM VALUES ('a', timestamp'2020-01-01', 1), ('a', timestamp'2020-01-03', 2) AS t(k, ts, v)")
    got = {(r["k"], r["ts"].day): r["v"] for r in clean.as_of(left, right, "k", "ts", ["v"], ttl_seconds=3600).collect()}
    assert got == {("a", 2): None, ("a", 1): 1, ("b", 1): None}


def test_iterative_imputation_finds_a_line(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") % 5 > 0, 3.0 * F.col("id") + 1).alias("y"))
    out = clean.iterative_impute(df, ["x", "y"], rounds=1)
    assert out.where(F.abs(F.col("y") - (3 * F.col("x") + 1)) > 1e-3).count() == 0


def test_drift_of_equal_tables_is_none(spark):
    df = spark.range(500).select((F.col("id") % 97).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    rows = drift.table_drift(df, df, ["x"], ["c"]).collect()
    assert all(r["drift_score"] == 0.0 and not r["table_drifted"] for r in rows)
    moved = df.withColumn("x", F.col("x") + 200)
    assert drift.numeric_drift(df, moved, ["x"]).first()["ks"] == 1.0


def test_rules_of_a_group_exclude_each_other(spark):
    rules = [Rule("high", "x", ">", 10, "h", group="g"), Rule("some", "x", ">", 1, "s", group="g"), Rule("odd", "x", "==", 11, "o")]
    df = spark.createDataFrame([(1, 11.0), (2, 5.0), (3, None)], "k int, x double")
    assert sorted((r["k"], r["rule"]) for r in apply_rules(df, rules, ["k"]).collect()) == [(1, "high"), (1, "odd"), (2, "some")]


def test_ranking_curve_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, s double")
    row = metrics.ranking_curve(df, "y", "s").first()
    assert row["roc_auc"] == pytest.approx(0.625) and row["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_encoders_take_unseen_values(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "c string, y double")
    new = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    got = {r["c"]: r["e"] for r in features.label_encode(new, "c", "e", fit_on=train).collect()}
    assert got == {"a": 0, "z": -1, None: -1}
    got = {r["c"]: r["e"] for r in features.target_encode(new, "c", "y", "e", fit_on=train).collect()}
    assert got["a"] == pytest.approx((4 + 3) / 3) and got["z"] == got[None] == 3.0


def test_quantile_transform_is_monotone(spark):
    df = spark.range(1, 400).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    rows = features.quantile_transform(df, "x", "z", normal=True, exact=True).orderBy("x").collect()
    z = [r["z"] for r in rows]
    assert z == sorted(z) and abs(z[len(z) // 2]) < 0.05 and math.isfinite(z[0])


def test_every_date_format_is_found_and_read(spark):
    import datetime

    when = datetime.datetime(2021, 11, 23, 14, 5, 6, 250000)
    forms = {"yyyy": "%Y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "dd": "%d", "d": "%d", "HH": "%H", "mm": "%M", "ss": "%S", "SSSSSS": "%f", "XXX": "+00:00", "'T'": "T", "'Z'": "Z"}
    for pattern in profile.DATE_FORMATS:
        import re

        text = when.strftime(re.sub("|".join([*forms, "."]), lambda m: forms.get(m[0], m[0]), pattern))
        df = spark.createDataFrame([(text,), (text,), (text,), (text,), (text,), ("none",)], "x string")
        row = profile.date_format(df, "x").first()
        assert row["format"] == pattern and row["ratio"] == pytest.approx(5 / 6)
        got = df.select(profile.parsed_datetime(F.col("x"), pattern).alias("t")).collect()
        assert got[0]["t"].date() == when.date() and got[5]["t"] is None
    days = spark.createDataFrame([("Nov 3, 2021",), ("Dec 24, 2021",), (None,)], "x string")
    assert [str(r["x"]) for r in clean.convert_types(days).collect()] == ["2021-11-03 00:00:00", "2021-12-24 00:00:00", "None"]


def test_text_rules_on_odd_texts(spark):
    from tabulon.operators import text

    rows = [(0, None), (1, ""), (2, "short"), (3, "word word word word other. " * 3), (4, "1234 5678 9012 3456 7890 1234"), (5, "a" * 200), (6, "§§§ §§§§ plain words here and §§§")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r["doc_id"]: (r["issues"], r["score"]) for r in text.quality_issues(df).collect()}
    assert found[0] == found[1] and found[1][0] == "too_short,few_characters,few_letters" and found[1][1] == pytest.approx(0.24)
    assert "repeated_word" in found[3][0] and "few_letters" in found[4][0] and "few_characters" in found[5][0] and "special_characters" in found[6][0]
    quality_of = {r["doc_id"]: r["quality"] for r in text.text_quality(df).collect()}
    assert quality_of[0] == quality_of[1] == pytest.approx(0.4) and quality_of[5] == pytest.approx(0.75)  # halved for its one letter, then the mean with a Flesch ease over 100
    summary = {r["issue"]: r["n"] for r in text.issue_summary(text.quality_issues(df)).collect()}
    assert summary["too_short"] == 3
    grown = {r["doc_id"]: r["text"] for r in text.with_insertions(df, 2).collect()}
    assert grown[0] is None or grown[0] == ""
    assert grown[2] == "short" and len(grown[6].split(" ")) == len(rows[6][1].split(" ")) + 2 and set(grown[6].split(" ")) == set(rows[6][1].split(" "))
    empty = df.limit(0)
    assert text.quality_issues(empty).count() == text.text_quality(empty).count() == text.with_insertions(empty).count() == 0


def test_discriminants_part_classes(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(m, 1, (60, 3)) * [1, 5, 1] + [0, 0, 1e4] for m in ([0, 0, 0], [4, 0, 0], [0, 3, 0])])
    y = np.repeat([0, 1, 2], 60)
    df = spark.createDataFrame([(int(c), *map(float, v)) for c, v in zip(y, x, strict=True)] + [(0, None, 1.0, 1.0)], "y int, a double, b double, c double")
    got = features.discriminant(df, ["a", "b", "c"], "y", 5).toPandas()
    w = got.pivot(index="column_name", columns="axis", values="weight").to_numpy()
    within = sum(((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in range(3))) / (len(x) - 3)
    assert np.allclose(w.T @ within @ w, np.eye(2), atol=1e-6) and got.groupby("axis")["share"].first().sum() == pytest.approx(1.0)
    means = np.array([x[y == c].mean(0) for c in range(3)])
    between = (means - x.mean(0)).T @ (means - x.mean(0))
    assert np.allclose(w.T @ between @ w, np.diag(np.diag(w.T @ between @ w)), atol=1e-6)
    placed = features.discriminated(df.na.drop(), features.discriminant(df, ["a", "b", "c"], "y", 2))
    assert placed.count() == 180 and {"axis_1", "axis_2"} <= set(placed.columns)
    assert features.discriminant(df.where("y = 0"), ["a", "b"], "y").count() == features.discriminant(df.limit(0), ["a"], "y").count() == 0


def test_transformed_metrics_on_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, "a"), (2.0, 4.0, 5.0, None), (3.0, float("nan"), 5.0, "c")], "a double, b double, c double, s string")
    row = features.transformed_metrics(df).first()
    assert (row["missing_values"], row["columns_with_missing"], row["high_pairs"]) == (2, 2, 1) and row["mean_correlation"] == pytest.approx(0.5)
    assert features.transformed_metrics(df.limit(0)).first()["missing_ratio"] == 0.0 and features.transformed_metrics(df.select("s")).first()["high_pairs"] == 0


def test_criteria_agree_on_the_number_of_groups(spark):
    from tabulon.operators import groups

    choice = spark.createDataFrame([(2, 9.0, 0.5, False), (3, 2.0, 0.9, True), (4, 1.5, 0.4, False)], "k int, cost double, silhouette double, elbow boolean")
    gaps = spark.createDataFrame([(2, 0.9), (4, 0.1)], "k int, gap double")
    assert groups.agreed_k(choice) == groups.agreed_k(choice, gaps) == 3
    assert groups.agreed_k(choice.withColumn("silhouette", -F.col("silhouette")), gaps) == 3


def test_whole_jobs(spark):
    from tabulon.operators import models
    from tabulon.plans import pipelines

    df = spark.range(400).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.hash("id") % 100).cast("double").alias("b"), F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"))
    df = df.withColumn("y", 3 * F.col("a") + F.rand(1))
    made = pipelines.engineer(df.drop("id"), "y")
    assert "a" in made["data"].columns and made["scores"].count() >= 2 and made["metrics"].first()["n_rows"] == 400
    trained = pipelines.train(df, "y", ["a", "b"], "id")
    assert trained["metrics"].first()["r2"] > 0.9 and trained["baseline"].first()["improvement"] > 0.5
    told = pipelines.explain(models.fit(df, "y", ["a", "b"]), df, "y", ["a", "b"], "id")
    assert told["importance"].first()["feature"] == "a" and told["dependence"].count() == 10 and told["permutation"].count() == 2
    both = pipelines.ensemble(df, "y", ["a", "b"], "id", ["linear", "tree"])
    assert both["metrics"].count() == 3 and both["diversity"].count() == 1
    assert pipelines.automl(df, "y", "id")["models"].where("rank = 1").first()["test"] > 0.8
    assert pipelines.report(df)["insights"].where("rule = 'few_rows'").count() == 1


def test_correlations_beside_constants_are_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.0), (None, 5.0, 1.0)], "a double, b double, y double")
    found = {(r["column_a"], r["column_b"]): r["correlation"] for r in profile.correlation_pairs(df).collect()}
    assert found[("a", "b")] is None and found[("b", "y")] is None and found[("a", "y")] == pytest.approx(1.0)
    rows = {r["column_name"]: r["correlation"] for r in profile.target_correlation(df, "y").collect()}
    assert rows["b"] is None and rows["a"] == pytest.approx(1.0)
    assert metrics.spearman(df, "b", "y").first()["spearman"] is None
    assert clean.drop_correlated_columns(df).columns == ["a", "b"]
    assert profile.correlation_pairs(df.limit(0)).where("correlation IS NOT NULL").count() == 0
