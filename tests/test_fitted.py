"""What is fitted once, saved and applied to other rows, and further operators on small tables."""

import math

from pyspark.sql import functions as F

from tabulon.operators import features, fitted, groups, models, profile, series, text


def test_numbers_and_codes_are_saved_and_applied(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "a", 1.0), (3.0, "a", 2.0), (None, "b", 3.0), (5.0, None, 6.0)], "x double, c string, y double")
    fitted.save(fitted.fit_numbers(train, ["x"]), str(tmp_path / "n"))
    fitted.save(fitted.fit_codes(train, ["c"], "target", "y", smoothing=0.0), str(tmp_path / "c"))
    new = spark.createDataFrame([(3.0, "a"), (None, "zz"), (float(3 + math.sqrt(2)), None)], "x double, c string")
    out = fitted.apply_codes(fitted.apply_numbers(new, spark.read.parquet(str(tmp_path / "n"))), spark.read.parquet(str(tmp_path / "c")), ["c"])
    got = sorted((round(r["x"], 6), r["c"], r["c_code"]) for r in out.collect())
    assert sorted(got, key=str) == sorted([(0.0, "a", 1.5), (0.0, "zz", 3.0), (1.0, None, None)], key=str)
    order = {r["value"]: r["code"] for r in fitted.fit_codes(train, ["c"], "order").collect()}
    assert order == {"a": 0.0, "b": 1.0, None: -1.0}


def test_a_saved_model_scores_files(spark, tmp_path):
    rows = spark.range(200).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"), (F.col("id") > 100).cast("double").alias("c"))
    rows.write.parquet(str(tmp_path / "in"))
    models.save(models.fit(rows, "y", ["x"]), str(tmp_path / "m"))
    report = models.scoring_job(spark, str(tmp_path / "in"), str(tmp_path / "m"), str(tmp_path / "out"), key="id").first()
    assert report["rows"] == 200 and report["nulls"] == 0 and abs(report["mean"] - 200.0) < 1e-6
    chances = models.probabilities(models.fit(rows, "c", ["x"], "tree", "classification"), rows, "id")
    assert chances.count() == 400 and chances.groupBy("id").agg(F.sum("probability").alias("p")).where("abs(p - 1) > 1e-9").count() == 0
    mlp = models.fit(rows, "c", ["x"], "mlp", "classification", layers=[1, 3, 2], maxIter=5, seed=1)
    assert models.score(mlp, rows).count() == 200
    found = models.random_search(rows, "y", ["x"], {"regParam": (0.0, 1.0)}, tries=2, folds=2)
    assert found.count() == 2 and found.where("best").count() == 1


def test_folds_keep_groups_together(spark):
    rows = features.repeated_folds(spark.range(300).withColumn("g", F.col("id") % 30), "g", 4, 2)
    for c in ("fold_0", "fold_1"):
        assert rows.groupBy("g").agg(F.count_distinct(c).alias("n")).where("n > 1").count() == 0


def test_power_transforms_find_the_peak(spark):
    rows = spark.range(1, 2000).select((F.exp(features.probit((F.col("id") - 0.5) / 1999)) * 10).alias("x"))
    out = features.power_transform(rows, "x", "z", method="box-cox")
    assert abs(out.agg(F.skewness("z")).first()[0]) < 0.01  # the log of a log-normal is normal


def test_probit(spark):
    got = spark.range(1).select(*[features.probit(F.lit(p)).alias(str(i)) for i, p in enumerate((0.5, 0.975, 0.001, 0.999))]).first()
    assert all(abs(a - b) < 1e-6 for a, b in zip(got, (0.0, 1.959963985, -3.090232306, 3.090232306), strict=True))


def test_fingerprint_counts_repeated_rows(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    content = lambda df: profile.fingerprint(df).first()["content"]
    assert content(one) != content(one.union(one).union(one)) and content(one) == content(one.orderBy(F.desc("k")))


def test_series_are_scaled_back_and_forecast(spark):
    rows = spark.range(40).select(F.lit("s").alias("series"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp").alias("ts"), F.pow(F.lit(0.9), "id").alias("y"))
    model = series.autoregression(rows, 1)
    c = model.first()["coefficients"]
    assert abs(c[0]) < 1e-6 and abs(c[1] - 0.9) < 1e-6
    ahead = [r["forecast"] for r in series.autoregressive_forecast(model, 2).orderBy("h").collect()]
    assert all(abs(a - 0.9 ** (40 + i)) < 1e-6 for i, a in enumerate(ahead))
    assert series.autoregression(rows.limit(2), 3).first()["coefficients"] is None


def test_synonyms_and_ngrams(spark):
    docs = spark.createDataFrame([(1, "a big dog"), (2, ""), (3, None)], "doc_id long, text string")
    new = text.with_synonyms(docs, spark.createDataFrame([("big", "large")], "term string, synonym string"), share=1.0)
    assert {r["doc_id"]: r["text"] for r in new.collect()} == {1: "a large dog", 2: "", 3: None}
    assert {r["term"] for r in text.ngrams(docs).collect()} == {"a", "big", "dog", "a big", "big dog"}


def test_graph_groups_part_two_cliques(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(base, base + 5) if a < b] + [(0, 10, 0.01)]
    found = {r["id"]: r["cluster"] for r in groups.graph_groups(spark.createDataFrame(edges, "a long, b long, similarity double"), 2, rounds=20).collect()}
    assert len(found) == 10
