"""Whole jobs: heavy groups, copies and lonely rows against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tabulon.operators import groups, models, recs, text
from tabulon.plans import catalog
from tabulon.streaming import streams


def test_similarity_keeps_items_with_many_users(spark):
    rng = np.random.default_rng(3)
    dense = np.zeros((620, 12))
    dense[:, 0] = rng.integers(1, 9, 620)  # one item that all users rated
    for u in range(620):
        dense[u, rng.integers(1, 12, 3)] = rng.integers(1, 9)
    ratings = spark.createDataFrame([(int(u), int(i), float(dense[u, i])) for u, i in zip(*np.nonzero(dense))], "user int, item int, rating double")
    got = recs.similarity(ratings, "user", "pearson", neighbours=1000).toPandas()
    want = np.corrcoef(dense)
    assert len(got) == 620 * 619
    assert np.allclose(got["similarity"], want[got["a"], got["b"]], atol=1e-9)
    assert recs.top_n(recs.predict_users(ratings, recs.similarity(ratings, "user", neighbours=10)), ratings, 5).count() > 0


def test_rules_keep_large_baskets(spark):
    rows = spark.range(1100).select(F.lit(1).alias("k"), F.col("id").alias("x")).union(spark.range(3).select(F.lit(2).alias("k"), F.col("id").alias("x")))
    got = recs.pair_rules(rows, "k", "x")
    assert got.count() == 1100 * 1099
    assert got.where("a = 0 AND b = 1").first()["n"] == 2


def test_queries_without_twin_see_every_part(spark):
    assert catalog.QUERIES["recs_topn"](spark, "/root/testdata/sf0.01").where("item >= 200").count() > 0


def test_content_neighbours_of_any_shared_attribute(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"b{rng.integers(0, 6)}", f"t{rng.integers(0, 4)}" if i % 9 else None, int(rng.integers(0, 8))) for i in range(150)] + [(150, "alone", "t1", 3), (151, None, None, 99)] + [(i, "b0", "t0", 0) for i in range(152, 190)]
    got = sorted(map(tuple, recs.content_similarity(spark.createDataFrame(rows, "item int, brand string, type string, size int"), ["brand", "type", "size"], neighbours=5).collect()))
    want = []
    for a in rows:
        near = sorted((-sum(x is not None and x == y for x, y in zip(a[1:], b[1:])) / 3, b[0]) for b in rows if b is not a)
        want += [(a[0], b, -s) for s, b in near[:5] if s < 0]
    assert got == sorted(want) and any(a == 150 for a, _, _ in got)


def test_trees_draw_rows_not_values(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5.0).otherwise(100 + F.col("id") * 7919 % 3000 / 10).alias("x"))
    score = {r["k"]: r["s"] for r in groups.isolation_scores(df, ["x"], trees=20, key="id").groupBy((F.col("x") == 5).alias("k")).agg(F.avg("score").alias("s")).collect()}
    assert score[True] < 0.5  # a third of the rows is no anomaly


def test_alerts_are_sent_in_order_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(400).select((F.col("id") % 3).cast("string").alias("key"), F.timestamp_seconds(F.col("id") * 7919 % 400 * 900).alias("ts"), F.lit(1.0).alias("score"))
        got = streams.limited_alerts(df, cooldown_seconds=3600, daily=5)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        want = []
        for key in range(3):
            last, day, n = -1e18, -1, 0
            for t in sorted(i * 7919 % 400 * 900 for i in range(400) if i % 3 == key):
                if t // 86400 != day:
                    day, n = t // 86400, 0
                if t - last >= 3600 and n < 5:
                    want.append((str(key), t))
                    last, n = t, n + 1
        assert sorted((r["key"], r["t"]) for r in got.select("key", F.unix_timestamp("ts").alias("t")).collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_similar_documents_in_large_groups(spark):
    rng = np.random.default_rng(1)
    near = [(i, " ".join([f"w{j}" for j in range(40)] + [f"x{i % 120}", f"y{i % 7}"])) for i in range(240)]
    other = [(i, " ".join(f"z{j}" for j in rng.integers(0, 60, 12))) for i in range(240, 360)]
    df = spark.createDataFrame(near + other, "doc_id long, text string")
    w = text.tf_idf(df).toPandas().pivot(index="doc_id", columns="term", values="weight").fillna(0.0)
    cosine = w.to_numpy() @ w.to_numpy().T
    for docs, k in ((df, 20), (df, 400)):
        got = [(r["doc_a"], r["doc_b"], round(r["similarity"], 6)) for r in text.similar_documents(docs, k=k).collect()]
        a, b = np.triu_indices(len(w), 1)
        want = sorted((-round(float(cosine[i, j]), 6), int(w.index[i]), int(w.index[j])) for i, j in zip(a, b) if cosine[i, j] > 0.7)[:k]
        assert got == [(i, j, -s) for s, i, j in want] and len(got) == k


def test_outlier_factor_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (90, 2)), rng.normal(0, 0.001, (60, 2)), np.tile([[3.0, 3.0]], (30, 1)), np.tile([[-2.0, 5.0]], (3, 1)), [[900.0, -50.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    got = groups.local_outlier_factor(df, "id", ["a", "b"], 5).toPandas().set_index("id")["lof"].sort_index().to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = [[j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:5] for i in range(len(x))]
    reach = np.array([d[i, near[i][-1]] for i in range(len(x))])
    lrd = np.array([1 / np.mean([max(d[i, j], reach[j], 1e-9) for j in near[i]]) for i in range(len(x))])
    want = np.array([lrd[near[i]].mean() / lrd[i] for i in range(len(x))])
    assert np.allclose(got, want, rtol=1e-9) and got.argmax() == len(x) - 1


def test_partial_dependence_uses_all_rows(spark):
    class Model:
        def transform(self, df):
            return df.withColumn("prediction", F.col("x") + F.col("z"))

    df = spark.range(1000).select("id", (F.col("id") % 101).cast("double").alias("x"), (F.col("id") * F.col("id")).cast("double").alias("z"))
    got = models.partial_dependence(Model(), df, "x", "id", 3).collect()
    assert len(got) == 3 and all(abs(r["prediction"] - r["value"] - 332833.5) < 1e-6 for r in got)
