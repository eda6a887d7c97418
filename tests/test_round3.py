"""Own pipeline stages, forests as tables, density groups of wide vectors, exact selection, biased factors and tests of series."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tabulon.functions import selection
from tabulon.operators import custom, density, drift, fitted, forest, groups, metrics, profile, recs, series, stages

# --- selection ---------------------------------------------------------------------------------------------------


def plain_quantile(values, p):
    v = sorted(values)
    place = p * (len(v) - 1)
    a, b = math.floor(place), math.ceil(place)
    return v[a] if v[a] == v[b] else (b - place) * v[a] + (place - a) * v[b]


@pytest.mark.parametrize("few", [2000, 3])
def test_quantiles_by_selection(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "SENT", 64)
    rnd = random.Random(1)
    columns = {
        "a": [rnd.gauss(0, 1) for _ in range(500)],
        "b": [rnd.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(500)],
        "c": [10.0 ** rnd.uniform(-300, 300) * rnd.choice([-1, 1]) for _ in range(500)],
        "d": [7.0] * 500,
        "e": [None if i % 3 else float(i) for i in range(500)],
        "f": [float("nan") if i % 2 else -1.7e308 + i for i in range(500)],
        "g": [None] * 500,
        "h": [1e15 + (i % 50) * 0.125 for i in range(500)],
    }
    rows = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(5)
    at = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    found = selection.exact_quantiles(rows, [F.col(c) for c in columns], at)
    for (name, values), got in zip(columns.items(), found, strict=True):
        known = [v for v in values if v is not None and v == v]
        want = [plain_quantile(known, p) if known else None for p in at]
        assert got == want, name
    assert selection.exact_quantiles(rows.limit(0), [F.col("a")], at) == [[None] * 6]
    assert selection.exact_quantiles(rows, [], at) == []


def test_order_statistics_of_one_value(spark):
    one = spark.createDataFrame([(4,)], "x int")
    assert selection.order_statistics(one, [F.col("x")], lambda n: [0]) == ([1], [{0: 4.0}])


# --- stages ------------------------------------------------------------------------------------------------------


def test_a_saved_pipeline_equals_the_fitted_one(spark, tmp_path):
    train = spark.createDataFrame([(None, "a", 1.0), (1.0, "a", 2.0), (3.0, "b", 3.0), (100.0, "c", 4.0), (float("nan"), None, 5.0)], "x double, c string, y double")
    plan = Pipeline(stages=[
        stages.Fill(inputCols=["x"], strategy="median"), stages.Clip(inputCols=["x"], lower=0.0, upper=0.75), stages.Scale(inputCols=["x"], outputCols=["z"], method="minmax"),
        stages.GroupRare(inputCols=["c"], threshold=0.3, other="rest"), stages.Encode(inputCols=["c"], outputCols=["k"], method="target", target="y", smoothing=0.0),
    ])
    plan.write().save(str(tmp_path / "plan"))
    model = Pipeline.load(str(tmp_path / "plan")).fit(train)
    model.write().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    new = spark.createDataFrame([(1, None, "a"), (2, 0.5, "b"), (3, 9.0, "new"), (4, 2.0, None)], "id int, x double, c string")
    rows = [sorted(map(tuple, m.transform(new).select("id", "x", "z", "c", "k").collect())) for m in (model, again)]
    assert rows[0] == rows[1] == [(1, 3.0, 1.0, "a", 1.5), (2, 1.0, 0.0, "rest", 3.5), (3, 3.0, 1.0, "new", 3.0), (4, 2.0, 0.5, None, None)]


def test_stages_of_empty_columns(spark):
    train = spark.createDataFrame([(None, None)], "x double, c string")
    model = Pipeline(stages=[stages.Fill(inputCols=["x"]), stages.Clip(inputCols=["x"]), stages.Scale(inputCols=["x"]), stages.GroupRare(inputCols=["c"]), stages.Encode(inputCols=["c"])]).fit(train)
    assert [tuple(r) for r in model.transform(spark.createDataFrame([(None, "v")], "x double, c string")).collect()] == [(None, 0.0)]
    with pytest.raises(ValueError, match="strategy"):
        stages.Fill(inputCols=["x"], strategy="mod").fit(train)
    with pytest.raises(ValueError, match="outputCols"):
        stages.Fill(inputCols=["x"], outputCols=["a", "b"]).fit(train).transform(train)


def test_own_functions_are_stages(spark, tmp_path):
    @stages.transformer("test_double")
    def double(df, column):
        return df.withColumn(column, F.col(column) * 2)

    model = Pipeline(stages=[stages.Apply(function="test_double", options={"column": "id"}), stages.Rules(rules=[{"type": "combination", "features": ["id", "id"], "operation": "sum", "name": "s"}])]).fit(spark.range(1))
    model.write().save(str(tmp_path / "m"))
    assert [tuple(r) for r in PipelineModel.load(str(tmp_path / "m")).transform(spark.range(3)).orderBy("id").collect()] == [(0, 0.0), (2, 4.0), (4, 8.0)]
    with pytest.raises(ValueError, match="twice"):
        stages.transformer("test_double")(lambda df: df)
    with pytest.raises(ValueError, match="registered"):
        stages.Apply(function="nothing").transform(spark.range(1))


def test_own_metrics_and_expanders(spark):
    rows = spark.createDataFrame([(1.0, 2.0, "a"), (4.0, 3.0, "a"), (5.0, None, "b")], "y double, p double, g string")
    got = {(r["metric"], r["value"], r["n"]) for r in custom.evaluate(rows, "y", "p", ["mae", ("within", {"share": 0.5})]).collect()}
    assert got == {("mae", 1.0, 2), ("within(share=0.5)", 0.5, 2)}
    assert [r["n"] for r in custom.evaluate(rows.limit(0), "y", "p", ["mae"]).collect()] == [0]
    with pytest.raises(ValueError, match="registered"):
        custom.evaluate(rows, "y", "p", ["nothing"])
    texts = spark.createDataFrame([(1, "One. Two!? "), (2, None), (3, "..."), (4, "no end")], "id int, text string")
    assert sorted(map(tuple, custom.expand(texts, "sentences", "text", keep=["id"]).collect())) == [(1, 0, "One"), (1, 1, "Two"), (4, 0, "no end")]
    items = spark.createDataFrame([(1, '{"a": 1, "b": {"c": [null]}, "d": "x"}'), (2, "[1]"), (3, "{"), (4, None)], "id int, t string")
    assert sorted(map(tuple, custom.expand(items, "json_items", "t", keep=["id"]).collect())) == [(1, "a", "1"), (1, "b", '{"c": [null]}'), (1, "d", "x")]


# --- forests -----------------------------------------------------------------------------------------------------


def blob(spark, n=400):
    rnd = random.Random(3)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(n)] + [(n, 9.0, 9.0), (n + 1, -8.0, 7.0)]
    return spark.createDataFrame(rows, "id long, x double, y double")


def test_a_saved_forest_scores_new_rows_as_at_once(spark, tmp_path):
    rows = blob(spark)
    nodes = forest.fit_forest(rows.repartition(7), ["x", "y"], "id", trees=20, sample=64)
    assert sorted(map(str, nodes.collect())) == sorted(map(str, forest.fit_forest(rows.repartition(2), ["x", "y"], "id", trees=20, sample=64).collect()))
    fitted.save(nodes, str(tmp_path / "f"))
    again = spark.read.parquet(str(tmp_path / "f"))
    once = {r["id"]: r["score"] for r in forest.forest_scores(rows, nodes).collect()}
    later = {r["id"]: r["score"] for r in forest.forest_scores(rows.where("id % 2 = 0").withColumn("score", F.lit("x")), again).collect()}
    assert all(once[i] == s for i, s in later.items()) and len(later) == 201
    assert {i for i, _ in sorted(once.items(), key=lambda kv: -kv[1])[:2]} == {400, 401} and all(0 < s < 1 for s in once.values())
    held = [r.asDict() for r in nodes.collect()]
    by_tree = {}
    for r in held:
        by_tree.setdefault(r["tree"], {})[r["node"]] = r
    for row in rows.limit(30).collect():
        total = 0.0
        for tree in by_tree.values():
            at = tree[0]
            while at["column_name"]:
                at = tree[at["left"] if row[at["column_name"]] <= at["cut"] else at["right"]]
            total += at["length"]
        assert abs(once[row["id"]] - 2 ** (-total / len(by_tree) / forest.average_path(64))) < 1e-12


def test_forests_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 1.0), (None, 5.0), (4, None), (5, float("nan"))], "id long, x double")
    nodes = forest.fit_forest(rows, ["x"], "id", trees=2)
    assert {(r["drawn"], r["column_name"], r["length"]) for r in nodes.collect()} == {(2, None, 1.0)}
    assert forest.forest_scores(rows, nodes).count() == 5
    none = forest.fit_forest(rows.limit(0), ["x"], "id")
    assert none.count() == 0 and {r["score"] for r in forest.forest_scores(rows, none).collect()} == {None}


# --- density -----------------------------------------------------------------------------------------------------


def plain_density(x, eps, least):
    """Clusters by the definition; keys are places."""
    close = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = close.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(close & core[None, :], label[None, :], len(x)).min(axis=1), label)
        if (new == label).all():
            break
        label = new
    edge = np.where(close & core[None, :], label[None, :], len(x)).min(axis=1)
    return np.where(edge == len(x), -1, edge), close & core[None, :] & core[:, None]


def wide(seed, n=600, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 4
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * 0.5
    x[: n // 10] = rng.normal(size=(n // 10, dims)) * 6
    x[n // 2 : n // 2 + n // 3] = x[n // 2]  # a third of all rows are the same
    return x


@pytest.mark.parametrize("crowd", [1500, 40])
def test_density_groups_of_wide_vectors(spark, crowd):
    x = wide(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 64)], "id long, v array<double>")
    want, _ = plain_density(x, 5.5, 4)
    got = {r["id"]: r["cluster"] for r in density.density_groups(rows, "id", ["v"], 5.5, 4, crowd=crowd).collect()}
    assert set(got) == set(range(len(x))) and len(set(want)) > 5
    assert np.mean([got[i] == w for i, w in enumerate(want)]) >= 0.99


def test_recall_of_links_is_as_stated(spark):
    """Pairs at no more than ``eps`` that share a bucket, of all such pairs."""
    x = wide(2)
    rows = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "c long, m long, x array<double>")
    codes = np.array([r["codes"] for r in density._codes(rows, 64, 5.5, 12, 3, 4.0, 1).orderBy("c").collect()])
    _, links = plain_density(x, 5.5, 4)
    met = (codes[:, None, :] == codes[None, :, :]).any(axis=2)
    assert (met & links).sum() / links.sum() >= 0.99
    assert met.mean() < 0.9  # and yet not all pairs are compared


def test_few_columns_keep_the_grid(spark):
    rnd = random.Random(8)
    x = np.array([[rnd.gauss(0, 1), rnd.gauss(0, 1)] for _ in range(150)])
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    want, _ = plain_density(x, 0.25, 4)
    for found in (groups.density_groups(rows, "id", ["a", "b"], 0.25, 4), density.density_groups(rows, "id", ["a", "b"], 0.25, 4)):
        assert {r["id"]: r["cluster"] for r in found.collect()} == dict(enumerate(want.tolist()))
    assert density.density_groups(rows.limit(0), "id", ["a", "b"], 0.25).count() == 0


# --- ratings -----------------------------------------------------------------------------------------------------


def test_biased_factors_beat_unbiased_ones(spark):
    rng = np.random.default_rng(4)
    user, item = rng.normal(size=60) * 1.5, rng.normal(size=40) * 1.5
    p, q = rng.normal(size=(60, 2)), rng.normal(size=(40, 2))
    rows = [(u, i, float(50 + user[u] + item[i] + p[u] @ q[i] * 0.5 + rng.normal() * 0.2)) for u in range(60) for i in range(40) if rng.random() < 0.5]
    ratings = spark.createDataFrame(rows, "user long, item long, rating double")
    held = (F.col("user") + F.col("item")) % 4 == 0
    train, test = ratings.where(~held), ratings.where(held)
    error = lambda scores: test.join(scores, ["user", "item"]).agg(F.sqrt(F.avg((F.col("rating") - F.col("score")) ** 2))).first()[0]
    biased = error(recs.factorise_biased(train, test, rank=2, rounds=8, regularisation=0.05, damping=1.0))
    only = error(recs.biased_scores(test.select("user", "item"), *recs.biases(train, damping=1.0)))
    unbiased = error(recs.factorise_biased(train, test, rank=2, rounds=8, regularisation=0.05, bias_rounds=0))
    assert biased < only and biased < unbiased
    new = spark.createDataFrame([(999, 999)], "user long, item long")
    assert abs(recs.factorise_biased(train, new, rank=2).first()["score"] - train.agg(F.avg("rating")).first()[0]) < 1e-9


# --- curves and series -------------------------------------------------------------------------------------------


def test_class_curves_by_pairs(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("abc"), *[rnd.choice([0.1, 0.2, 0.5, 0.9]) for _ in range(3)]) for _ in range(200)] + [(None, 0.1, 0.1, 0.1), ("a", None, 0.5, float("nan"))]
    df = spark.createDataFrame(rows, "y string, a double, b double, c double").repartition(5)
    got = {r["class"]: r for r in metrics.class_curves(df, "y", {"a": "a", "b": "b", "c": "c", "none": "a"}).collect()}
    for k, c in enumerate("abc"):
        known = [(r[0] == c, r[k + 1]) for r in rows if r[0] is not None and r[k + 1] is not None and r[k + 1] == r[k + 1]]
        up, down = [s for y, s in known if y], [s for y, s in known if not y]
        area = sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down)
        assert abs(got[c]["roc_auc"] - area) < 1e-12 and got[c]["n"] == len(known)
        assert abs(got[c]["brier"] - statistics.mean((y - s) ** 2 for y, s in known)) < 1e-12
    assert got["none"]["roc_auc"] is None and got["none"]["positives"] == 0
    bins = metrics.calibration(df, "y", {"a": "a"}, 5).collect()
    assert sum(r["n"] for r in bins) == 200 and len({r["error"] for r in bins}) == 1


def plain_adf(y, p):
    d = np.diff(y)
    x = np.array([[1.0, y[t], *[d[t - k] for k in range(1, p + 1)]] for t in range(p, len(d))])
    b, rest = np.linalg.lstsq(x, d[p:], rcond=None)[:2]
    s = float(((d[p:] - x @ b) ** 2).sum()) / (len(x) - p - 2)
    return b[1] / math.sqrt(s * np.linalg.inv(x.T @ x)[1, 1]), len(x)


def test_unit_root_tests(spark):
    rng = np.random.default_rng(9)
    walk, noise = np.cumsum(rng.normal(size=300)), rng.normal(size=300)
    for t in range(2, 300):
        noise[t] += 0.5 * noise[t - 1] - 0.3 * noise[t - 2]
    rows = [("walk", i, float(v)) for i, v in enumerate(walk)] + [("noise", i, float(v) + 1e6) for i, v in enumerate(noise)] + [("flat", i, 1.0) for i in range(30)] + [("short", 0, 1.0), ("short", 1, 2.0)]
    df = spark.createDataFrame(rows, "series string, ts int, y double")
    got = {r["series"]: r for r in series.adf(df, lags=3).collect()}
    for name, y in (("walk", walk), ("noise", noise)):
        t, n = plain_adf(y, 3)
        assert abs(got[name]["adf"] - t) < 1e-6 and got[name]["n"] == n
    assert got["noise"]["stationary"] and not got["walk"]["stationary"] and got["flat"]["adf"] is None and got["short"]["adf"] is None
    chosen = {r["series"]: r for r in series.adf(df).collect()}
    assert 1 <= chosen["noise"]["lags"] <= 12 and abs(chosen["noise"]["adf"] - plain_adf(noise, chosen["noise"]["lags"])[0]) < 1e-6
    level = {r["series"]: r for r in series.kpss(df).collect()}
    assert level["noise"]["stationary"] and not level["walk"]["stationary"] and level["walk"]["p_value"] == 0.01 and level["flat"]["kpss"] is None
    trend = {r["series"]: r for r in series.trend_test(df).collect()}
    assert trend["noise"]["p_value"] > 0.01 and trend["walk"]["t"] is not None and trend["short"]["t"] is None


def test_drift_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=500).round(2), rng.normal(0.3, 1, 400).round(2)
    left, right = (spark.createDataFrame([(float(v), float(v) * 2) for v in x], "x double, y double") for x in (a, b))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ks = {r["feature"]: r["ks"] for r in drift.ks(left, right).collect()}
        distance = {r["feature"]: r["wasserstein"] for r in drift.wasserstein(left, right).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    every = np.unique(np.r_[a, b])
    at = lambda x: np.searchsorted(np.sort(x), every, side="right") / len(x)
    assert abs(ks["x"] - np.abs(at(a) - at(b)).max()) < 1e-12 and abs(ks["x"] - ks["y"]) < 1e-12
    scaled = [np.clip((x - a.min()) / (a.max() - a.min()), 0, 1) for x in (a, b)]
    grid = np.unique(np.r_[scaled[0], scaled[1]])
    gap = [np.searchsorted(np.sort(x), grid, side="right") / len(x) for x in scaled]
    assert abs(distance["x"] - float((np.abs(gap[0] - gap[1])[:-1] * np.diff(grid)).sum())) < 1e-9


def test_types_by_distinct_texts(spark):
    rows = spark.createDataFrame([("1", "a@b.org", "2024-01-01", "yes", None)] * 9 + [("x", "a@c.org", "2024-01-02", "no", None)], "n string, m string, d string, b string, z string")
    got = {r["column_name"]: r["logical_type"] for r in profile.column_types(rows).collect()}
    assert got == {"n": "numeric", "m": "text", "d": "datetime", "b": "boolean", "z": "text"}
