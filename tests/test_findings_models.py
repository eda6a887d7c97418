"""Models and their errors at size: quantiles by selection, trees on groups of equal rows."""

import math

import numpy as np
import pytest

from tabulon.operators import metrics, models


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.fixture(scope="module")
def errors(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b)) for a, b in zip(rng.normal(size=5000) * 10, rng.normal(size=5000), strict=True)] + [(None, 1.0), (2.0, None)]
    return spark.createDataFrame(rows, "y double, p double").cache()


def test_errors_are_selected_without_a_map_of_values(spark, errors):
    e = np.array([r["y"] - r["p"] for r in errors.na.drop().collect()])
    got = metrics.regression(errors, "y", "p")
    assert "percentile(" not in _plan(got) and "median(" not in _plan(got)
    row = got.first()
    assert row["n"] == 5000 and row["median_error"] == pytest.approx(np.median(abs(e)), rel=1e-14) and row["mse"] == pytest.approx((e * e).mean())
    found = metrics.residuals(errors, "y", "p")
    assert "percentile(" not in _plan(found)
    q1, q3 = np.percentile(e, [25, 75])
    assert found.first()["outlier_percent"] == pytest.approx(100 * np.mean((e < q1 - 1.5 * (q3 - q1)) | (e > q3 + 1.5 * (q3 - q1))))
    assert found.first()["std"] == pytest.approx(e.std())


def test_errors_of_few_infinite_and_no_rows(spark):
    odd = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (3.0, float("inf"))], "y double, p double")
    assert metrics.regression(odd, "y", "p").first()["median_error"] == 2.0
    none = odd.limit(0)
    assert metrics.regression(none, "y", "p").first()["median_error"] is None and metrics.residuals(none, "y", "p").first()["mean"] is None
    assert metrics.residuals(odd.limit(1), "y", "p").first()["outlier_percent"] == 0.0


@pytest.mark.parametrize("name, options", [("tree", {"maxDepth": 4}), ("boosted", {"maxIter": 3, "seed": 1})])
def test_trees_on_groups_are_those_on_rows(spark, name, options):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 12, 3000), rng.integers(0, 7, 3000)
    rows = spark.createDataFrame([(int(i), float(x), float(z), float(x * z + rng.normal() * 5)) for i, (x, z) in enumerate(zip(a, b, strict=True))] + [(9000, 1.0, 1.0, None)], "id long, a double, b double, y double")
    plain, grouped = (models.score(f(rows, "y", ["a", "b"], name, **options), rows) for f in (models.fit, models.fit_grouped))
    want = {r["id"]: r["prediction"] for r in plain.collect()}
    got = {r["id"]: r["prediction"] for r in grouped.collect()}
    assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want)
    with pytest.raises(ValueError):
        models.fit_grouped(rows, "y", ["a", "b"], "forest")


def test_compared_models_read_one_stored_split(spark, monkeypatch):
    from tabulon.operators import features
    from tabulon.plans import pipelines

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(400).selectExpr("id AS key", "cast(id % 13 AS double) AS a", "cast(3 * (id % 13) + id % 5 AS double) AS y").mapInArrow(seen, "key long, a double, y double")
    got = {r["model"]: r["test"] for r in models.compare(rows, "y", ["a"], "key", ["linear", "tree"]).collect()}
    assert made.value == 400
    parts = features.split(rows, "key", test=0.25)
    for name, r2 in got.items():
        out = models.score(models.fit(parts.where("part = 'train'"), "y", ["a"], name), parts.where("part = 'test'"))
        assert metrics.regression(out, "y", "prediction").first()["r2"] == pytest.approx(r2, rel=1e-12)
    before = made.value
    assert pipelines.ensemble(rows, "y", ["a"], "key", ["linear", "tree"])["metrics"].count() == 3
    assert made.value == before + 400
