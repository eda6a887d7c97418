"""What the findings of round 3 asked for, in small."""

import re
from collections import Counter
from functools import partial

import numpy as np
from pyspark.sql import functions as F

from tabulon.operators import insights, languages, recs, series
from tabulon.plans.catalog import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_deployment_keeps_its_keys_without_a_join(spark):
    rows = spark.createDataFrame([("a", 0.8), ("b", 0.8), ("c", 0.2)], "event_type string, score double")
    got = {r["event_type"]: (r["risk"], r["expected_saving"]) for r in insights.deployment(rows, saving=10.0, volume=100.0, keys=("event_type",)).collect()}
    assert got == {"a": ("medium", 800.0), "b": ("medium", 800.0), "c": ("high", 200.0)}
    assert "Join" not in _plan(QUERIES["event_deployment"](spark, "/root/testdata/sf0.001"))  # sums of two runs needn't be equal


def test_autoregression_at_a_high_level(spark):
    rng = np.random.default_rng(1)
    y = [0.0]
    for e in rng.normal(size=59):
        y.append(0.5 * y[-1] + e)
    y = 1e8 + np.array(y)
    rows = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "series string, ts long, y double")
    c = series.autoregression(rows, 1).first()
    z = y - y.mean()
    slope, intercept = np.polyfit(z[:-1], z[1:], 1)
    assert c["n"] == 59 and abs(c["coefficients"][1] - slope) < 1e-6
    fitted = c["coefficients"][0] + c["coefficients"][1] * y[:-1]
    assert np.abs(fitted - (intercept + slope * z[:-1] + y.mean())).max() < 1e-4
    assert abs(c["sigma"] - np.sqrt(((y[1:] - fitted) ** 2).sum() / 57)) < 1e-4
    ahead = series.autoregressive_forecast(series.autoregression(rows, 1), 1).first()["forecast"]
    assert abs(ahead - (c["coefficients"][0] + c["coefficients"][1] * y[-1])) < 1e-4
    flat = series.autoregression(rows.withColumn("y", F.lit(7.0)), 2).first()
    assert abs(flat["coefficients"][0] + 7 * sum(flat["coefficients"][1:]) - 7) < 1e-9


def test_languages_keep_a_texts_ngrams_in_its_row(spark):
    rows = [(1, "en", "The old house, the OLD mill — an old man's hat"), (2, "de", "Das alte Haus und die alte Mühle"), (3, "en", "123"), (4, "de", None), (5, None, " ,ß, ")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    profiles = languages.fit_languages(docs, ranks=20)
    profiles = spark.createDataFrame(profiles.collect(), profiles.schema)
    found = languages.detect_languages(docs, profiles, ranks=20)
    assert not re.search(r"Aggregate \[[^\]]*gram", _plan(found))
    letters = lambda t: [f"_{w}_" for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
    grams = lambda t: Counter(w[i : i + k] for w in letters(t) for k in (1, 2, 3) for i in range(len(w) - k + 1) if w[i : i + k] != "_")
    ranked = lambda n: {g: i for i, (g, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:20], 1)}
    known = {lang: ranked(sum((grams(t) for _, of, t in rows if of == lang), Counter())) for lang in ("de", "en")}
    for r in found.collect():
        own = ranked(grams(dict((i, t) for i, _, t in rows)[r["doc_id"]]))
        near = sorted((1 - sum(max(0, 20 - abs(k - to[g])) for g, k in own.items() if g in to) / (len(own) * 20), lang) for lang, to in known.items() if set(own) & set(to))
        assert (r["language"] is None) == (not near)
        if near:
            assert r["language"] == near[0][1] and abs(r["distance"] - near[0][0]) < 1e-12


def test_pairs_are_met_in_ranges_and_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = np.where(rng.random((40, 25)) < 0.3, rng.integers(1, 6, (40, 25)), 0).astype(float)
    rows = spark.createDataFrame([(int(u), int(i), float(m[u, i])) for u, i in zip(*np.nonzero(m), strict=True)], "user long, item long, rating double")
    norms, dots = (m * m).sum(axis=0), m.T @ m
    shared = ((m > 0).T.astype(int) @ (m > 0)) > 0
    want = {(a, b): dots[a, b] / np.sqrt(norms[a] * norms[b]) for a in range(25) for b in range(25) if a != b and shared[a, b]}
    with_blocks = recs._met
    for block, chunk in ((recs.BLOCK, recs.CHUNK), (300, 50)):
        monkeypatch.setattr(recs, "_met", partial(with_blocks, block=block, chunk=chunk))
        found = recs.similarity(rows, neighbours=None)
        assert not re.search(r"(Join|Aggregate).*\n?.*dot", _plan(found))
        got = {(r["a"], r["b"]): r["similarity"] for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        best = recs.similarity(rows, neighbours=3).collect()
        for a in range(25):
            order = sorted((-round(got[k], 12), k[1]) for k in want if k[0] == a)[:3]
            assert sorted(r["b"] for r in best if r["a"] == a) == sorted(b for _, b in order)
        rules = {(r["a"], r["b"]): r["n"] for r in recs.pair_rules(rows, "user", "item").collect()}
        assert rules == {k: int(((m[:, k[0]] > 0) & (m[:, k[1]] > 0)).sum()) for k in want}
    shuffled = rows.select("user", "item", F.lit(0.5).alias("score"))
    assert recs.top_n(shuffled, rows, 3).count() == 0
    half = rows.where("item % 2 = 0")
    top = {(r["user"], r["item"]) for r in recs.top_n(rows.select("user", "item", F.col("rating").alias("score")), half, 3).collect()}
    assert top == {(u, i) for u in range(40) for i in sorted((i for i in range(1, 25, 2) if m[u, i] > 0), key=lambda i: (-m[u, i], i))[:3]}


def test_scores_move_lists_and_not_their_rows(spark):
    ratings = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(12) for i in range(9) if (u + i) % 3], "user long, item long, rating double")
    near = {(r["a"], r["b"]): r["similarity"] for r in recs.similarity(ratings, neighbours=None).collect()}
    rated = {}
    for r in ratings.collect():
        rated.setdefault(r["user"], {})[r["item"]] = r["rating"]
    got = {(r["user"], r["item"]): r["score"] for r in recs.predict_items(ratings, recs.similarity(ratings, neighbours=None), k=2).collect()}
    for (u, c), score in got.items():
        best = sorted((-near[i, c], i) for i in rated[u] if (i, c) in near)[:2]
        assert abs(score - sum(-s * rated[u][i] for s, i in best) / sum(-s for s, _ in best)) < 1e-9
