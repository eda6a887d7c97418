"""Pairs of ratings that are sent compactly, and scores of similar users in their range."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import recs


@pytest.fixture(scope="module")
def ratings(spark):
    rows = [(u, i, float(1 + (u * 7 + i * 3) % 5)) for u in range(40) for i in range(30) if (u * u + 3 * i + u * i) % 4 == 0]
    return spark.createDataFrame(rows, "user long, item long, rating double").cache()


def _met_rows(monkeypatch):
    seen, plain = [], recs._met
    monkeypatch.setattr(recs, "_met", lambda rows, *a, **b: (seen.append((rows, b)), plain(rows, *a, **b))[1])
    return seen


def test_items_below_the_support_are_not_paired(spark, monkeypatch):
    seen = _met_rows(monkeypatch)
    rows = spark.createDataFrame([(k, x) for k in range(20) for x in range(12) if k % (x + 1) == 0] + [(None, 0), (3, None)], "k long, x long")
    every = {(r["a"], r["b"]): tuple(r) for r in recs.pair_rules(rows, "k", "x").collect()}
    got = {(r["a"], r["b"]): tuple(r) for r in recs.pair_rules(rows, "k", "x", least_support=0.2).collect()}
    assert got == {p: r for p, r in every.items() if r[3] >= 0.2} and len(got) < len(every)
    assert {r["x"] for r in seen[1][0].select("x").distinct().collect()} == {x for x in range(12) if len(range(0, 20, x + 1)) / 20 >= 0.2}
    assert seen[1][1]["needs"] == ()


def test_lists_hold_the_shortest_exact_types(spark):
    rows = spark.createDataFrame([(1, 5, 2.0, 0.1), (70000, None, 0.5, 0.2)], "a long, b long, c double, d double")
    short = rows.select(*[c.alias(n) for n, c in recs._narrow(rows, ["a", "b", "c", "d"]).items()])
    assert [t for _, t in short.dtypes] == ["int", "smallint", "float", "double"]
    assert sorted(map(tuple, short.collect())) == sorted([(1, 5, 2.0, 0.1), (70000, None, 0.5, 0.2)])


@pytest.mark.parametrize("block", [recs.BLOCK, 300])
def test_similarities_are_summed_where_they_are_made(ratings, monkeypatch, block):
    monkeypatch.setattr(recs, "BLOCK", block)
    want = ratings.transform(recs.similarity, neighbours=None).groupBy("a").agg(F.count("*").alias("n"), F.max("similarity").alias("best"), F.sum("similarity").alias("total"))
    got = recs.similarity(ratings, totals=True).select("a", "n", "best", "total")
    for g, w in zip(got.orderBy("a").collect(), want.orderBy("a").collect(), strict=True):
        assert tuple(g)[:2] == tuple(w)[:2] and np.allclose(tuple(g)[2:], tuple(w)[2:], rtol=1e-12)


@pytest.mark.parametrize(("mask", "room"), [(2, 1 << 28), (62, 8), (62, 1 << 28)])
def test_reached_items_through_lists_and_bits(spark, monkeypatch, mask, room):
    monkeypatch.setattr(recs, "MASK", mask)
    rng = np.random.default_rng(4)
    pairs = {(u, int(i)) for u in range(120) for i in rng.integers(0, 3000, 6)} | {(u, 5000) for u in range(0, 120, 3)} | {(200, 6000)} | {(u, 7000) for u in (201, 202)}
    rows = spark.createDataFrame([(u, i, 1.0) for u, i in pairs], "user long, item int, rating double")
    lists, near = {}, {}
    for u, i in pairs:
        lists.setdefault(u, set()).add(i)
    for mine in lists.values():
        for i in mine:
            near.setdefault(i, set()).update(mine - {i})
    got = {r["user"]: r["items"] for r in recs.reachable(rows, block=100, room=room).collect()}
    assert got == {u: len(set().union(*[near[i] for i in mine])) for u, mine in lists.items()}


@pytest.mark.parametrize(("block", "chunk"), [(32_000_000, 2_000_000), (300, 20)])
def test_similar_users_are_scored_in_ranges(ratings, block, chunk):
    similar = recs.similarity(ratings, "user", "pearson", neighbours=6).cache()
    rated, near, want = {}, {}, {}
    for r in ratings.collect():
        rated.setdefault(r["user"], {})[r["item"]] = r["rating"]
    for r in similar.collect():
        near.setdefault(r["a"], []).append((-r["similarity"], r["b"]))
    mean = {u: sum(mine.values()) / len(mine) for u, mine in rated.items()}
    for u, found in near.items():
        sources = {}
        for s, b in sorted(found):
            for i, value in rated[b].items():
                sources.setdefault(i, []).append((-s, value - mean[b]))
        for i, pairs in sources.items():
            low = sum(abs(s) for s, _ in pairs[:3])
            want[u, i] = mean[u] + (sum(s * d for s, d in pairs[:3]) / low if low else 0.0)
    got = {(r["user"], r["item"]): r["score"] for r in recs.predict_users(ratings, similar, k=3, block=block, chunk=chunk).collect()}
    assert got == pytest.approx(want)
    best = recs.recommend_users(ratings, similar, 4, k=3, block=block, chunk=chunk)
    assert "Window" not in best._jdf.queryExecution().optimizedPlan().toString()
    top = {u: sorted((-round(s, 9), i) for (v, i), s in want.items() if v == u and i not in rated[u])[:4] for u in near}
    assert {(r["user"], r["rank"], r["item"]) for r in best.withColumn("score", F.round("score", 9)).collect()} == {(u, k + 1, i) for u, found in top.items() for k, (_, i) in enumerate(found)}


def test_factors_take_known_biases_and_keep_columns(ratings, monkeypatch):
    parts = recs.biases(ratings)
    plain = {(r["user"], r["item"]): r["score"] for r in recs.factorise_biased(ratings, rank=2, rounds=2).collect()}
    monkeypatch.setattr(recs, "biases", None)
    from pyspark.ml.recommendation import ALS

    steps, fit = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, df: (steps.append(self.getCheckpointInterval()), fit(self, df))[1])
    got = recs.factorise_biased(ratings, ratings, rank=2, rounds=2, known=parts, keep=("rating",)).collect()
    assert {(r["user"], r["item"]): r["score"] for r in got} == pytest.approx(plain)
    assert {(r["user"], r["item"], r["rating"]) for r in got} == {tuple(r) for r in ratings.collect()} and steps == [1]


def test_blocks_of_a_matrix_are_kept_on_disk(spark):
    from tabulon.operators import decompose

    held = spark.createDataFrame([(i, f"t{i % 7}", 1.0) for i in range(40)], "row long, column string, value double")
    blocks = decompose._matrix_blocks(held, 10)
    assert blocks.storageLevel.useDisk and not blocks.storageLevel.useMemory
    assert blocks.agg(F.sum(F.size("value"))).first()[0] == 40
    blocks.unpersist()
