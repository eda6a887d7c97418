"""Ratings that are written once, and scores that don't leave their range of users."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import recs


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def ratings(spark):
    rows = [(u, i, float(1 + (u * 7 + i * 3) % 5)) for u in range(40) for i in range(30) if (u * u + 3 * i + u * i) % 4 == 0]
    return spark.createDataFrame(rows, "user long, item long, rating double").cache()


def test_ratings_are_written_once_and_whole(spark, ratings):
    raw = ratings.unionByName(ratings.withColumn("rating", F.col("rating") + 1)).unionByName(spark.createDataFrame([(99, 1, 2.0), (None, 1, 2.0), (1, 77, float("nan"))], ratings.schema))
    kept = recs.prepare(raw, "user", "item", "rating")
    assert "Window" not in _plan(kept) and "Aggregate" not in _plan(kept) and "Join" not in _plan(kept)
    rows = [tuple(r) for r in ratings.collect()]
    n_user, n_item = {u: sum(r[0] == u for r in rows) + 0 for u in range(40)}, {i: sum(r[1] == i for r in rows) + (i == 1) for i in range(30)}
    assert sorted(map(tuple, kept.select("user", "item", "rating").collect())) == sorted(r for r in rows if n_user[r[0]] >= 5 and n_item[r[1]] >= 5)


@pytest.mark.parametrize("chunk", [1, 50, 10**6])
def test_recommended_in_ranges(spark, ratings, chunk):
    similar = recs.similarity(ratings, neighbours=8).cache()
    near, rated, want = {}, {}, {}
    for r in similar.collect():
        near.setdefault(r["a"], []).append((r["b"], r["similarity"]))
    for r in ratings.collect():
        rated.setdefault(r["user"], {})[r["item"]] = r["rating"]
    for u, mine in rated.items():
        sources = {}
        for i, value in mine.items():
            for b, s in near.get(i, []):
                sources.setdefault(b, []).append((-s, i, value))
        for b, found in sources.items():
            top = sorted(found)[:3]
            want[u, b] = sum(-s * v for s, _, v in top) / sum(abs(s) for s, _, v in top)
    got = {(r["user"], r["item"]): r["score"] for r in recs.predict_items(ratings, similar, k=3, block=500, chunk=chunk).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    scores = recs.predict_items(ratings, similar, k=3)
    best = lambda df: sorted((r["user"], r["rank"], r["item"]) for r in df.collect())
    found = recs.recommend_items(ratings, similar, 4, k=3, block=500, chunk=chunk)
    assert best(found) == best(recs.top_n(scores, ratings, 4)) and "Window" not in _plan(found)
    popular = recs.popularity(ratings).select("item", "score")
    both = recs.blend({"a": (scores, 1.0), "b": (scores.select("user", "item").join(popular, "item"), 1.0)}, "rank")
    blended = {(r["user"], r["item"]): r["score"] for r in recs.blend_popular(ratings, similar, popular, k=3, block=500, chunk=chunk).collect()}
    assert blended == pytest.approx({(r["user"], r["item"]): r["score"] for r in both.collect()})


@pytest.mark.parametrize(("block", "room"), [(1_000_000, 1 << 30), (60, 64)])
def test_reachable_items_by_brute_force(spark, block, room):
    pairs = [(u, i) for u in range(30) for i in range(100) if (u * 31 + i * 17 + u * i) % 23 == 0] + [(90, 500), (91, 500), (91, 501), (92, 600)]
    rows = spark.createDataFrame([(u, i, 1.0 + (u + i) % 3) for u, i in pairs], "user long, item long, rating double")
    lists, near = {}, {}
    for u, i in pairs:
        lists.setdefault(u, set()).add(i)
    for mine in lists.values():
        for i in mine:
            near.setdefault(i, set()).update(mine - {i})
    want = {u: len(set().union(*[near[i] for i in mine])) for u, mine in lists.items()}
    assert {r["user"]: r["items"] for r in recs.reachable(rows, block=block, room=room).collect()} == want
    sums = recs.similarity(rows, neighbours=None).groupBy("a").agg(F.sum("similarity").alias("s")).collect()
    assert {r["a"]: r["total"] for r in recs.similarity(rows, totals=True).collect()} == pytest.approx({r["a"]: r["s"] for r in sums})
