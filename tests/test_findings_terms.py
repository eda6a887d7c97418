"""Word vectors trained in several tasks; words counted inside their row."""

from collections import Counter

import numpy as np

from tabulon.operators import text as X


def test_word_vectors_are_trained_in_parts(spark):
    rows = spark.createDataFrame([(i, "red green blue colour paint " * 8 if i % 2 else "dog cat horse animal cow " * 8) for i in range(60)] + [(60, None)], "doc_id long, text string")
    assert X._parts(rows, 1000) == 13 and X._parts(rows, 10**9) == 1 and X._parts(rows.limit(0), 5) == 1
    got = {r["doc_id"]: np.array(r["embedding"]) for r in X.embeddings(rows, 8, part=3000).collect()}
    assert len(got) == 61 and not got[60].any()
    assert all(np.allclose(got[i], got[i % 2]) for i in range(60)) and not np.allclose(got[0], got[1])


def test_runs_of_words_are_counted_in_their_row(spark):
    texts = ["a b a b a", "b", "", None, "é é x9 a-b", "a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = lambda t, k: [" ".join(w[i : i + k]) for w in [t.replace("-", " ").split()] for i in range(len(w) - k + 1)]
    want = Counter((i, r) for i, t in enumerate(texts) if t for k in (1, 2) for r in runs(t, k))
    got = X.ngrams(rows, (1, 2))
    assert {(r["doc_id"], r["term"]): r["n"] for r in got.collect()} == want and got.count() == len(want)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    twice = X.terms(rows.unionByName(rows.where("doc_id = 0")))
    assert {(r["doc_id"], r["term"]): r["n"] for r in twice.collect()}[0, "a"] == 6 and twice.where("doc_id = 0").count() == 2
    assert X.ngrams(rows.where("doc_id = 2")).count() == 0
