"""Languages, decompositions, encodings, and operators over results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions.stats import signed_rank_p
from tabulon.operators import clean, decompose, drift, features, groups, languages, metrics, models, profile, recs
from tabulon.sources import files

#: Plain sentences, written for these tests.
SENTENCES = {
    "en": ["The children walked along the river and talked about their plans for the summer.", "When the rain stopped, we opened the windows and listened to the birds.", "There is nothing better than a good book on a long winter evening.", "She had forgotten where the keys were, so they waited at the door.", "Most of the houses in this street were built more than a hundred years ago.", "What would you do with the money if you were in my place?"],
    "de": ["Die Kinder gingen am Fluss entlang und sprachen über ihre Pläne für den Sommer.", "Als der Regen aufhörte, öffneten wir die Fenster und hörten den Vögeln zu.", "Es gibt nichts Schöneres als ein gutes Buch an einem langen Winterabend.", "Sie hatte vergessen, wo die Schlüssel lagen, und so warteten sie vor der Tür.", "Die meisten Häuser in dieser Straße wurden vor mehr als hundert Jahren gebaut.", "Was würdest du mit dem Geld machen, wenn du an meiner Stelle wärst?"],
    "fr": ["Les enfants marchaient le long de la rivière et parlaient de leurs projets pour l'été.", "Quand la pluie s'est arrêtée, nous avons ouvert les fenêtres pour écouter les oiseaux.", "Il n'y a rien de mieux qu'un bon livre pendant une longue soirée d'hiver.", "Elle avait oublié où étaient les clés, alors ils ont attendu devant la porte.", "La plupart des maisons de cette rue ont été construites il y a plus de cent ans.", "Que ferais-tu de cet argent si tu étais à ma place ?"],
    "es": ["Los niños caminaban por la orilla del río y hablaban de sus planes para el verano.", "Cuando dejó de llover, abrimos las ventanas y escuchamos a los pájaros.", "No hay nada mejor que un buen libro en una larga noche de invierno.", "Ella había olvidado dónde estaban las llaves, así que esperaron junto a la puerta.", "La mayoría de las casas de esta calle se construyeron hace más de cien años.", "¿Qué harías con el dinero si estuvieras en mi lugar?"],
}


def test_languages_of_held_out_sentences(spark):
    train = spark.createDataFrame([(lang, s) for lang, all_ in SENTENCES.items() for s in all_[:4]], "lang string, text string")
    test = [(i, s, lang) for i, (lang, s) in enumerate((lang, s) for lang, all_ in SENTENCES.items() for s in all_[4:])]
    profiles = languages.fit_languages(train)
    docs = spark.createDataFrame([*test, (100, None, None), (101, "", None), (102, "123 — !", None), (103, "日本語", None)], "doc_id long, text string, language string").drop("language")
    got = {r["doc_id"]: r for r in languages.detect_languages(docs, profiles).collect()}
    assert [got[i]["language"] for i, _, _ in test] == [lang for _, _, lang in test]
    assert all(0 < got[i]["confidence"] < 1 and 0 < got[i]["distance"] < 1 for i, _, _ in test)
    assert all(got[i]["language"] is None and got[i]["confidence"] is None for i in (100, 101, 102, 103)) and len(got) == len(docs.collect())
    corpus = {r["language"]: r for r in languages.corpus_languages(spark.createDataFrame(list(got.values()), "doc_id long, language string, distance double, confidence double")).collect()}
    assert corpus["en"]["n"] == 2 and corpus["unknown"]["n"] == 4 and corpus["unknown"]["primary"] and all(r["multilingual"] for r in corpus.values())
    assert profiles.groupBy("language").agg(F.max("rank").alias("r")).where("r > 300").count() == 0


# --- decompositions ----------------------------------------------------------------------------------------------


def sparse(spark, seed=3, n=60, m=40, rank=5):
    rng = np.random.default_rng(seed)
    a = (rng.normal(size=(n, rank)) * (2.0 ** -np.arange(rank))) @ rng.normal(size=(rank, m)) + 0.001 * rng.normal(size=(n, m))
    a[rng.random((n, m)) < 0.4] = 0
    rows = [(int(i), f"t{j:02d}", float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    return a, spark.createDataFrame([*rows, (0, "t00", None), (1, "t01", float("nan"))], "doc_id long, term string, weight double").repartition(4)


def test_truncated_svd_equals_the_dense_one(spark):
    a, entries = sparse(spark)
    u, s, vt = np.linalg.svd(a)
    assert np.allclose(decompose.truncated_svd(entries, 4)[2], s[:4], rtol=1e-4)
    scores, vectors, sizes = decompose.truncated_svd(entries, 4, rounds=10)
    assert np.allclose(sizes, s[:4], rtol=1e-6)
    v = np.zeros((40, 4))
    for r in vectors.collect():
        v[int(r["term"][1:]), r["component"] - 1] = r["weight"]
    assert np.allclose(v @ v.T, vt[:4].T @ vt[:4], atol=1e-4) and (v[np.abs(v).argmax(axis=0), range(4)] > 0).all()
    q = np.zeros((60, 4))
    for r in scores.collect():
        q[r["doc_id"], r["component"] - 1] = r["score"]
    assert np.allclose(q, a @ v, atol=1e-4)


def test_truncated_svd_of_little(spark):
    _, entries = sparse(spark)
    scores, vectors, sizes = decompose.truncated_svd(entries.limit(0), 3)
    assert scores.count() == vectors.count() == 0 and sizes == []
    one = spark.createDataFrame([(1, "a", 3.0), (1, "a", 1.0), (2, "a", 3.0)], "doc_id long, term string, weight double")
    scores, vectors, sizes = decompose.truncated_svd(one, 3)
    assert [round(x, 9) for x in sizes] == [5.0] and {(r["doc_id"], round(r["score"], 9)) for r in scores.collect()} == {(1, 4.0), (2, 3.0)} and vectors.first()["weight"] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="directions"):
        decompose.truncated_svd(one, 60)


def test_components_by_explained_variance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) @ np.diag([5.0, 2.0, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(4, 4)))[0] + 1e6
    rows = spark.createDataFrame([tuple(map(float, v)) for v in x] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    fitted = decompose.fit_components(rows, list("abcd"), share=0.95)
    e = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    k = int(np.searchsorted(np.cumsum(e) / e.sum(), 0.95)) + 1
    got = {r["component"]: r for r in fitted.collect()}
    assert set(got) == set(range(1, k + 1)) and all(abs(got[i]["variance"] - e[i - 1]) < 1e-6 * e[0] for i in got)
    assert [f"pc_{i}" for i in got] == decompose.on_components(rows, fitted).columns[4:]
    spread = decompose.on_components(rows, fitted).agg(F.var_samp("pc_1"), F.avg("pc_1")).first()
    assert abs(spread[0] - e[0]) < 1e-6 * e[0] and abs(spread[1]) < 1e-6
    assert decompose.fit_components(rows.limit(1), list("abcd")).count() == 0


def test_preparation_reduces_many_columns(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(80, 6)))], "id long, " + ", ".join(f"c{j} double" for j in range(6)))
    reduced, names = groups.prepare(rows, "id", most=3)
    assert names == ["pc_1", "pc_2", "pc_3"] and reduced.columns == ["id", *names] and groups.prepare(rows, "id")[1] == [f"c{j}" for j in range(6)]
    grouped = groups.assign(rows, ["c0", "c1"], 3, starts=3).groupBy("cluster").count().collect()
    assert len(grouped) == 3


# --- encodings ---------------------------------------------------------------------------------------------------

TABLES = {
    "utf-8": "name,stadt\nJürgen,Köln\nZoë,Besançon\n日本,東京\n",
    "utf-16le": "name,stadt\nJürgen,Köln\nZoë,Besançon\n",
    "cp1252": "name,preis\nJürgen,„fünf€“\nZoë,‚drei€‘ – été\n",
    "latin1": "name,stadt,text\nJürgen,Köln,Die Straße führt über die Brücke\nZoë,Besançon,été à la fenêtre\nPeña,Logroño,mañana será otro día\n",
    "cp1251": "name,city\nИван Петров,Москва\nАнна Смирнова,Санкт-Петербург\nОльга,Новосибирск\n",
    "koi8-r": "name,city\nИван Петров,Москва\nАнна Смирнова,Санкт-Петербург\nОльга,Новосибирск\n",
}


def test_files_in_five_encodings(spark, tmp_path):
    for name, text in TABLES.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode(name))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "marked.csv").write_bytes(b"\xff\xfe" + "a,b\nü,ö\n".encode("utf-16le"))
    found = {r["path"].rsplit("/", 1)[1][:-4]: r["encoding"] for r in files.detect_encoding(spark, str(tmp_path)).collect()}
    assert found == {**{n: n for n in TABLES}, "marked": "utf-16le"}
    for name, text in TABLES.items():
        df, encoding = files.read_csv_in_any_encoding(spark, str(tmp_path / f"{name}.csv"))
        assert encoding == name
        assert ["name" in df.columns] + [tuple(r) for r in df.collect()] == [True] + [tuple(line.split(",")) for line in text.splitlines()[1:]]


def test_a_cut_character_is_still_utf8():
    data = "é".encode() * 50
    assert max(files.encoding_scores(data[:-1]).items(), key=lambda kv: kv[1])[0] == "utf-8"
    assert files.encoding_scores(b"plain")["utf-8"] == 1.0 and files.encoding_scores(b"")["utf-8"] == 1.0
    assert max(files.encoding_scores("Grüße".encode("latin-1") * 20).items(), key=lambda kv: kv[1])[0] == "latin1"


# --- over results ------------------------------------------------------------------------------------------------


def test_target_summary_and_categories(spark):
    rows = spark.createDataFrame([(float(i), "ab"[i % 2], "x" if i < 7 else "y") for i in range(10)] + [(float("nan"), None, "z"), (None, "a", None)], "v double, g string, c string")
    got = {r["measure"]: r["value"] for r in profile.target_summary(rows, "v").collect()}
    assert got["rows"] == 12 and got["nulls"] == 2 and got["median"] == 4.5 and got["outlier_share"] == 0.0
    none = {r["measure"]: r["value"] for r in profile.target_summary(rows.limit(0), "v").collect()}
    assert none["rows"] == 0 and none["mean"] is None
    best = {(r["group"], r["rank"]): (r["value"], r["n"], r["share"]) for r in profile.group_categories(rows, "g", ["c"], 1).collect()}
    assert best == {("a", 1): ("x", 4, 0.8), ("b", 1): ("x", 3, 0.6), (None, 1): ("z", 1, 1.0)}


def test_histograms_of_activity(spark):
    ratings = spark.createDataFrame([(u, i, float(u)) for u in range(5) for i in range(u + 1)], "user long, item long, rating double")
    got = recs.activity_histograms(ratings, 4).collect()
    assert {r["side"]: sum(x["n"] for x in got if x["side"] == r["side"]) for r in got} == {"user": 5, "item": 5, "rating": 15}
    assert recs.activity_histograms(spark.createDataFrame([(1, 1, 2.0)], "user long, item long, rating double")).count() == 3
    assert recs.activity_histograms(ratings.limit(0)).count() == 0


def test_target_drift_of_both_kinds(spark):
    a = spark.createDataFrame([(float(i % 10), "ab"[i % 2]) for i in range(200)], "p double, y string")
    b = spark.createDataFrame([(float(i % 10) + 5, "aab"[i % 3]) for i in range(300)], "p double, y string")
    got = {r["kind"]: r for r in drift.target_drift(a, b, {"target": "y", "prediction": "p"}).collect()}
    assert got["prediction"]["statistic"] == 0.5 and got["prediction"]["drifted"] and got["target"]["method"] == "chi_square" and got["target"]["drifted"]
    same = {r["kind"]: r["drifted"] for r in drift.target_drift(a, a, {"target": "y", "prediction": "p"}).collect()}
    assert same == {"target": False, "prediction": False}


def test_repeated_permutation_importance(spark):
    rows = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("int").alias("b")).withColumn("y", 3.0 * F.col("a"))
    model = models.fit(rows, "y", ["a", "b"])
    got = {r["column_name"]: r for r in models.permutation_importance(model, rows, "y", ["a", "b"], "id", repeats=4).collect()}
    assert got["a"]["importance"] > 10 and abs(got["b"]["importance"]) < 1e-3 and got["a"]["spread"] > 0
    assert {r["spread"] for r in models.permutation_importance(model, rows, "y", ["a"], "id").collect()} == {None}


def test_exact_signed_ranks():
    for n in (1, 4, 7):
        for w in range(n * (n + 1) // 4 + 1):
            want = sum(min(s, n * (n + 1) // 2 - s) <= w for s in (sum(r for r in range(1, n + 1) if k >> (r - 1) & 1) for k in range(2**n))) / 2**n
            assert signed_rank_p(w, n, 0.0, 0.0) == pytest.approx(min(1.0, want))
    assert signed_rank_p(3, 40, 1.96, 0.0) == pytest.approx(0.05, abs=1e-3) and signed_rank_p(3, 5, 0.0, 2.0) == 1.0


def test_f_scores_far_from_zero(spark):
    rng = random.Random(1)
    values = [(i % 3, 1e9 + rng.gauss(i % 3, 1)) for i in range(90)]
    got = features.f_scores(spark.createDataFrame(values, "y int, x double"), ["x"], "y").first()["f"]
    by = [[v - 1e9 for k, v in values if k == c] for c in range(3)]
    grand = sum(map(sum, by)) / 90
    between = sum(len(b) * (sum(b) / len(b) - grand) ** 2 for b in by) / 2
    within = sum((v - sum(b) / len(b)) ** 2 for b in by for v in b) / 87
    assert got == pytest.approx(between / within, rel=1e-4)


def test_running_totals_by_group(spark):
    rows = spark.createDataFrame([("ab"[i % 2], i, 1 + i % 3) for i in range(40)], "g string, o int, v int").repartition(6)
    got = {(r["g"], r["o"]): (r["t"], r["t_all"]) for r in clean.grouped_running_totals(rows, "g", ["o"], {"t": "v"}).collect()}
    for g, o in got:
        mine = [(k, 1 + k % 3) for k in range(40) if "ab"[k % 2] == g]
        assert got[g, o] == (sum(v for k, v in mine if k <= o), sum(v for _, v in mine))
    assert math.isclose(metrics.class_curves(rows.select(F.col("g").alias("y"), (F.col("o") / 40).alias("s")), "y", {"b": "s"}).first()["roc_auc"], 0.525)


def test_a_catalog_keeps_versions(spark, tmp_path):
    from tabulon.sources import catalog

    path = str(tmp_path / "c")
    assert catalog.read(spark, path) is None and catalog.log(spark, path).count() == 0
    one = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    assert catalog.put(one, path, ["k"]) == 1
    assert catalog.put(spark.createDataFrame([(2, "c", 1.0), (None, "m", None)], "k int, v string, w double"), path, ["k"]) == 2
    assert sorted(map(tuple, catalog.read(spark, path).collect()), key=str) == [(1, "a", None), (2, "c", 1.0), (None, "m", None)]
    (tmp_path / "c" / "version=3").mkdir()  # left by a job that failed before its log row
    (tmp_path / "c" / "version=3" / "part-0.parquet").write_bytes(b"broken")
    assert catalog.read(spark, path).count() == 3
    assert catalog.delete(spark, path, spark.createDataFrame([(1,), (None,)], "k int"), ["k"]) == 3
    assert [tuple(r) for r in catalog.read(spark, path).collect()] == [(2, "c", 1.0)] and catalog.read(spark, path, 1).count() == 3
    assert [tuple(r) for r in catalog.log(spark, path).orderBy("version").select("version", "action", "n").collect()] == [(1, "put", 3), (2, "put", 3), (3, "delete", 1)]
    with pytest.raises(ValueError, match="unique"):
        catalog.put(one.union(one), path, ["k"])
    with pytest.raises(ValueError, match="version 9"):
        catalog.read(spark, path, 9)
