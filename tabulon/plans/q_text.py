"""Queries over texts and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.storage import stored
from tabulon.operators import recs as R
from tabulon.operators import text as X
from tabulon.plans.q_profile import fine, long, r
from tabulon.plans.registry import query, table

_W = "regexp_extract_all(lower(text), '[a-zà-öø-ÿ0-9]+')"
_TERMS = f"terms AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_W}) AS term FROM documents) GROUP BY ALL)"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query(f"WITH b AS (SELECT doc_id, text AS t, len(regexp_extract_all(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '\\S+')) AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s, length(regexp_replace(text, '\\s', '', 'g')) AS k FROM documents) SELECT doc_id, length(t) AS chars, w::BIGINT AS words, s::BIGINT AS sentences, {r('CASE WHEN w > 0 THEN k / w ELSE 0 END')} AS mean_word, {r('w / s')} AS words_per_sentence, {r('len(regexp_extract_all(t, \'[A-Z]\')) / length(t)', 6)} AS upper_share, {r('len(regexp_extract_all(t, \'[0-9]\')) / length(t)', 6)} AS digit_share FROM b")
def doc_features(spark, d):
    out = X.basic_features(_docs(spark, d)).drop("punctuation_share")
    return fine(fine(long(out, "chars", "words", "sentences"), "mean_word", "words_per_sentence"), "upper_share", "digit_share", digits=6)


@query(f"WITH {_TERMS} SELECT doc_id, sum(n)::BIGINT AS words, count(*) AS vocabulary, {r('count(*) FILTER (n = 1) / count(*)', 6)} AS hapax_share, {r('10000.0 * (sum(n * n) - sum(n)) / (sum(n)::DOUBLE * sum(n))')} AS yule_k, {r('coalesce(sum(n * (n - 1)) / nullif(sum(n)::DOUBLE * (sum(n) - 1), 0), 0)', 6)} AS simpson, {r('max(n) / sum(n)', 6)} AS top_share, {r('1 / (1 + count(*) / 10)', 6)} AS coherence FROM terms GROUP BY doc_id")
def doc_stylometry(spark, d):
    return fine(fine(X.stylometry(_docs(spark, d)), "yule_k"), "hapax_share", "simpson", "top_share", "coherence", digits=6)


_STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS["en"]) + "]"


@query(f"SELECT doc_id, {r(f'coalesce(len(list_distinct({_W})) / nullif(len({_W}), 0), 0)', 6)} AS lexical_diversity, {r(f'coalesce(len(list_filter({_W}, lambda x: list_contains({_STOPS}, x))) / nullif(len({_W}), 0), 0)', 6)} AS function_share FROM documents")
def doc_lexical(spark, d):
    return fine(X.lexical_features(_docs(spark, d)), "lexical_diversity", "function_share", digits=6)


_SYL = "greatest(len(regexp_extract_all(x, '[aeiouyà-æè-ïò-öù-ý]+')), 1)"


@query(f"WITH w AS (SELECT doc_id, {_W} AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s, length(regexp_replace(text, '\\s', '', 'g')) AS k2 FROM documents), c AS (SELECT doc_id, k2, len(w)::DOUBLE AS n, s, list_sum(list_transform(w, lambda x: {_SYL}))::DOUBLE AS y, len(list_filter(w, lambda x: {_SYL} >= 3))::DOUBLE AS c, list_sum(list_transform(w, lambda x: length(x)))::DOUBLE AS k FROM w WHERE len(w) > 0) SELECT doc_id, {r('206.835 - 1.015 * n / s - 84.6 * y / n', 3)} AS flesch_ease, {r('0.39 * n / s + 11.8 * y / n - 15.59', 3)} AS flesch_kincaid, {r('0.4 * (n / s + 100 * c / n)', 3)} AS fog, {r('4.71 * k / n + 0.5 * n / s - 21.43', 3)} AS ari, {r('5.88 * k / n - 29.6 / (n / s) - 15.8', 3)} AS coleman_liau, {r('k2 * 0.01469', 3)} AS reading_seconds FROM c")
def doc_readability(spark, d):
    return fine(X.readability(_docs(spark, d)), "flesch_ease", "flesch_kincaid", "fog", "ari", "coleman_liau", "reading_seconds", digits=3)


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(text, 'https?://\\S+|www\\.\\S+', ' ', 'g'), '\\S+@\\S+\\.\\S+', ' ', 'g')), '[a-zà-öø-ÿ0-9]+'), lambda x: length(x) BETWEEN 2 AND 50 AND NOT list_contains({_STOPS}, x)), ' ') AS normal FROM documents")
def doc_normalised(spark, d):
    return _docs(spark, d).select("doc_id", X.normalise(F.col("text")).alias("normal"))


_CHARS = "regexp_extract_all(text, '(?s).')"
_LARGEST = "coalesce(list_max(map_values(list_aggregate({}, 'histogram'))), 0)"

_QUALITY = f"""WITH b AS (SELECT doc_id, length(text) AS n, regexp_extract_all(text, '\\S+') AS k, {_LARGEST.format(_CHARS)} AS most, {_W} AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s FROM documents),
c AS (SELECT doc_id, (CASE WHEN n < 50 THEN 0.8 WHEN n > 2000 THEN 0.9 ELSE 1.0 END)::DOUBLE * least(1.0, coalesce(len(list_distinct(k)) / nullif(len(k), 0), 0) + 0.5) * (CASE WHEN n > 100 AND most > 0.3 * n THEN 0.5 ELSE 1.0 END)::DOUBLE AS score,
CASE WHEN len(w) > 0 THEN greatest(0.0, least(1.0, (206.835 - 1.015 * len(w) / s - 84.6 * list_sum(list_transform(w, lambda x: {_SYL}))::DOUBLE / len(w)) / 100)) END AS ease FROM b)
SELECT doc_id, {r('CASE WHEN ease IS NULL THEN score ELSE (score + ease) / 2 END', 6)} AS quality FROM c"""


@query(_QUALITY)
def doc_quality(spark, d):
    return fine(X.text_quality(_docs(spark, d)), "quality", digits=6)


def _lang_sql() -> str:
    parts = [f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(s) for s in stops)}], x))) AS h_{n}" for n, stops in sorted(X.STOP_WORDS.items())]
    names = sorted(X.STOP_WORDS)
    top = f"greatest({', '.join('h_' + n for n in names)})"
    return f"WITH h AS (SELECT doc_id, {', '.join(parts)} FROM (SELECT doc_id, {_W} AS w FROM documents)) SELECT doc_id, CASE WHEN {top} > 0 THEN CASE " + " ".join(f"WHEN h_{n} = {top} THEN '{n}'" for n in names) + f" END END AS language, {top}::BIGINT AS hits FROM h"


@query(_lang_sql())
def doc_language(spark, d):
    return long(X.language(_docs(spark, d)), "hits")


_ISSUES = {"too_short": ("n < 10", 0.5), "too_long": ("n > 10000", 0.8), "few_characters": ("n = 0 OR d < 0.1 * n", 0.6), "repeated_word": ("k > 0 AND most > 0.3 * k", 0.7), "few_letters": ("n = 0 OR letters < 0.5 * n", 0.8), "short_sentences": ("k > 0 AND k / s < 3", 0.7), "long_sentences": ("k / s > 50", 0.8), "special_characters": ("special > 0.1 * n", 0.8)}
_ISSUE_ROWS = f"""f AS (SELECT doc_id, length(text) AS n, len(list_distinct(regexp_extract_all(lower(text), '(?s).'))) AS d, len(regexp_extract_all(text, '\\S+')) AS k, {_LARGEST.format("regexp_extract_all(text, '\\S+')")} AS most, len(regexp_extract_all(text, '\\pL')) AS letters, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s, len(regexp_extract_all(text, '[^\\pL\\pN\\s!-/:-@\\[-`{{-~]')) AS special FROM documents),
issues AS (SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, (c, _) in _ISSUES.items())}) AS issues, {' * '.join(f'(CASE WHEN {c} THEN {p} ELSE 1.0 END)::DOUBLE' for c, p in _ISSUES.values())} AS score FROM f)"""


@query(f"WITH {_ISSUE_ROWS} SELECT doc_id, issues, {r('score', 6)} AS score FROM issues")
def doc_quality_issues(spark, d):
    return fine(X.quality_issues(_docs(spark, d)), "score", digits=6)


@query(f"WITH {_ISSUE_ROWS} SELECT issue, count(*) AS n, {r('count(*) / (SELECT count(*) FROM issues)', 6)} AS share, {r('avg(score)', 6)} AS mean_score FROM (SELECT score, unnest(string_split(issues, ',')) AS issue FROM issues WHERE issues <> '') GROUP BY issue")
def doc_issue_summary(spark, d):
    return fine(X.issue_summary(X.quality_issues(_docs(spark, d))), "share", "mean_score", digits=6)


@query(f"WITH {_TERMS} SELECT (SELECT count(*) FROM documents) AS documents, {r('(SELECT avg(length(text)) FROM documents)')} AS mean_chars, count(DISTINCT term) AS vocabulary, sum(n)::BIGINT AS words, {r('sum(n) / (SELECT count(*) FROM documents)')} AS mean_words FROM terms")
def corpus_statistics(spark, d):
    return fine(X.corpus_statistics(_docs(spark, d)), "mean_chars", "mean_words")


@query(f"WITH {_TERMS} SELECT term, sum(n)::BIGINT AS n, count(*) AS documents FROM terms GROUP BY term ORDER BY n DESC, term LIMIT 20")
def corpus_top_words(spark, d):
    return X.top_words(_docs(spark, d))


_TFIDF = f"{_TERMS}, df AS (SELECT term, count(*) AS df FROM terms GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM documents)), raw AS (SELECT doc_id, term, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM terms JOIN df USING (term)), tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"


@query(f"WITH {_TFIDF} SELECT doc_id, count(*) AS terms, {r('sum(weight)')} AS total, {r('max(weight)')} AS top FROM tfidf GROUP BY doc_id")
def doc_tfidf(spark, d):
    out = X.tf_idf(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("weight").alias("total"), F.max("weight").alias("top"))
    return fine(out, "total", "top")


@query()
def doc_tfidf_pairs(spark, d):
    return X.similar_documents(_docs(spark, d))


_LEXICON = "(VALUES ('the', 0.5), ('worthless', -3.0), ('disgusting', -3.0), ('trash', -2.0), ('that', 0.25)) AS lex(term, valence)"


@query(f"WITH {_TERMS}, v AS (SELECT doc_id, sum(n * valence)::DOUBLE AS v FROM terms JOIN {_LEXICON} USING (term) GROUP BY doc_id), s AS (SELECT doc_id, coalesce(v, 0) AS v FROM documents LEFT JOIN v USING (doc_id)) SELECT doc_id, {r('v')} AS valence, {r('v / sqrt(v * v + 15)')} AS score, CASE WHEN v / sqrt(v * v + 15) >= 0.05 THEN 'positive' WHEN v / sqrt(v * v + 15) <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM s")
def doc_sentiment(spark, d):
    return fine(X.sentiment(_docs(spark, d), _lexicon(spark)), "valence", "score")


def _lexicon(spark):
    return spark.sql("SELECT term, cast(valence AS double) AS valence FROM VALUES ('the', 0.5), ('worthless', -3.0), ('disgusting', -3.0), ('trash', -2.0), ('that', 0.25) AS t(term, valence)")


@query("SELECT 'EMAIL' AS kind, entity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b')) AS entity FROM documents) GROUP BY entity")
def doc_entities(spark, d):
    return X.entities(_docs(spark, d), {"EMAIL": X.ENTITIES["EMAIL"]})


@query()
def doc_topics(spark, d):
    return X.topics(_docs(spark, d), k=4, rounds=5)[1]


@query()
def doc_topic_quality(spark, d):
    return X.topic_quality(X.topics(_docs(spark, d), k=4, rounds=5)[0])


@query()
def doc_embeddings(spark, d):
    return X.embeddings(_docs(spark, d), 16)


@query()
def doc_classified(spark, d):
    joined = _docs(spark, d).join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    return X.classify(joined.where("doc_id % 5 > 0"), "label", joined.where("doc_id % 5 = 0"))


@query()
def doc_augmented(spark, d):
    return X.augment(_docs(spark, d)).select("doc_id", "copy", F.char_length("text").alias("chars"))


@query(f"WITH {_TERMS}, v AS (SELECT doc_id, sum(n * valence)::DOUBLE AS v FROM terms JOIN {_LEXICON} USING (term) GROUP BY doc_id), e AS (SELECT coalesce(v, 0) / sqrt(coalesce(v, 0) ** 2 + 15) AS e FROM documents LEFT JOIN v USING (doc_id)), c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT count(*) AS volume, {r('avg(length(text))')} AS mean_length, {r('count(DISTINCT text) / count(*)', 6)} AS content_diversity, (SELECT source FROM c ORDER BY n DESC, source LIMIT 1) AS dominant_class, {r('(SELECT 1 - (max(n) - min(n)) / sum(n) FROM c)', 6)} AS class_balance, {r('(SELECT count(*) FILTER (e >= 0.05) / count(*) FROM e)', 6)} AS positive_ratio, {r('(SELECT count(*) FILTER (e <= -0.05) / count(*) FROM e)', 6)} AS negative_ratio FROM documents")
def doc_business_metrics(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return fine(fine(X.business_metrics(docs, "source", X.sentiment(docs, _lexicon(spark))), "mean_length"), "content_diversity", "class_balance", "positive_ratio", "negative_ratio", digits=6)


@query("SELECT doc_id, len(string_split(text, ' ')) + CASE WHEN len(string_split(text, ' ')) < 3 THEN 0 ELSE 2 END AS words FROM documents")
def doc_inserted(spark, d):
    """Words of each text after two insertions."""
    return long(X.with_insertions(_docs(spark, d), 2).select("doc_id", F.size(F.split("text", " ")).alias("words")), "words")


@query(f"SELECT count(*) AS documents, sum(length(text))::BIGINT AS characters, {r('sum(length(text)) / 1e6 * 2.0', 6)} AS cost FROM documents")
def doc_cost(spark, d):
    return fine(X.cost_estimate(_docs(spark, d)), "cost", digits=6)


# --- recommendations ---------------------------------------------------------------------------------------------

_RAW = "SELECT o_custkey AS u, l_partkey AS i, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"
_RATINGS = f"ratings AS (SELECT u AS \"user\", i AS item, q AS rating FROM (SELECT *, count(*) OVER (PARTITION BY u) AS nu, count(*) OVER (PARTITION BY i) AS ni FROM ({_RAW})) WHERE nu >= 5 AND ni >= 5)"


def _ratings(spark, d):
    """Ratings of every part by the customers who bought it."""
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return R.prepare(rows.groupBy(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i")).agg(F.sum("l_quantity").alias("q")), "u", "i", "q")


_SIM = f"{_RATINGS}, norms AS (SELECT item, sum(rating * rating) AS q FROM ratings GROUP BY item), sim AS (SELECT a.item AS a, b.item AS b, sum(a.rating * b.rating) / (sqrt(any_value(na.q)) * sqrt(any_value(nb.q))) AS s FROM ratings a JOIN ratings b ON a.\"user\" = b.\"user\" AND a.item <> b.item JOIN norms na ON na.item = a.item JOIN norms nb ON nb.item = b.item GROUP BY a.item, b.item)"


@query(f"WITH {_SIM} SELECT a, count(*) AS n, {r('max(s)')} AS best, {r('sum(s)')} AS total FROM sim GROUP BY a")
def part_item_similarity(spark, d):
    return fine(R.similarity(_ratings(spark, d), totals=True).select("a", "n", "best", "total"), "best", "total")


@query(f"WITH {_SIM} SELECT r.\"user\", count(DISTINCT s.b) AS items, {r('sum(s.s * r.rating) / sum(abs(s.s))')} AS mean_score FROM ratings r JOIN sim s ON s.a = r.item GROUP BY r.\"user\"")
def user_part_scores(spark, d):
    ratings = _ratings(spark, d)
    near = ratings.join(R.similarity(ratings, totals=True).select(F.col("a").alias("item"), "total", "size"), "item")
    scores = near.groupBy("user").agg((F.sum(F.col("total") * F.col("rating")) / F.sum("size")).alias("mean_score"))
    out = R.reachable(ratings).join(scores, "user").select("user", "items", "mean_score")
    return fine(out, "mean_score")


@query(f"WITH {_RATINGS} SELECT item, count(*) AS n, {r('avg(rating)')} AS mean, {r('count(*) * avg(rating)')} AS score, row_number() OVER (ORDER BY count(*) * avg(rating) DESC, item) AS rank FROM ratings GROUP BY item ORDER BY rank LIMIT 20")
def popular_parts(spark, d):
    return fine(long(R.popular(_ratings(spark, d), 20), "rank"), "mean", "score")


@query(f"WITH {_RATINGS} SELECT count(DISTINCT \"user\") AS users, count(DISTINCT item) AS items, count(*) AS interactions, {r('avg(rating)')} AS mean_rating, {r('1 - count(*) / (count(DISTINCT \"user\") * count(DISTINCT item))', 6)} AS sparsity FROM ratings")
def ratings_statistics(spark, d):
    return fine(fine(R.statistics(_ratings(spark, d)), "mean_rating"), "sparsity", digits=6)


def _recommended(spark, d):
    ratings = _ratings(spark, d)
    train = ratings.where(F.pmod(F.xxhash64("user", "item"), F.lit(5)) > 0)
    similar = stored(R.similarity(train, neighbours=20), "similar")
    found = stored(R.recommend_items(train, similar, 10), "recommended")
    return R.with_fallback(found, ratings, train, 10), ratings.where(F.pmod(F.xxhash64("user", "item"), F.lit(5)) == 0), train, similar


@query()
def recs_topn(spark, d):
    return _recommended(spark, d)[0]


@query()
def recs_ndcg(spark, d):
    found, truth, *_ = _recommended(spark, d)
    return R.ranking_metrics(found, truth)


@query()
def recs_user_based(spark, d):
    ratings = _ratings(spark, d)
    return R.recommend_users(ratings, R.similarity(ratings, "user", "pearson", neighbours=10), 5)


@query()
def recs_diverse(spark, d):
    found, _, _, similar = _recommended(spark, d)
    return R.rerank_diverse(found, similar)


@query()
def recs_diversity(spark, d):
    found, _, train, _ = _recommended(spark, d)
    attributes = table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_type")
    return R.diversity(found, attributes, ["p_brand", "p_type"]).crossJoin(R.coverage(found, train))


@query()
def recs_factorised(spark, d):
    return R.factorise(_ratings(spark, d), rounds=3)


@query()
def recs_blended(spark, d):
    ratings = _ratings(spark, d)
    return R.blend_popular(ratings, R.similarity(ratings, neighbours=10), R.popularity(ratings).select("item", "score"))


@query(f"WITH k AS (SELECT DISTINCT o_custkey AS k, l_partkey AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey), n AS (SELECT x, count(*) AS n FROM k GROUP BY x), t AS (SELECT count(DISTINCT k) AS t FROM k), p AS (SELECT a.x AS a, b.x AS b, count(*) AS n FROM k a JOIN k b ON a.k = b.k AND a.x <> b.x GROUP BY ALL) SELECT a, b, p.n AS n, {r('p.n / t', 6)} AS support, {r('p.n / na.n', 6)} AS confidence, {r('p.n * t / (na.n * nb.n)', 6)} AS lift FROM p JOIN n na ON na.x = a JOIN n nb ON nb.x = b, t WHERE p.n / t >= 0.002")
def part_rules(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.col("l_partkey").alias("x"))
    return fine(R.pair_rules(rows, "o_custkey", "x", least_support=0.002), "support", "confidence", "lift", digits=6)


@query(f"""WITH s AS (SELECT a.p_partkey AS a, b.p_partkey AS b, ((a.p_brand = b.p_brand)::INT + (a.p_type = b.p_type)::INT + (a.p_size = b.p_size)::INT) / 3 AS s FROM part a JOIN part b ON a.p_partkey <> b.p_partkey)
SELECT a, b, {r('s', 6)} AS similarity FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5""")
def part_content_similarity(spark, d):
    found = R.content_similarity(table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"], neighbours=5)
    return fine(found, "similarity", digits=6)


@query(f"WITH {_RATINGS}, s AS (SELECT count(DISTINCT \"user\") AS users, 1 - count(*) / (count(DISTINCT \"user\") * count(DISTINCT item)) AS s FROM ratings) SELECT CASE WHEN s > 0.99 THEN 'matrix_factorisation' WHEN users > 10000 THEN 'item_based' WHEN s < 0.9 THEN 'user_based' ELSE 'hybrid' END AS algorithm, {r('s', 6)} AS sparsity, users FROM s")
def ratings_algorithm(spark, d):
    return fine(R.algorithm_choice(_ratings(spark, d)), "sparsity", digits=6)


@query(f"WITH {_RATINGS} SELECT count(*) AS recommendations, count(DISTINCT \"user\") AS users, {r('count(*) * 0.02')} AS expected_orders, {r('count(*) * 0.02 * 50')} AS expected_revenue FROM ratings")
def ratings_impact(spark, d):
    return fine(R.business_impact(_ratings(spark, d), conversion=0.02, order_value=50.0), "expected_orders", "expected_revenue")
