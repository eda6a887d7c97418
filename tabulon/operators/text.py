"""Text analytics over (doc_id, text) rows: array expressions per document and term tables per corpus."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.storage import cut, stored
from tabulon.operators.tokens import TOKENS, Block, blocks_of, listed, token_blocks

#: Frequent words by language, for stop words and the language guess (fixed values).
STOP_WORDS = {
    "en": "the of and to in a is that it for was on with as are be this by at from or an have not he his they you".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas ne ce se il sont avec aux".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ya".split(),
}
URL, EMAIL = r"https?://\S+|www\.\S+", r"\S+@\S+\.\S+"
ENTITIES = {"DATE": r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b", "MONEY": r"[$€£]\s?\d+(?:[.,]\d+)*", "URL": r"https?://[^\s<>\"]+", "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"}
PLAIN_WORD = r"[a-zà-öø-ÿ0-9]+"


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(PLAIN_WORD), F.lit(0))


def normalise(text: Column, *, numbers: bool = True, stop_words: list[str] | None = None) -> Column:
    """Text without addresses, in lower case, of words of 2 to 50 characters, without stop words (and numbers)."""
    t = F.regexp_replace(F.regexp_replace(text, URL, " "), EMAIL, " ")
    stops = F.array(*[F.lit(w) for w in (stop_words if stop_words is not None else STOP_WORDS["en"])])
    kept = F.filter(words(t), lambda w: F.char_length(w).between(2, 50) & ~F.array_contains(stops, w))
    return F.array_join(kept if numbers else F.filter(kept, lambda w: ~w.rlike("^[0-9]+$")), " ")


def _largest_count(values: Column) -> Column:
    """How often the most frequent element of an array occurs: runs of the sorted array are counted, in the row."""
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    run = lambda a, x: F.when(a["v"] == x, a["run"] + 1).otherwise(1)
    return F.aggregate(F.array_sort(values), start, lambda a, x: F.struct(x.alias("v"), run(a, x).alias("run"), F.greatest(a["most"], run(a, x)).alias("most")), lambda a: a["most"])


def _sentences(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))


_VOWEL, _OTHER, _LETTER = "[aeiouyà-æè-ïò-öù-ý]", "[bcdfghjklmnpqrstvwxzçðñøþÿ0-9]", "[a-zà-öø-ÿ0-9]"


def _word_facts(text: Column) -> dict[str, Column]:
    """``words, letters, syllables, complex`` of a text in lower case, by scans of the text without an array of its words.

    Syllables are groups of vowels, at least one a word; vowels are letters of words, so that no group spans two. A complex word
    has three or more.
    """
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    bare = count(f"(?<!{_LETTER}){_OTHER}++(?!{_LETTER})")
    return {
        "words": count(f"{_LETTER}++"), "letters": count(_LETTER), "syllables": count(f"{_VOWEL}++") + bare,
        "complex": count(f"{_OTHER}*+{_VOWEL}++(?:{_OTHER}++{_VOWEL}++){{2}}{_LETTER}*+"),
    }


def _syllables(word: Column) -> Column:
    """Groups of vowels, at least one."""
    return F.greatest(F.regexp_count(word, F.lit("[aeiouyà-æè-ïò-öù-ý]+")), F.lit(1))


def _total(array: str, size) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + size(x))


def _flesch_ease(n: Column, sentences: Column, syllables: Column) -> Column:
    return 206.835 - 1.015 * (n / sentences) - 84.6 * (syllables / n)


def _share(pattern: str, text: Column) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)), F.char_length(text)), F.lit(0.0))


def basic_features(df: DataFrame) -> DataFrame:
    """``doc_id`` with characters, words, sentences, mean lengths and shares of punctuation, capitals and digits."""
    t = F.coalesce("text", F.lit(""))
    w = F.filter(F.split(F.trim(t), r"\s+"), lambda x: x != "")
    rows = df.select("doc_id", t.alias("t"), w.alias("w"), F.greatest(F.regexp_count(t, F.lit(r"[.!?]+")), F.lit(1)).alias("sentences"))
    n = F.size("w")
    total = F.aggregate("w", F.lit(0), lambda s, x: s + F.char_length(x))
    return rows.select("doc_id", F.char_length("t").alias("chars"), n.alias("words"), "sentences", F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("mean_word"), (n / F.col("sentences")).alias("words_per_sentence"), _share(r"[!-/:-@\[-`{-~]", F.col("t")).alias("punctuation_share"), _share(r"[A-Z]", F.col("t")).alias("upper_share"), _share(r"[0-9]", F.col("t")).alias("digit_share"))


def lexical_features(df: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """``doc_id, lexical_diversity, function_share``: distinct words and stop words over words."""
    stops = F.array(*[F.lit(x) for x in (stop_words or STOP_WORDS["en"])])
    rows = df.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    share = lambda k: F.coalesce(F.try_divide(k, F.size("w")), F.lit(0.0))
    return rows.select("doc_id", share(F.size(F.array_distinct("w"))).alias("lexical_diversity"), share(F.size(F.filter("w", lambda x: F.array_contains(stops, x)))).alias("function_share"))


def readability(df: DataFrame) -> DataFrame:
    """``doc_id`` with Flesch ease, Flesch-Kincaid, Fog, ARI, Coleman-Liau and seconds to read; no row without words.

    Syllables are groups of vowels; a word of three or more is complex. Reading takes 14.69 ms for each character that is
    no white space.
    """
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", words(F.col("t")).alias("w"), _sentences(F.col("t")).alias("s"), F.regexp_count("t", F.lit(r"\S")).alias("shown"))
    counted = rows.select("doc_id", "shown", F.size("w").alias("n"), "s", _total("w", _syllables).alias("y"), F.size(F.filter("w", lambda x: _syllables(x) >= 3)).alias("c"), _total("w", F.char_length).alias("k")).where("n > 0")
    ws, sw, kw = F.col("n") / F.col("s"), F.col("y") / F.col("n"), F.col("k") / F.col("n")
    return counted.select("doc_id", _flesch_ease(F.col("n"), F.col("s"), F.col("y")).alias("flesch_ease"), (0.39 * ws + 11.8 * sw - 15.59).alias("flesch_kincaid"), (0.4 * (ws + 100 * F.col("c") / F.col("n"))).alias("fog"), (4.71 * kw + 0.5 * ws - 21.43).alias("ari"), (5.88 * kw - 29.6 / ws - 15.8).alias("coleman_liau"), (F.col("shown") * 0.01469).alias("reading_seconds"))


def terms(df: DataFrame) -> DataFrame:
    """``doc_id, term, n``: how often each word occurs in each document."""
    return ngrams(df, (1,))


def ngrams(df: DataFrame, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """``doc_id, term, n`` of runs of words of the given sizes, joined by a space.

    They are counted where the text is; only rows of one ``doc_id``, if there are any, are added up by a shuffle.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    rows = df.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    counted = rows.mapInArrow(_count_runs(sizes), f"doc_id {kind}, term string, n long")
    if df.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return counted
    return counted.groupBy("doc_id", "term").agg(F.sum("n").alias("n"))


def _count_runs(sizes: tuple[int, ...]):
    """Counts the runs of words of each row of Arrow batches (doc_id, w)."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            row, word = pc.list_parent_indices(batch.column("w")), pc.list_flatten(batch.column("w"))
            rows, runs = [row.slice(0, 0)], [word.slice(0, 0)]
            for k in sizes:
                n = len(word) - k + 1
                if n > 0:
                    inside = pc.equal(row.slice(0, n), row.slice(k - 1, n))
                    rows.append(row.slice(0, n).filter(inside))
                    runs.append((word.slice(0, n) if k == 1 else pc.binary_join_element_wise(*[word.slice(i, n) for i in range(k)], " ")).filter(inside))
            found = pa.table({"row": pa.concat_arrays(rows), "term": pa.concat_arrays(runs)}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
            for part in found.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(part.column("row")), part.column("term"), part.column("count_all")], names=["doc_id", "term", "n"])

    return run


def limited_tf_idf(df: DataFrame, sizes: tuple[int, ...] = (1, 2), most_terms: int = 1000) -> DataFrame:
    """``doc_id, term, weight`` over the ``most_terms`` most frequent runs of words: tf · (ln((1 + N) / (1 + df)) + 1), each
    document at length 1. The limit on terms is the size of the feature space; ties go to the smaller term.

    The best terms are found without counting all runs across blocks: the counts of each block's most frequent runs give a
    count that the best reach at least, and a run that reaches it has its share of it in some block.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    blocks = token_blocks(df, words(F.col("text")))
    n_docs, n_blocks = df.agg(F.count_distinct("doc_id")).first()[0], blocks.count()
    summed = lambda least, most=None: blocks.mapInArrow(_frequent_runs(sizes, least, most), _RUNS).groupBy("term").agg(F.sum("n").alias("n"))
    first = summed(1, 2 * most_terms).orderBy(F.desc("n")).limit(most_terms).agg(F.count("*").alias("k"), F.min("n").alias("n")).first()
    reached = first["n"] if first["k"] == most_terms else 1
    share = max(1, -(-reached // max(1, n_blocks)))
    # a run has at most share - 1 in each block that doesn't name it; at a share of 1 all counts are whole
    able = summed(share).where(F.col("n") + (share - 1) * n_blocks >= reached)
    able = stored((able.orderBy(F.desc("n"), "term").limit(most_terms) if share == 1 else able).select("term"), "runs")
    if able.count() <= _SENT:
        counted = blocks.crossJoin(F.broadcast(able.agg(F.collect_list("term").alias("terms")))).mapInArrow(_counts_of(sizes), _RUNS)
    else:
        counted = blocks.mapInArrow(_frequent_runs(sizes, 1, None, True), _RUNS).join(able, "term", "left_semi")
    exact = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    best = [(r["term"], math.log((1 + n_docs) / (1 + r["df"])) + 1) for r in exact.orderBy(F.desc("n"), "term").limit(most_terms).collect()]
    return blocks.mapInArrow(_weights_of(sizes, best), f"doc_id {kind}, term string, weight double")


_RUNS = "term string, n long, df long"
#: Runs that every block is asked for at once, at most.
_SENT = 100_000


def _frequent_runs(sizes: tuple[int, ...], least: int, most: int | None, spread: bool = False):
    """``term, n, df`` of the runs of a block that occur ``least`` times in it, or of the ``most`` most frequent of each size; documents
    are counted with ``spread`` only."""

    def run(batches):
        for b in blocks_of(batches):
            for k in sizes:
                at, code = b.runs(k)
                _, start, *which, n = np.unique(code, return_index=True, return_inverse=spread, return_counts=True)
                df = np.bincount(np.unique(which[0] * np.int64(len(b.sizes)) + b.row[at]) // len(b.sizes), minlength=len(n)) if spread else np.zeros(len(n))
                kept = np.nonzero(n >= least)[0]
                if most is not None and len(kept) > most:
                    kept = kept[np.argpartition(-n[kept], most)[:most]]
                yield pa.RecordBatch.from_arrays([b.text(at[start[kept]], k), pa.array(n[kept].astype(np.int64)), pa.array(df[kept].astype(np.int64))], names=["term", "n", "df"])

    return run


def _found(b: Block, sizes: tuple[int, ...], terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in ``terms`` and count of each of some terms in each document of a block."""
    place = {w: i for i, w in enumerate(b.words.to_pylist())}
    rows, terms_, counts = [], [], []
    for k in sizes:
        mine = [(i, p) for i, t in enumerate(terms) for p in [[place.get(w, -1) for w in t.split(" ")]] if len(p) == k and min(p) >= 0]
        at = np.arange(max(0, len(b.tokens) - k + 1))
        at = at[b.row[at] == b.row[at + k - 1]]
        # runs are narrowed word by word: a run's code is the place of what it begins with among such beginnings
        begun, code = {(): 0}, np.zeros(len(at), np.int64)
        for j in range(k):
            following = {p: n for n, p in enumerate(sorted({tuple(p[: j + 1]) for _, p in mine}))}
            keys = np.array(sorted((begun[p[:-1]] * len(b.words) + p[-1], n) for p, n in following.items()), np.int64).reshape(-1, 2)
            here = code * len(b.words) + b.tokens[at + j]
            hit = np.searchsorted(keys[:, 0], here)
            known = hit < len(keys)
            known[known] = keys[hit[known], 0] == here[known]
            at, code, begun = at[known], keys[hit[known], 1], following
        which = np.zeros(max(1, len(begun)), np.int64)
        for i, p in mine:
            which[begun[tuple(p)]] = i
        found, n = np.unique(b.row[at] * np.int64(len(terms)) + which[code], return_counts=True)
        rows.append(found // len(terms)), terms_.append(found % len(terms)), counts.append(n)
    return np.concatenate(rows), np.concatenate(terms_), np.concatenate(counts)


def _counts_of(sizes: tuple[int, ...]):
    """``term, n, df`` of a block's ``terms`` in it."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                terms = batch.column("terms")[i].as_py()
                _, term, n = _found(Block(batch, i), sizes, terms)
                total, df = np.bincount(term, n, len(terms)).astype(np.int64), np.bincount(term, minlength=len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(total), pa.array(df)], names=["term", "n", "df"])

    return run


def _weights_of(sizes: tuple[int, ...], best: list[tuple[str, float]]):
    """``doc_id, term, weight`` of the best terms, each document at length 1."""

    def run(batches):
        if not best:
            return
        terms, factors = pa.array([t for t, _ in best]), np.array([f for _, f in best])
        for b in blocks_of(batches):
            row, term, n = _found(b, sizes, [t for t, _ in best])
            w = n * factors[term]
            norm = np.sqrt(np.bincount(row, w * w, len(b.sizes)))
            yield pa.RecordBatch.from_arrays([b.docs.take(pa.array(row)), terms.take(pa.array(term)), pa.array(w / norm[row])], names=["doc_id", "term", "weight"])

    return run


def stylometry(df: DataFrame) -> DataFrame:
    """``doc_id, words, vocabulary, hapax_share, yule_k, simpson, top_share`` from the term counts."""
    n = F.sum("n")
    rows = terms(df).groupBy("doc_id").agg(n.alias("words"), F.count("*").alias("vocabulary"), (F.count_if(F.col("n") == 1) / F.count("*")).alias("hapax_share"), F.sum(F.col("n") * F.col("n")).alias("m2"), (F.max("n") / n).alias("top_share"), F.sum(F.col("n") * (F.col("n") - 1)).alias("d"))
    return rows.select("doc_id", "words", "vocabulary", "hapax_share", (10_000.0 * (F.col("m2") - F.col("words")) / (F.col("words") * F.col("words"))).alias("yule_k"), F.coalesce(F.try_divide("d", F.col("words") * (F.col("words") - 1)), F.lit(0.0)).alias("simpson"), "top_share", (1 / (1 + F.col("vocabulary") / 10)).alias("coherence"))


def text_quality(df: DataFrame) -> DataFrame:
    """``doc_id, quality``: 1, times .8 under 50 and .9 over 2,000 characters, times min(1, share of distinct words + .5),
    halved if one character is over .3 of more than 100; then the mean with the Flesch ease as a share of 100, if there are words."""
    t = F.coalesce("text", F.lit(""))
    rows = df.select("doc_id", t.alias("t"), F.lower(t).alias("low"), _tokens(t).alias("tokens"), _sentences(t).alias("s"))
    facts = _word_facts(F.col("low"))
    counted = rows.select("doc_id", F.char_length("t").alias("n"), F.size("tokens").alias("k"), F.size(F.array_distinct("tokens")).alias("distinct"), _most_of_a_character()("t").alias("most"), facts["words"].alias("words"), facts["syllables"].alias("y"), "s")
    length = F.when(F.col("n") < 50, 0.8).when(F.col("n") > 2000, 0.9).otherwise(1.0)
    varied = F.least(F.lit(1.0), F.coalesce(F.try_divide("distinct", "k"), F.lit(0.0)) + 0.5)
    score = length * varied * F.when((F.col("n") > 100) & (F.col("most") > 0.3 * F.col("n")), 0.5).otherwise(1.0)
    ease = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _flesch_ease(F.col("words"), F.col("s"), F.col("y")) / 100))
    return counted.select("doc_id", F.when(F.col("words") > 0, (score + ease) / 2).otherwise(score).alias("quality"))


def _tokens(text: Column) -> Column:
    """What white space separates."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def _most_of_a_character():
    """How often a text's most frequent code point occurs."""

    @F.pandas_udf("int")
    def most(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: max(Counter(t).values(), default=0))

    return most


def _distinct_characters():
    """How many code points a text has."""

    @F.pandas_udf("int")
    def distinct(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(set(t)))

    return distinct


def quality_issues(df: DataFrame) -> DataFrame:
    """``doc_id, issues, score``: names of what is wrong with a text and the product of their penalties.

    Lengths of 10 to 10,000 characters; distinct characters (case aside) at least .1 of all; no word over .3 of all; letters at
    least half; 3 to 50 words a sentence; characters beyond letters, digits, white space and ASCII punctuation at most .1.
    """
    t = F.coalesce("text", F.lit(""))
    facts = df.select("doc_id", t.alias("t"), _tokens(t).alias("w"), _distinct_characters()(F.lower(t)).alias("distinct"))
    facts = facts.select("doc_id", F.char_length("t").alias("n"), "distinct", F.size("w").alias("k"), _largest_count(F.col("w")).alias("most"), _share(r"\p{L}", F.col("t")).alias("letters"), (F.size("w") / _sentences(F.col("t"))).alias("long"), _share(r"[^\p{L}\p{N}\s!-/:-@\[-`{-~]", F.col("t")).alias("special"))
    n, k, long = F.col("n"), F.col("k"), F.col("long")
    found = {
        "too_short": (n < 10, 0.5), "too_long": (n > 10_000, 0.8), "few_characters": ((n == 0) | (F.col("distinct") < 0.1 * n), 0.6), "repeated_word": ((k > 0) & (F.col("most") > 0.3 * k), 0.7),
        "few_letters": (F.col("letters") < 0.5, 0.8), "short_sentences": ((k > 0) & (long < 3), 0.7), "long_sentences": (long > 50, 0.8), "special_characters": (F.col("special") > 0.1, 0.8),
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, (c, _) in found.items()]))
    score = F.lit(1.0)
    for c, penalty in found.values():
        score = score * F.when(c, penalty).otherwise(1.0)
    return facts.select("doc_id", F.array_join(issues, ",").alias("issues"), score.alias("score"))


def issue_summary(df: DataFrame) -> DataFrame:
    """``issue, n, share, mean_score`` over (doc_id, issues, score): how many texts have each issue, and their mean score."""
    total = F.broadcast(df.agg(F.count("*").alias("all_")))
    named = df.where("issues <> ''").select("score", F.explode(F.split("issues", ",")).alias("issue"))
    return named.groupBy("issue").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).crossJoin(total).select("issue", "n", (F.col("n") / F.col("all_")).alias("share"), "mean_score")


def language(df: DataFrame, profiles: dict[str, list[str]] | None = None) -> DataFrame:
    """``doc_id, language, hits``: the language with most of its frequent words in the text; ties go to the first name."""
    profiles = profiles or STOP_WORDS
    rows = df.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    count = lambda stops: F.size(F.filter("w", lambda x: x.isin(*stops)))
    scores = F.array(*[F.struct(count(s).alias("hits"), F.lit(-i).alias("order"), F.lit(n).alias("language")) for i, (n, s) in enumerate(sorted(profiles.items()))])
    best = F.array_max(scores)
    return rows.select("doc_id", F.when(best["hits"] > 0, best["language"]).alias("language"), best["hits"].alias("hits"))


def corpus_statistics(df: DataFrame) -> DataFrame:
    """One row: documents, words, vocabulary, words and characters per document."""
    t = terms(df)
    vocabulary = t.groupBy("term").agg(F.sum("n").alias("n")).agg(F.count("*").alias("vocabulary"), F.sum("n").alias("words"))
    docs = df.agg(F.count("*").alias("documents"), F.avg(F.char_length("text")).alias("mean_chars"))
    return docs.crossJoin(F.broadcast(vocabulary)).withColumn("mean_words", F.col("words") / F.col("documents"))


def top_words(df: DataFrame, k: int = 20) -> DataFrame:
    return terms(df).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("documents")).orderBy(F.desc("n"), "term").limit(k)


def _weighted(df: DataFrame, least_df: int = 2, most_df: float = 0.95) -> DataFrame:
    """``doc_id, v``: each document's terms (term, n, w), rarest first, by TF-IDF and at length 1; none without terms.

    Blocks of documents send their distinct terms and get back how many documents have them; no word leaves its block.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    blocks = token_blocks(df, words(F.col("text")))
    n_docs = df.agg(F.count_distinct("doc_id")).first()[0]
    here = stored(blocks.mapInArrow(_term_documents, "block long, i int, term string, df long"), "terms")
    known = here.groupBy("term").agg(F.sum("df").alias("df")).where((F.col("df") >= least_df) & (F.col("df") <= most_df * n_docs))
    back = here.select("block", "i", "term").join(known, "term").select("block", "i", "df")
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_vectors(n_docs), f"doc_id {kind}, v array<struct<term string, n long, w double>>")


def _term_documents(batches):
    """``block, i, term, df``: a block's words and how many of its documents have them."""
    for b in blocks_of(batches):
        df = np.bincount(b.counts()[1], minlength=len(b.words)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(df), b.block)), pa.array(np.arange(len(df), dtype=np.int32)), b.words, pa.array(df)], names=["block", "i", "term", "df"])


def _vectors(n_docs: int):
    """A block's documents as vectors of its terms with known frequencies."""

    def run(block: pa.Table, back: pa.Table) -> pa.Table:
        b, df = Block(block), np.zeros(len(block.column("words")[0]), np.int64)
        df[back.column("i").to_numpy()] = back.column("df").to_numpy()
        row, term, n = b.counts()
        kept = df[term] > 0
        row, term, n = row[kept], term[kept], n[kept]
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.argsort(np.argsort(b.words.to_numpy(zero_copy_only=False))), df))] = np.arange(len(df))
        order = np.lexsort((rank[term], row))
        row, term, n = row[order], term[order], n[order]
        w = (1 + np.log(n)) * (np.log((1 + n_docs) / (1 + df[term])) + 1)
        w /= np.sqrt(np.bincount(row, w * w, len(b.sizes)))[row]
        size = np.bincount(row, minlength=len(b.sizes))
        some = np.nonzero(size)[0]
        v = pa.StructArray.from_arrays([b.words.take(pa.array(term)), pa.array(n.astype(np.int64)), pa.array(w)], names=["term", "n", "w"])
        return pa.table({"doc_id": b.docs.take(pa.array(some)), "v": listed(v, np.r_[0, np.cumsum(size[some])])})

    return run


def tf_idf(df: DataFrame, *, least_df: int = 2, most_df: float = 0.95) -> DataFrame:
    """``doc_id, term, weight``: (1 + ln tf) · (ln((1 + N) / (1 + df)) + 1), each document at length 1.

    Terms in fewer than ``least_df`` or over ``most_df`` of the documents are left out.
    """
    return _weighted(df, least_df, most_df).select("doc_id", F.explode("v").alias("v")).select("doc_id", "v.term", F.col("v.w").alias("weight"))


def similar_documents(df: DataFrame, *, limit: float = 0.7, k: int = 20) -> DataFrame:
    """``doc_a, doc_b, similarity``: the ``k`` most similar pairs by cosine of TF-IDF above ``limit``; no pair is lost.

    Documents of equal terms are one class with similarity 1; the ``k + 1`` smallest ids of a class hold its first ``k``
    pairs. Classes are searched above falling bounds until ``k`` pairs lie safely above one, at last above ``limit``.
    """
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    same = F.sha2(F.array_join(F.transform("v", lambda x: F.concat_ws(":", x["term"], x["n"])), " "), 256)
    docs = stored(_weighted(df).select("doc_id", same.alias("class"), F.transform("v", lambda x: F.struct(x["term"].alias("term"), x["w"].alias("w"))).alias("v")), "vectors")
    # ranks are of ids alone; vectors stay where they are but for those of the first document of each class
    ids = cut(docs.select("class", "doc_id").withColumn("i", F.row_number().over(Window.partitionBy("class").orderBy("doc_id"))).where(F.col("i") <= k + 1))
    # norms over two of three classes of terms differ by no more than the vectors do
    part = lambda h: F.sqrt(square(F.filter("v", lambda x: F.pmod(F.xxhash64(x["term"]), F.lit(3)) == h)))
    firsts = _only(docs, ids.where("i = 1").select("doc_id"), "doc_id").select("class", "v", part(0).alias("f0"), part(1).alias("f1"))
    left, right = ids.select("class", F.col("doc_id").alias("l"), F.col("i").alias("il")), ids.select("class", F.col("doc_id").alias("r"), F.col("i").alias("ir"))
    within = left.join(right, "class").where("il < ir").select("l", "r", F.lit(1.0).alias("similarity"))
    bounds = [b for b in (1 - 2e-6, 0.95, 0.85) if b > limit] + [limit]
    for bound in bounds:
        alike = _class_pairs(firsts, bound)
        across = alike.join(left.withColumnRenamed("class", "ca"), "ca").join(right.withColumnRenamed("class", "cb"), "cb").select("l", "r", "similarity")
        pairs = within.unionByName(across).select(F.least("l", "r").alias("doc_a"), F.greatest("l", "r").alias("doc_b"), "similarity").where(F.col("similarity") > limit)
        top = pairs.orderBy(F.desc(F.round("similarity", 6)), "doc_a", "doc_b").limit(k)
        rows = top.collect()  # at most k
        if len(rows) == k and round(rows[-1]["similarity"], 6) - 1e-6 >= bound:
            break
    return df.sparkSession.createDataFrame(rows, top.schema)


def _only(df: DataFrame, keys: DataFrame, on: str, few: int = 500_000) -> DataFrame:
    """The rows of ``df`` whose key is in ``keys``; without moving them where the keys are few enough to be broadcast."""
    return df.join(F.broadcast(keys) if keys.count() <= few else keys, on, "left_semi")


def _class_pairs(firsts: DataFrame, bound: float) -> DataFrame:
    """``ca, cb, similarity`` of all pairs of unit vectors (class, v, f0, f1) with a cosine above ``bound``.

    ``v`` has rare terms first. A term belongs to the prefix while the squares before it sum to at most 1 - bound²: the rest is
    shorter than ``bound``, so vectors without a common prefix term are not above it (Cauchy-Schwarz). Close vectors
    also lie in neighbouring cells of f0 and f1.
    """
    width = (2 * (1 - bound)) ** 0.5 + 1e-6
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    prefix = F.aggregate("v", start, lambda a, x: F.struct((a["s"] + x["w"] * x["w"]).alias("s"), (a["n"] + F.when(a["s"] <= 1 - bound * bound + 1e-9, 1).otherwise(0)).alias("n")))["n"]
    cell = lambda c: F.floor(F.col(c) / width)
    rare = firsts.select("class", F.slice(F.transform("v", lambda x: x["term"]), F.lit(1), prefix).alias("t"), cell("f0").alias("g0"), cell("f1").alias("g1"))
    here = rare.select(F.col("class").alias("ca"), F.explode("t").alias("term"), "g0", "g1")
    around = F.array(*[F.array(F.col("g0") + i, F.col("g1") + j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    there = rare.select(F.col("class").alias("cb"), F.explode("t").alias("term"), around.alias("g")).select("cb", "term", F.explode("g").alias("g")).select("cb", "term", F.col("g")[0].alias("g0"), F.col("g")[1].alias("g1"))
    pairs = here.join(there, ["term", "g0", "g1"]).where("ca < cb").select("ca", "cb").distinct()
    pairs = cut(pairs)  # only vectors that are in a pair move
    used = _only(firsts, pairs.select(F.col("ca").alias("class")).unionByName(pairs.select(F.col("cb").alias("class"))).distinct(), "class").select("class", "v")
    full = pairs.join(used.select(F.col("class").alias("ca"), F.col("v").alias("va")), "ca").join(used.select(F.col("class").alias("cb"), F.map_from_entries("v").alias("vb")), "cb")
    dot = F.aggregate("va", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at("vb", x["term"]), F.lit(0.0)))
    return full.select("ca", "cb", dot.alias("similarity")).where(F.col("similarity") > bound)


def sentiment(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``doc_id, valence, score, label`` by a lexicon (term, valence): s / √(s² + 15), labelled at ±0.05."""
    found = terms(df).join(F.broadcast(lexicon), "term").groupBy("doc_id").agg(F.sum(F.col("n") * F.col("valence")).alias("valence"))
    rows = df.select("doc_id").join(found, "doc_id", "left").withColumn("valence", F.coalesce(F.col("valence").cast("double"), F.lit(0.0)))
    scored = rows.withColumn("score", F.col("valence") / F.sqrt(F.col("valence") * F.col("valence") + 15))
    return scored.withColumn("label", F.when(F.col("score") >= 0.05, "positive").when(F.col("score") <= -0.05, "negative").otherwise("neutral"))


def entities(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """``kind, entity, n, documents`` of pattern entities."""
    kinds = kinds or ENTITIES
    found = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), _tagged(k)) for k, p in kinds.items()])
    rows = df.where("text IS NOT NULL").select("doc_id", F.explode(found).alias("e"))
    return rows.groupBy("e.kind", "e.entity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def _tagged(kind: str):
    return lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("entity"))


def topics(df: DataFrame, *, k: int = 5, words_each: int = 10, vocabulary: int = 2000, rounds: int = 10, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Topic model: ``topic, term, weight, rank``, and ``doc_id, topic, confidence`` of the dominant topic."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    rows = df.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    counter = CountVectorizer(inputCol="w", outputCol="features", vocabSize=vocabulary, minDF=2).fit(rows)
    counted = counter.transform(rows)
    model = LDA(k=k, maxIter=rounds, seed=seed).fit(counted)
    names = F.array(*[F.lit(x) for x in counter.vocabulary])
    listed = model.describeTopics(words_each).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("i", "t"))
    described = listed.select("topic", F.element_at(names, F.col("t.termIndices") + 1).alias("term"), F.col("t.termWeights").alias("weight"), (F.col("i") + 1).alias("rank"))
    share = vector_to_array("topicDistribution")
    dominant = model.transform(counted).select("doc_id", (F.array_position(share, F.array_max(share)) - 1).alias("topic"), F.array_max(share).alias("confidence"))
    return described, dominant


def choose_topics(df: DataFrame, ks: tuple[int, ...] = (2, 4, 8), *, vocabulary: int = 2000, rounds: int = 5, seed: int = 1) -> DataFrame:
    """``k, perplexity, best``: the bound on perplexity of topic models on the fifth of the documents that they did not see."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    rows = df.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    counted = cut(CountVectorizer(inputCol="w", outputCol="features", vocabSize=vocabulary, minDF=2).fit(rows).transform(rows).select("doc_id", "features"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    found = [(k, float(LDA(k=k, maxIter=rounds, seed=seed).fit(counted.where(~held)).logPerplexity(counted.where(held)))) for k in ks]
    least = min(p for _, p in found)
    return df.sparkSession.createDataFrame([(k, p, p == least) for k, p in found], "k int, perplexity double, best boolean")


def topic_quality(described: DataFrame, best: int = 5) -> DataFrame:
    """One row ``quality, topics``: mean weight of the best terms of each topic."""
    return described.where(F.col("rank") <= best).agg(F.avg("weight").alias("quality"), F.count_distinct("topic").alias("topics"))


def embeddings(df: DataFrame, size: int = 32, seed: int = 1, *, part: int = 16_000_000, least: int = 5) -> DataFrame:
    """``doc_id, embedding``: mean of word vectors trained on the corpus; words that come less than ``least`` times count as zero.

    Each block of about ``part`` characters, a million words at most, trains its words (skip-grams with negative samples), and the vectors of a word
    are averaged over the blocks that saw it; a corpus of one block is trained in one task. Vectors start from a word's hash, the same in all
    blocks. Words and vectors meet by shuffles, so that neither the driver nor a task holds the vocabulary.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    blocks = token_blocks(df, words(F.col("text")), size=min(TOKENS, max(1, part // 6)))
    here = stored(blocks.mapInArrow(_term_counts, "block long, i int, term string, n long"), "terms")
    known = here.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("term")
    back = here.join(known, "term").select("block", "i", F.xxhash64("term", F.lit(seed)).alias("h"))
    trained = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_trained(size), "block long, i int, term string, " + ", ".join(f"q{j} float" for j in range(size)))
    means = stored(trained.groupBy("term").agg(F.collect_list(F.struct("block", "i")).alias("at"), *[F.avg(f"q{j}").alias(f"q{j}") for j in range(size)]), "vectors")
    sent = means.select(F.explode("at").alias("at"), *[f"q{j}" for j in range(size)]).select("at.block", "at.i", *[f"q{j}" for j in range(size)])
    found = blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_document_means(size), f"doc_id {kind}, embedding array<double>")
    nothing = F.array_repeat(F.lit(0.0), size)
    return df.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("embedding", nothing).alias("embedding"))


def _term_counts(batches):
    """``block, i, term, n``: a block's words and how often they come."""
    for b in blocks_of(batches):
        n = np.bincount(b.tokens, minlength=len(b.words)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), b.block)), pa.array(np.arange(len(n), dtype=np.int32)), b.words, pa.array(n)], names=["block", "i", "term", "n"])


#: Words to either side that a word is trained on, samples of other words for a step, words of a step, moves of a word in a step.
_WINDOW, _OTHERS, _STEP, _MOST = 5, 16, 1000, 10


def _trained(size: int, rate: float = 0.1):
    """``block, i, term, q0, …`` of a block's words that came ``back`` (i, h): their vectors after one pass over the block."""

    def run(block: pa.Table, back: pa.Table) -> pa.Table:
        b = Block(block)
        place = back.column("i").to_numpy()
        code = np.full(len(b.words), -1)
        code[place] = np.arange(len(place))
        t = code[b.tokens]
        row, t = b.row[t >= 0], t[t >= 0]
        x = _start(back.column("h").to_numpy(), size)
        y = np.zeros_like(x)
        rng = np.random.default_rng(b.block)
        often = np.cumsum(np.bincount(t, minlength=len(x)) ** 0.75)
        reach = rng.integers(1, _WINDOW + 1, len(t))
        for a in range(0, len(t), _STEP):
            centre, near = [], []
            for o in [k for o in range(1, _WINDOW + 1) for k in (-o, o)]:
                at = np.arange(max(a, -o), min(a + _STEP, len(t) - max(o, 0)))
                at = at[(row[at] == row[at + o]) & (reach[at] >= abs(o))]
                centre.append(t[at]), near.append(t[at + o])
            centre, near = np.concatenate(centre), np.concatenate(near)
            if not len(centre):
                continue
            others = np.minimum(np.searchsorted(often, rng.random(_OTHERS) * often[-1], side="right"), len(x) - 1)
            left, right, wrong = x[near], y[centre], y[others]
            pull = 1 / (1 + np.exp(np.einsum("ij,ij->i", left, right)))
            push = np.float32(_WINDOW / _OTHERS) / (1 + np.exp(-left @ wrong.T))
            push[centre[:, None] == others] = 0
            step = np.float32(rate * max(1 - a / len(t), 1e-4))
            _moved(x, near, step * (pull[:, None] * right - push @ wrong))
            _moved(y, centre, step * pull[:, None] * left)
            np.add.at(y, others, -step * np.float32(min(1, _MOST / len(near))) * (push.T @ left))
        names = b.words.take(pa.array(place))
        return pa.table([pa.array(np.full(len(x), b.block)), pa.array(place), names, *[pa.array(x[:, j]) for j in range(size)]], names=["block", "i", "term", *[f"q{j}" for j in range(size)]])

    return run


def _start(h: np.ndarray, size: int) -> np.ndarray:
    """Small random vectors that depend on hashes alone."""
    bits = h.astype(np.uint64)[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        bits = (bits ^ (bits >> np.uint64(shift))) * np.uint64(factor)
    return (((bits >> np.uint64(11)).astype(float) / 2**53 - 0.5) / size).astype(np.float32)


def _moved(x: np.ndarray, rows: np.ndarray, by: np.ndarray) -> None:
    """Adds ``by`` to some rows; one that comes over ``_MOST`` times moves by so many times its mean, so that a step doesn't overshoot."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    n = np.diff(np.r_[first, len(rows)])
    x[rows[first]] += np.add.reduceat(by[order], first) * np.minimum(1, _MOST / n).astype(np.float32)[:, None]


def _document_means(size: int):
    """``doc_id, embedding``: the sums of a block's vectors (i, q0, …) by document, over its number of words."""

    def run(block: pa.Table, sent: pa.Table) -> pa.Table:
        b, out = Block(block), np.empty((len(block.column("sizes")[0]), size))
        for j in range(size):
            q = np.zeros(len(b.words))
            q[sent.column("i").to_numpy()] = sent.column(f"q{j}").to_numpy()
            out[:, j] = np.bincount(b.row, q[b.tokens], len(out)) / b.sizes
        return pa.table({"doc_id": b.docs, "embedding": listed(pa.array(out.ravel()), np.arange(len(out) + 1) * size)})

    return run


def _parts(df: DataFrame, part: int) -> int:
    """How many tasks share the texts, at about ``part`` characters each."""
    return max(1, math.ceil((df.agg(F.sum(F.char_length("text"))).first()[0] or 0) / part))


def classify(train: DataFrame, label: str, test: DataFrame, *, features: int = 1 << 12) -> DataFrame:
    """``doc_id, prediction, probability`` of a logistic regression on TF-IDF of hashed words."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    prepared = lambda d: d.withColumn("w", words(F.coalesce("text", F.lit(""))))
    pipe = Pipeline(stages=[HashingTF(inputCol="w", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol=label, maxIter=20, regParam=0.01)])
    out = pipe.fit(prepared(train)).transform(prepared(test))
    return out.select("doc_id", F.col("prediction").cast("int").alias("prediction"), F.array_max(vector_to_array("probability")).alias("probability"))


def classified_folds(df: DataFrame, label: str, *, key: str = "doc_id", k: int = 3, seed: int = 42, features: int = 1 << 12) -> DataFrame:
    """``fold, label, support, guessed, hit, precision, recall, f1, accuracy`` of :func:`classify` on each fold.

    Folds go by the hash of ``key``, so that copies with one key stay together; accuracy is the fold's, on each of its rows.
    """
    from tabulon.operators.metrics import class_report

    fold = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k))
    rows, out = cut(df.where(F.col(label).isNotNull()).withColumn("fold_", fold)), None
    for f in range(k):
        test = rows.where(F.col("fold_") == f)
        guessed = classify(rows.where(F.col("fold_") != f), label, test, features=features).join(test.select("doc_id", F.col(label).cast("int").alias("actual_")), "doc_id")
        every = Window.partitionBy()  # a row for each class
        part = class_report(guessed, "actual_", "prediction").withColumn("accuracy", F.sum("hit").over(every) / F.sum("support").over(every))
        part = part.select(F.lit(f).alias("fold"), *part.columns)
        out = part if out is None else out.unionByName(part)
    return out


def augment(df: DataFrame, copies: int = 1, seed: int = 1) -> DataFrame:
    """``df`` rows plus copies with two neighbouring words swapped, chosen by the hash of id and copy."""
    w = F.split("text", " ")
    made = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    at = F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed)), F.greatest(F.size(w) - 1, F.lit(1))).cast("int") + 1
    swapped = F.when(F.size(w) < 2, w).otherwise(F.concat(F.slice(w, F.lit(1), at - 1), F.array(F.element_at(w, at + 1), F.element_at(w, at)), F.slice(w, at + 2, F.greatest(F.size(w) - at - 1, F.lit(0)))))
    return df.withColumn("copy", F.lit(0)).unionByName(made.withColumn("text", F.array_join(swapped, " ")))


def with_synonyms(df: DataFrame, synonyms: DataFrame, share: float = 0.3, seed: int = 1) -> DataFrame:
    """``df`` with words replaced by their synonym (term, synonym) where the hash of document, place and word falls under
    ``share``; the table is collected into one map, so it should be a small dictionary."""
    held = F.broadcast(synonyms.groupBy("term").agg(F.min("synonym").alias("synonym")).agg(F.map_from_entries(F.collect_list(F.struct("term", "synonym"))).alias("map_")))
    chosen = lambda w, i: F.pmod(F.xxhash64("doc_id", i, w, F.lit(seed)), F.lit(1000)) < int(share * 1000)
    new = F.transform(F.split("text", " "), lambda w, i: F.when(chosen(w, i), F.coalesce(F.try_element_at("map_", F.lower(w)), w)).otherwise(w))
    return df.crossJoin(held).withColumn("text", F.array_join(new, " ")).select(*df.columns)


def with_insertions(df: DataFrame, times: int = 1, seed: int = 1) -> DataFrame:
    """``df`` with ``times`` words of each text repeated at another place, both chosen by the hash of the document; texts of under
    three words stay."""
    pick = lambda w, extra, what, i: F.pmod(F.xxhash64("doc_id", F.lit(what), F.lit(i), F.lit(seed)), (F.size(w) + extra).cast("long")).cast("int") + 1
    out = df.withColumn("w_", F.split("text", " "))
    for i in range(times):
        w = F.col("w_")
        at = pick(w, 1, "place", i)
        grown = F.concat(F.slice(w, F.lit(1), at - 1), F.array(F.element_at(w, pick(w, 0, "word", i))), F.slice(w, at, F.greatest(F.size(w) - at + 1, F.lit(0))))
        out = out.withColumn("w_", F.when(F.size(w) < 3, w).otherwise(grown))
    return out.withColumn("text", F.array_join("w_", " ")).select(*df.columns)


def business_metrics(df: DataFrame, label: str, sentiments: DataFrame) -> DataFrame:
    """One row: volume, mean length, share of distinct texts, dominant class and balance of ``label``, shares of sentiments.

    ``sentiments`` is the result of :func:`sentiment`. Texts are compared by their SHA-256; ties of classes go to the smaller.
    """
    shown = df.agg(F.count("*").alias("volume"), F.avg(F.char_length("text")).alias("mean_length"), F.try_divide(F.count_distinct(F.sha2("text", 256)), F.count("text")).alias("content_diversity"))
    by = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    classes = by.agg(F.min(F.struct(-F.col("n"), F.col("label")))["label"].alias("dominant_class"), (1 - F.try_divide(F.max("n") - F.min("n"), F.sum("n"))).alias("class_balance"))
    felt = sentiments.agg(*[F.try_divide(F.count_if(F.col("label") == v), F.count("*")).alias(f"{v}_ratio") for v in ("positive", "negative")])
    return shown.crossJoin(F.broadcast(classes)).crossJoin(F.broadcast(felt))


def similarity_summary(pairs: DataFrame) -> DataFrame:
    """One row ``pairs, mean, std, least, most`` of similarities."""
    s = F.col("similarity")
    return pairs.agg(F.count(s).alias("pairs"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.min(s).alias("least"), F.max(s).alias("most"))


def cost_estimate(df: DataFrame, per_million: float = 2.0) -> DataFrame:
    """One row ``documents, characters, cost``."""
    return df.agg(F.count("*").alias("documents"), F.sum(F.char_length("text")).alias("characters")).withColumn("cost", F.col("characters") / 1e6 * per_million)


def most_and_least(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row ``most, least``: the keys of the largest and smallest value; ties go to the smaller key."""
    return df.agg(F.max_by(key, F.struct(value, -F.col(key))).alias("most"), F.min_by(key, F.struct(value, key)).alias("least"))


def share_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
