"""Quality rules: document statistics judged by fixed limits and by gradient-boosted trees.

The trees are fitted on a bounded sample of labelled documents, with the direction of some statistics fixed, and then
score all documents in blocks from flat node arrays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import keep_texts, map_blocks, table
from tabulon.llm.trees import Forest, boost

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Statistics that the trees see, and the direction in which each may move the verdict (0: either).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_char": -1,
    "dup_lines_share": -1,
    "repeat_words_share": -1,
    "distinct_words_share": 0,
    "upper_share": -1,
    "digit_share": -1,
    "other_punctuation_share": 0,
    "end_marks_per_word": 0,
    "words_per_line": 0,
    "longest_word": 0,
    "exclaims_per_word": -1,
}

_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[128:] = 2  # parts of letters beyond ASCII, for the most part
for _c in ".?":
    _KIND[ord(_c)] = 4
_KIND[ord("!")] = 5
for _c in "\"'(),-/:;=@[\\]^_`{}~+":
    _KIND[ord(_c)] = 6


def _repeats(words: list[bytes]) -> int:
    """Words in windows of five that are found twice or more, the first time included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    mixed = ids[:n].astype(np.uint64)
    for k in range(1, WINDOW):
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (mixed >> np.uint64(29))
        mixed += ids[k : k + n].astype(np.uint64)
    if len(np.unique(mixed)) == n:  # different hashes, so different windows
        return 0
    rank, size = ids, 1
    for step in (1, 2, 1):  # exact numbers of windows of 2, 4 and 5 words from those of shorter ones
        tail = rank[size:] if step == size else ids[size:]
        head = rank[: len(tail)]
        _, rank = np.unique(head * (int(tail.max()) + 1) + tail, return_inverse=True)
        size += step
    often = np.bincount(rank)[rank] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return int((marks.cumsum()[:-1] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five base counts of a whole text, and the features for the trees."""
    raw = text.encode()
    words = raw.split()  # at ASCII blanks, as the word pattern has it
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    repeats = _repeats(words)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7) if raw else np.zeros(7, int)
    letters, size = max(1, int(kinds[1] + kinds[2])), max(1, len(text))
    features = [
        float(np.log1p(n)), chars / max(1, n), symbols / size, dup_lines / max(1, len(lines)), repeats / max(1, n), len(set(words)) / max(1, n), int(kinds[1]) / letters,
        int(kinds[3]) / size, int(kinds[6]) / size, int(kinds[4]) / max(1, n), n / max(1, len(lines)), float(max(map(len, words), default=0)), int(kinds[5]) / max(1, n),
    ]
    return [n, chars, symbols, dup_lines, repeats], features


def base_failed(counts: list[int]) -> bool:
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def train_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 4096, trees: int = 60, depth: int = 3, rate: float = 0.15) -> Forest | None:
    """The trees, from at most ``max_rows`` labelled documents (those whose id hashes lowest); None without both classes.

    Labels are ``doc_id, quality`` in 0/1; null ids and labels are left out. The labels' sample is broadcast, so the
    documents are read once and not shuffled.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").join(F.broadcast(sample), "doc_id")

    def work(doc_id, text, quality):
        return doc_id, quality, [statistics(t.as_py() or "")[1] for t in text]

    drawn = map_blocks(rows.select("doc_id", "text", "quality"), work, "doc_id long, quality int, features array<double>")
    found = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(max_rows).toPandas()
    y = found["quality"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    return boost(np.array(found["features"].tolist()), y, list(FEATURES.values()), trees=trees, depth=depth, rate=rate)


def judge(docs: DataFrame, forest: Forest | None, *, threshold: float = 0.5) -> DataFrame:
    """``docs`` (doc_id, text) with the base counts, ``base_failed``, ``score`` and ``kept``.

    ``kept`` is false if the base fails, else whether the trees' probability of good quality reaches ``threshold``;
    without trees (no labels of both classes) the base alone decides. A null text has no words, so its base fails. One
    row per row; repeated rows stay; other columns are ignored; an empty table gives no rows. No shuffle.
    """

    def work(doc_id, text):
        found = [statistics(t.as_py() or "") for t in text]
        failed = [base_failed(counts) for counts, _ in found]
        score = 1 / (1 + np.exp(-forest.score(np.array([f for _, f in found])))) if forest is not None else np.ones(len(found))
        counts = list(zip(*[c for c, _ in found], strict=True))
        return doc_id, *counts, failed, score, [not f and s >= threshold for f, s in zip(failed, score.tolist(), strict=True)]

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return map_blocks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), work, schema)


def keep_good(docs: DataFrame, forest: Forest | None, *, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns, in one pass without a join.

    A null or empty text fails the base, so its row goes; repeated rows stay or go together; an empty table gives no rows.
    Columns of any name beside ``text`` pass through. Without trees the base alone decides.
    """

    def keep(texts):
        found = [statistics(t.as_py() or "") for t in texts]
        score = 1 / (1 + np.exp(-forest.score(np.array([f for _, f in found])))) if forest is not None else np.ones(len(found))
        return [bool(not base_failed(c) and s >= threshold) for (c, _), s in zip(found, score.tolist(), strict=True)]

    return keep_texts(docs, keep)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train_quality(docs, table(spark, sf_dir, "labels")))
