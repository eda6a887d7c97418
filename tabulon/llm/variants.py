"""Spelling variants: words of a corpus that differ by one letter, and the frequent form that each of them stands for.

Two words are one edit apart if and only if the lengths of their common prefix and of their common suffix add up to the
longer length less one. So the middle splits them: one of the two covers at least half of that, and words meet only in
groups of equal length class with an equal first or last half. A group that is still crowded is split by the halves of what
its words don't share yet, down to groups whose words differ in one place, which an alphabet bounds. Inside a group, padded
code-point matrices of blocks of words are compared, dense and without Python loops over pairs. A pair belongs to the
prefix side where both sides would hold it, so that it is found once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import cut, lower_ascii, table

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Groups of more words are split further.
CROWD = 256
#: Keys of crowded groups that may be broadcast.
FEW = 100_000
#: Elements of the matrices of one block of pairs.
TILE = 4_000_000

_KEY = ["size", "head_size", "tail_size", "below", "head", "tail"]


def word_counts(docs: DataFrame, *, every: int = 31, least_length: int = 7, least: int = 2) -> DataFrame:
    """``word, n``: runs of letters by number of occurrences, after deletions by hash.

    A run whose ``crc32("<doc_id>:<run>")`` is a multiple of ``every`` loses its code point at the hash modulo its length.
    A null text has no words; a null doc_id reads as an empty string.
    """
    run, h = F.col("run"), F.col("h")
    at = (h % F.char_length(run)).cast("int")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.where(F.char_length(run) >= least_length).select("run", F.crc32(F.concat_ws(":", "d", "run")).alias("h"))
    words = hashed.select(F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _place(size: Column, head: Column, tail: Column, below: Column) -> Column:
    return F.struct(size.alias("size"), head.alias("head_size"), tail.alias("tail_size"), below.alias("below"))


def _halves(size: Column, head: Column, tail: Column, below: Column) -> list[Column]:
    """The two places that a place splits into: a longer common prefix, or a longer suffix and a prefix that stays below."""
    t = F.floor((size - head - tail) / 2).cast("int")
    return [_place(size, head + t, tail, below), _place(size, head, tail + t, F.least(below, head + t))]


def _keyed(rows: DataFrame) -> DataFrame:
    """Words at a place with what they must share there."""
    length = F.char_length("word")
    return rows.select("p.*", "word", "n").select(
        "size", "head_size", "tail_size", "below", F.substr("word", F.lit(1), F.col("head_size")).alias("head"), F.substr("word", (length - F.col("tail_size") + 1).cast("int"), F.col("tail_size")).alias("tail"), "word", "n"
    )


def groups(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``size, below, members array<struct<word, n>>``: groups of two words or more that may be one edit apart.

    ``size`` is the longer length of a pair, ``below`` what its common prefix must stay below. Only the keys of groups of
    over ``crowd`` words are looked at between rounds; each round halves what a crowded group's words don't share.
    """
    length = F.char_length("word").cast("int")
    whole = [(length + d, F.lit(0), F.lit(0), length + d + 1) for d in (0, 1)]
    rows = _keyed(words.select(F.explode(F.array(*[h for w in whole for h in _halves(*w)])).alias("p"), "word", "n"))
    found = []
    while True:
        open_ = F.col("size") - F.col("head_size") - F.col("tail_size") > 1
        crowded = cut(rows.where(open_).groupBy(*_KEY).agg(F.count("*").alias("m_")).where(F.col("m_") > crowd).drop("m_"))
        keys = crowded.count()
        if not keys:
            break
        side = F.broadcast(crowded) if keys <= FEW else crowded
        found.append(rows.join(side, _KEY, "left_anti"))
        split = rows.join(side, _KEY, "left_semi")
        rows = _keyed(split.select(F.explode(F.array(*_halves(*(F.col(c) for c in _KEY[:4])))).alias("p"), "word", "n"))
    for f in found:
        rows = rows.unionByName(f)
    return rows.groupBy(*_KEY).agg(F.collect_list(F.struct("word", "n")).alias("members")).where(F.size("members") > 1).select("size", "below", "members")


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and code points padded on the right and on the left."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    kind = np.uint8 if points.max(initial=0) < 256 else np.uint32
    width = int(lengths.max())
    row = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left, right = np.zeros((len(words), width), kind), np.zeros((len(words), width), kind)
    left[row, column] = points
    right[row, np.repeat(lengths, lengths) - 1 - column] = points  # from the end
    return lengths, left, right


def near_pairs(sizes: np.ndarray, below: np.ndarray, words: list[str], members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` of all pairs one edit apart within groups of ``members`` words each, which lie one after the other."""
    lengths, left, right = _matrices(words)
    size, limit = np.repeat(sizes, members), np.repeat(below, members)
    ends = np.repeat(np.cumsum(members), members)
    partners = ends - np.arange(len(words)) - 1
    upto = np.cumsum(partners)
    step = max(1, TILE // left.shape[1])
    first, second = [], []
    for begin in range(0, int(upto[-1]) if len(upto) else 0, step):
        k = np.arange(begin, min(begin + step, int(upto[-1])))
        i = np.searchsorted(upto, k, side="right")
        j = i + 1 + k - (upto[i] - partners[i])
        longest = (lengths[i] == size[i]) | (lengths[j] == size[i])
        i, j = i[longest], j[longest]
        prefix = (left[i] != left[j]).argmax(axis=1)
        suffix = (right[i] != right[j]).argmax(axis=1)
        near = (prefix < limit[i]) & (prefix + suffix >= size[i] - 1)
        first.append(i[near])
        second.append(j[near])
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, int), np.zeros(0, int))


def _compare(batches):
    """Groups of an Arrow batch, those of like word lengths together, as pairs of words with their counts."""
    import pyarrow as pa

    for batch in batches:
        size, below = (np.asarray(batch.column(c)) for c in (0, 1))
        lists = batch.column(2)
        offsets = np.asarray(lists.offsets)
        held = lists.values
        word, n = held.field("word"), held.field("n")
        like = np.frompyfunc(int.bit_length, 1, 1)(size.astype(object)).astype(int)
        for c in np.unique(like):
            rows = np.flatnonzero(like == c)
            for at in range(0, len(rows), 2048):
                part = rows[at : at + 2048]
                places = pa.array(np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in part]))
                w, m = word.take(places), n.take(places)
                i, j = near_pairs(size[part], below[part], w.to_pylist(), offsets[part + 1] - offsets[part])
                i, j = pa.array(i), pa.array(j)
                yield pa.RecordBatch.from_arrays([w.take(i), m.take(i), w.take(j), m.take(j)], names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``word, n, near, near_n``: all pairs of ``words`` (word, n) that are one edit apart, in both directions, each once."""
    pairs = groups(words, crowd).mapInArrow(_compare, "word string, n long, near string, near_n long")
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where following ``word, form`` ends, by doubling the steps until none moves; ``forms`` has no cycle."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.drop("moved")


def variants(docs: DataFrame, *, times: int = 10, every: int = 31, least_length: int = 7, least: int = 2, crowd: int = CROWD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (doc_id, text).

    A word's form is its near word of largest n (of those the smallest), if that n is at least ``times`` its own; its root
    is the end of the chain of forms, or the word itself. Null and empty texts have no words; repeated rows count again;
    other columns are ignored, whatever their names; an empty table gives no rows. A word of any length is compared whole.
    """
    words = cut(word_counts(docs.select("doc_id", "text"), every=every, least_length=least_length, least=least))
    best = near_words(words, crowd).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best"))
    found = words.join(best, "word", "left")
    close = -F.col("best.m") >= times * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(close, F.col("best.near")).alias("form"), F.when(close, -F.col("best.m")).alias("form_n")))
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of ``documents``."""
    return variants(table(spark, sf_dir, "documents"))


#: The twin: hashes bit by bit, near words through equal words after one deletion.
OP12_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), each_run AS (
  SELECT d, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY d, run
), bytes AS (
  SELECT run, k, flatten(list_transform(string_split(d || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END)) AS b
  FROM each_run
), hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda h, x:
      list_reduce(list_prepend(xor(h, x), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) AS h
  FROM bytes
), changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run) + 2)::INT) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), shorter AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near
), found AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), walk AS (
  SELECT word, word AS root, 0 AS step FROM found
  UNION ALL
  SELECT k.word, f.form, k.step + 1 FROM walk k JOIN found f ON f.word = k.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, arg_max(k.root, k.step) AS root, f.n, f.n_near, f.form_n
FROM found f JOIN walk k ON k.word = f.word
GROUP BY f.word, f.form, f.n, f.n_near, f.form_n
"""
