"""Benchmark decontamination: edit-tolerant search for benchmark items in documents.

Windows of an item's length are embedded by CGK random walks, under which a small edit distance becomes a small Hamming
distance. Repeated sampling of a few embedded positions gives LSH keys; a window that shares a key with an item is a
candidate, which the exact edit distance then decides. Windows are laid where the text shares a run of words with an
item; a passage within the allowed edits always has such a run, so that no match is lost there.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import keep_texts, map_blocks, table

#: A-Z in lower case, ASCII punctuation as blanks; words are what blanks part.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
#: Share of an item's words that may differ, and the longest run of words looked for.
EDITS, RUN = 0.2, 3
#: Sampled positions in a key, walks, and the share of embedded positions taken to agree at the allowed edits. The number
#: of keys follows from it; the tests measure the recall that they give.
SAMPLED, WALKS, AGREE = 3, 8, 0.4
#: Bounds of one block of items; larger benchmarks are searched in several blocks.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
#: Words of windows, and places of runs, that are held at a time.
CELLS, HITS = 2_000_000, 2_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN).split()


def allowed(n: int) -> int:
    """Edits allowed in an item of ``n`` words."""
    return int(EDITS * n + 1e-9)


def distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance, in words, between ``item`` and any run of words of ``text``."""
    last = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, word in enumerate(item.tolist(), 1):
        row = np.empty_like(last)
        row[0] = i
        row[1:] = np.minimum(last[:-1] + (text != word), last[1:] + 1)
        # an inserted word costs one: the running minimum of value less position gives all insertions at once
        last = np.minimum.accumulate(row - steps) + steps
    return int(last.min())


class Index:
    """A block of items: vocabulary, runs of words with their places, CGK walks and LSH keys.

    Its size is a small multiple of the items' words: a walk's steps come from a hash of walk, position and word, and only
    the sampled positions of an embedding are kept.
    """

    def __init__(self, items: tuple[tuple[int, str], ...], recall: float, seed: int = 7):
        kept = [(i, w) for i, t in items if (w := words_of(t))]
        self.item_ids = [i for i, _ in kept]
        self.number: dict[bytes, int] = {}
        self.items = [np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], np.int64) for _, w in kept]
        self.lengths = np.array([len(w) for w in self.items], np.int64)
        self.edits = np.array([allowed(n) for n in self.lengths.tolist()], np.int64)
        self.width = int(self.lengths.max(initial=1))
        self.base = len(self.number) + 2  # 0: a word of no item; the last number: past a window's end
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - AGREE**SAMPLED) / WALKS)
        rng = np.random.default_rng(seed)
        odd = lambda *shape: rng.integers(1, 1 << 62, shape, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.of_word, self.of_step, self.mix = odd(self.base), odd(WALKS, 2 * self.width), odd(SAMPLED)
        self.samples = {int(n): rng.integers(0, 2 * n, (WALKS, self.tables, SAMPLED)) for n in np.unique(self.lengths)}
        self._index_runs()
        keys = np.empty((WALKS * self.tables, len(self.items)), np.uint64)
        flat = np.concatenate([*self.items, np.zeros(1, np.int64)])
        begin = np.cumsum(np.r_[0, self.lengths])[:-1]
        for part in _parts(self.lengths):
            keys[:, part] = self.lsh_keys(self._windows(flat, begin[part], self.lengths[part]), self.lengths[part])
        order = np.argsort(keys, axis=1, kind="stable")
        self.keys = [(k[o], o) for k, o in zip(keys, order, strict=True)]

    def _index_runs(self) -> None:
        """For each length of run: codes, and by code the pairs (item, offset) at which items have it."""
        found: dict[int, list] = {}
        for i, item in enumerate(self.items):
            n = len(item)
            size = min(RUN, n, -(-(n - allowed(n)) // (allowed(n) + 1)))
            codes = self.codes(item, size)
            found.setdefault(size, []).append((codes, np.column_stack([np.full(len(codes), i), np.arange(len(codes))])))
        self.runs = []
        for size, lists in sorted(found.items()):
            codes, places = (np.concatenate(x) for x in zip(*lists, strict=True))
            order = np.argsort(codes, kind="stable")
            codes, first = np.unique(codes[order], return_index=True)
            self.runs.append((size, codes, np.r_[first, len(order)], places[order]))

    def codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Codes of all runs of ``size`` words; -1 where a word of no item is in the run."""
        n = max(0, len(ids) - size + 1)
        code = np.zeros(n, np.int64)
        known = np.ones(n, bool)
        for k in range(size):
            code = code * self.base + ids[k : k + n]
            known &= ids[k : k + n] > 0
        return np.where(known, code, -1)

    def _windows(self, flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Windows of ``n`` words from ``begin`` on, each filled up to one word more than the longest."""
        columns = np.arange(int(n.max()) + 1)
        windows = flat[np.clip(begin[:, None] + columns, 0, len(flat) - 1)]
        windows[columns >= n[:, None]] = self.base - 1
        return windows

    def lsh_keys(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Keys by walk and sampling (rows) and window. A walk moves to the next word or stays, by position and word."""
        rows, last = np.arange(len(windows)), windows.shape[1] - 1
        of_length = [(n, np.flatnonzero(lengths == n)) for n in np.unique(lengths).tolist()]
        keys = np.repeat(lengths.astype(np.uint64)[None], WALKS * self.tables, axis=0)
        for walk in range(WALKS):
            wanted = sorted({int(j) for n, _ in of_length for j in self.samples[n][walk].ravel()})
            place = {j: k for k, j in enumerate(wanted)}
            seen = np.empty((len(wanted), len(windows)), np.uint64)
            at = np.zeros(len(windows), np.int64)
            for j in range(wanted[-1] + 1):
                word = windows[rows, at]
                if j in place:
                    seen[place[j]] = word
                step = (self.of_word[word] * self.of_step[walk, j]) >> np.uint64(63)
                at = np.minimum(at + step.astype(np.int64), last)
            for n, where in of_length:
                for t, positions in enumerate(self.samples[n][walk].tolist()):
                    key = keys[walk * self.tables + t, where]
                    for mix, position in zip(self.mix, positions, strict=True):
                        key = (key ^ seen[place[position], where]) * mix
                        key ^= key >> np.uint64(31)
                    keys[walk * self.tables + t, where] = key
        return keys

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """By text, its matches (item id, edits): items within their allowed edits of some passage."""
        get, gap = self.number.get, self.width + 1
        ids = [np.array([get(w, 0) for w in words_of(t)], np.int64) for t in texts]
        found: list[dict[int, int]] = [{} for _ in texts]
        starts = np.cumsum([gap, *(len(x) + gap for x in ids)])[:-1]
        flat = np.zeros(int(starts[-1]) + len(ids[-1]) + 2 * gap, np.int64)
        for at, x in zip(starts.tolist(), ids, strict=True):
            flat[at : at + len(x)] = x
        spots = [np.empty((0, 2), np.int64), *(s for run in self.runs for s in self._spots(flat, *run, margin=2 * gap))]
        spots = np.unique(np.concatenate(spots), axis=0)
        for part in _parts(spots[:, 1]):
            self._decide(spots[part], flat, starts, found)
        return [sorted((self.item_ids[i], d) for i, d in f.items()) for f in found]

    def _spots(self, flat, size, codes, cuts, places, *, margin):
        """Where windows are laid: (begin, words) at which a text shares enough runs with an item of that length.

        A passage within the allowed edits keeps all of the item's runs but those that an edit touches. Runs are taken in
        stretches of the text with a margin on both sides, so that a run of many items is not laid out at once.
        """
        run = self.codes(flat, size)
        at = np.flatnonzero(run >= 0)
        k = np.minimum(np.searchsorted(codes, run[at]), len(codes) - 1)
        hit = codes[k] == run[at]
        at, k = at[hit], k[hit]
        so_far = np.r_[0, np.cumsum(cuts[k + 1] - cuts[k])]
        first = 0
        while first < len(at):
            end = max(first + 1, int(np.searchsorted(so_far, so_far[first] + HITS, "right")) - 1)
            low, high = np.searchsorted(at, at[first] - margin, "left"), np.searchsorted(at, at[end - 1] + margin, "right")
            some = k[low:high]
            many = cuts[some + 1] - cuts[some]
            place = places[np.repeat(cuts[some], many) + np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)]
            here, item = np.repeat(at[low:high], many), place[:, 0]
            n, most = self.lengths[item], self.edits[item]
            key, reach = item * len(flat) + here, np.minimum(n + most, margin)
            order = np.sort(key)
            shared = np.searchsorted(order, key + reach, "right") - np.searchsorted(order, key - reach, "left")
            enough = (shared >= n - size + 1 - size * most) & (here >= at[first]) & (here <= at[end - 1])
            yield np.unique(np.column_stack([here - place[:, 1], n])[enough], axis=0)
            first = end

    def _decide(self, spots, flat, starts, found) -> None:
        begin, n = spots[:, 0], spots[:, 1]
        windows = self._windows(flat, begin, n)
        pairs = []
        for keys, (known, order) in zip(self.lsh_keys(windows, n), self.keys, strict=True):
            low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
            while (more := low < high).any():
                w = np.flatnonzero(more)
                pairs.append(np.column_stack([w, order[low[w]]]))
                low[w] += 1
        for w, i in np.unique(np.concatenate([np.empty((0, 2), np.int64), *pairs]), axis=0).tolist():
            item = self.items[i]
            if len(item) != n[w]:
                continue
            doc = int(np.searchsorted(starts, begin[w] + len(item) - 1, "right")) - 1
            best = found[doc].get(i)
            if best == 0:
                continue
            if np.array_equal(windows[w, : len(item)], item):
                found[doc][i] = 0
                continue
            most = allowed(len(item))
            near = flat[max(0, begin[w] - most) : begin[w] + len(item) + most]
            if most and (d := distance(item, near)) <= most and (best is None or d < best):
                found[doc][i] = d


def _parts(lengths: np.ndarray):
    """Numbers of windows in parts of similar lengths, each of ``CELLS`` words or fewer (or one window)."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        n = int(lengths[order[at]])
        end = int(np.searchsorted(lengths[order], max(2 * n, 32), "left"))
        end = max(at + 1, min(end, at + CELLS // (2 * n + 32)))
        yield order[at:end]
        at = end


@lru_cache(maxsize=2)
def index(items: tuple, recall: float) -> Index:
    """One index for each worker process."""
    return Index(items, recall)


def _blocks(benchmark: DataFrame) -> list[tuple[tuple[int, str], ...]]:
    """The items in blocks of bounded size, dealt by a hash of their ids."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(1.5 * max(n / BLOCK_ITEMS, chars / BLOCK_CHARS))) if n > BLOCK_ITEMS or chars > BLOCK_CHARS else 1
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        yield tuple(sorted((r["item_id"], r["text"]) for r in rows))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, recall: float = 0.99) -> DataFrame:
    """``doc_id, item_id, edits``: the items of ``benchmark`` (item_id, text) found in ``docs`` (doc_id, text).

    An item is found if some passage is within ``EDITS`` of the item's words, counted in edits of words; case and
    punctuation do not count. ``edits`` is the least number. Null or empty texts and items without words match nothing;
    repeated documents and items give repeated matches; other columns are ignored; empty tables give no rows. Documents
    are read once for each block of items and not shuffled; a block is broadcast and bounded by ``BLOCK_ITEMS``.
    """
    spark, found = docs.sparkSession, None
    for items in _blocks(benchmark):
        held = spark.sparkContext.broadcast(items)

        def work(doc_id, text, held=held):
            matches = index(held.value, recall).search(text.to_pylist()) if held.value else [[] for _ in text]
            rows = [(d, i, e) for d, ms in zip(doc_id.to_pylist(), matches, strict=True) for i, e in ms]
            return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

        part = map_blocks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), work, "doc_id long, item_id long, edits long")
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaked(docs: DataFrame, benchmark: DataFrame, *, recall: float = 0.99) -> DataFrame:
    """The rows of ``docs`` in which no item of ``benchmark`` is found, with all their columns; no join, no shuffle.

    Null and empty texts hold no item, so they stay; repeated rows stay or go together; an empty table gives no rows, an
    empty benchmark all of them. Columns of any name beside ``text`` pass through.
    """
    spark, kept = docs.sparkSession, docs
    for items in _blocks(benchmark):
        held = spark.sparkContext.broadcast(items)

        def keep(texts, held=held):
            return [not m for m in index(held.value, recall).search(texts.to_pylist())] if held.value else [True] * len(texts)

        kept = keep_texts(kept, keep)
    return kept


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in any document."""
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
