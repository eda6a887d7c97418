"""Repeated passages: bytes covered by a 100-byte string that also starts earlier in the corpus.

Every string of ``LENGTH`` bytes holds an anchor, a short gram chosen by the string's content alone, so that equal strings
hold equal anchors at equal places. Anchors with their contexts' hashes are shuffled; equal contexts settle copies at once,
whose bytes are then compared with those of their source, in runs as long as source and copy go on together. The different
contexts of an anchor are suffix-sorted on both sides: prefix polynomial hashes and binary search give common extensions,
so that a comparison in the merge sort costs a logarithm of the context, and the result is verified on the bytes. Blocks
of the two sorted orders at fitting depths are the equal strings. No removal rests on a hash alone: if a copy differs from
its source, hashes have collided, and all is done again with others.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import cut, map_blocks, table

#: Bytes of a repeated string and of an anchor's gram; a string has ``SLIDE + 1`` grams.
LENGTH, GRAM = 100, 32
SLIDE = LENGTH - GRAM
#: Different contexts of one anchor that are sorted in one task (a few hundred bytes each); anchors with more are settled
#: string by string.
CROWD = 100_000
#: Parts into which the places of one string are dealt when they are joined with its first.
SALTS = 16
#: Rows of one suffix sort.
CHUNK = 60_000

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            steps = lambda b: np.cumprod(np.r_[_U(1), np.full(size - 1, b, _U)])
            self.up, self.down = steps(self.base), steps(self.inverse)
        return self.up[:n], self.down[:n]


@lru_cache(maxsize=8)
def _powers(base: int) -> _Powers:
    return _Powers(base)


def _sums(data: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the factors that bring a part to its place."""
    up, down = _powers((_BASES[k] + 2 * seed * _BASES[1]) % (1 << 64)).to(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:-1], out=sums[1:])
    return sums, down


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``width`` neighbouring values."""
    size = 1
    while 2 * size <= width:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text's anchors, hashes of their grams and contexts, and how far the contexts reach to both sides.

    A gram is an anchor if it has the least hash of some string of ``LENGTH`` bytes; all of equal hash are taken. The
    context is what strings around the anchor can cover: ``SLIDE`` bytes before it, ``LENGTH`` from it on.
    """
    n = len(data)
    sums, down = _sums(data, 0, seed)
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    least = _sliding(grams, SLIDE + 1, np.minimum)
    top = np.full(SLIDE, 0, _U)
    at = np.flatnonzero(_sliding(np.concatenate([top, least, top]), SLIDE + 1, np.maximum) == grams)
    start, end = np.maximum(at - SLIDE, 0), np.minimum(at + LENGTH, n)
    sums, down = _sums(data, 1, seed)
    context = _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(0x2545F4914F6CDD1D) + (at - start).astype(_U))
    return at, grams[at], context, at - start, end - at


def _batch(names: list[str], *columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


_ANCHOR = "h long, c long, doc_id long, a int, x int"


def _same_bytes(flat: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each of ``rows``: whether its bytes ``flat[start:end]`` are those of the row before it."""
    out = np.zeros(len(rows), bool)
    for at in range(0, len(rows), 20_000):
        i = rows[at : at + 20_000]
        size = end[i] - start[i]
        columns = np.arange(SLIDE + LENGTH)
        last = len(flat) - 1
        equal = flat[np.minimum(start[i][:, None] + columns, last)] == flat[np.minimum(start[i - 1][:, None] + columns, last)]
        out[at : at + 20_000] = (equal | (columns >= size[:, None])).all(1) & (size == end[i - 1] - start[i - 1])
    return out


def _anchor_rows(batches, seed: int = 0):
    """Anchors (x = left * 256 + right >= 0), and settled spans (a, -1 - x) of those whose context, compared byte by
    byte, came before in the batch."""
    for batch in batches:
        found = [[] for _ in range(7)]
        raws, base = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py()
            raw = raw.encode() if raw else b""
            if doc is None or len(raw) < LENGTH:
                continue
            at, h, c, left, right = anchors(np.frombuffer(raw, np.uint8), seed)
            for column, values in zip(found, (np.full(len(at), doc, np.int64), at, h, c, left, right, np.full(len(at), base)), strict=True):
                column.append(values)
            raws.append(raw)
            base += len(raw)
        if not found[0]:
            continue
        doc, at, h, c, left, right, base = map(np.concatenate, found)
        order = np.lexsort((at, doc, c, h))
        doc, at, h, c, left, right, base = (v[order] for v in (doc, at, h, c, left, right, base))
        again = np.r_[False, (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (left[1:] == left[:-1])]
        rows = np.flatnonzero(again)
        again[rows] = _same_bytes(np.frombuffer(b"".join(raws), np.uint8), base + at - left, base + at + right, rows)
        # the first place of a context within the batch stands for all of it
        same = np.r_[False, (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]) & again[1:]]
        span = again & (left + right >= LENGTH) & ~same
        doc_s, start, end = _joined(doc[span], at[span] - left[span], at[span] + right[span])
        new = ~again
        yield _batch(
            ["h", "c", "doc_id", "a", "x"],
            np.r_[h[new].view(np.int64), _mixed(doc_s.view(_U) * _U(31) + start.astype(_U)).view(np.int64)],
            np.r_[c[new].view(np.int64), np.zeros(len(doc_s), np.int64)],
            np.r_[doc[new], doc_s],
            np.r_[at[new], start].astype(np.int32),
            np.r_[left[new] * 256 + right[new], -1 - end].astype(np.int32),
        )


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, overlapping and touching ones joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.r_[True, doc[1:] != doc[:-1]]
    # a running maximum of the ends within a document, by lifting each document above the one before
    lift = np.cumsum(new) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new[1:] |= start[1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


_PLACE = "kind int, h long, doc_id long, a int, b int, source long, source_a int"
#: Kinds of places: spans that are settled, copies that are to be compared with their source, different contexts of one
#: anchor, and such ones of a crowded anchor.
SETTLED, COPIED, SORTED, CROWDED = range(4)


def _settle(batches, crowd: int = CROWD):
    """Over anchor rows sorted by h, c, doc_id, a: settled spans, copies with their source, which is the first place of their
    context's hash, and the first places of anchors that have several contexts (``CROWDED`` if more than ``crowd``)."""

    def rows(kind, h, doc, a, b, source=None, source_a=None):
        source = doc if source is None else source
        return _batch(["kind", "h", "doc_id", "a", "b", "source", "source_a"], np.full(len(h), kind, np.int32), h, doc, a.astype(np.int32), b.astype(np.int32), source, (a if source_a is None else source_a).astype(np.int32))

    empty = np.empty(0, np.int64)
    held_h = held_doc = held_a = empty  # first places of the anchor that the last batch ended in
    crowded = last = None
    source = (0, 0)  # first place of the context that the last batch ended in
    for batch in batches:
        h, c, doc, a, x = (col.to_numpy().astype(np.int64) for col in batch.columns)
        if not len(h):
            continue
        done = x < 0
        if done.any():
            yield rows(SETTLED, h[done], doc[done], a[done], -1 - x[done])
            h, c, doc, a, x = (v[~done] for v in (h, c, doc, a, x))
            if not len(h):
                continue
        again = np.r_[last is not None and (h[0], c[0]) == last[:2], (h[1:] == h[:-1]) & (c[1:] == c[:-1])]
        same = again & np.r_[last is not None and (h[0], c[0], doc[0], a[0]) == last, (doc[1:] == doc[:-1]) & (a[1:] == a[:-1])]
        last = (h[-1], c[-1], doc[-1], a[-1])
        first = np.maximum.accumulate(np.where(again, 0, np.arange(1, len(h) + 1)))  # 0: that of the batch before
        of_doc, of_a = np.r_[source[0], doc][first], np.r_[source[1], a][first]
        source = (of_doc[-1], of_a[-1])
        copy = again & ~same & (x // 256 + x % 256 >= LENGTH)
        # a repeated row (same place) of a later copy is the same span again; spans are joined in the end
        if copy.any():
            left, right = x[copy] // 256, x[copy] % 256
            yield rows(COPIED, h[copy], doc[copy], a[copy] - left, a[copy] + right, of_doc[copy], of_a[copy] - left)
        h, doc, a = h[~again], doc[~again], a[~again]
        if crowded is not None:
            more = h == crowded
            if more.any():
                yield rows(CROWDED, h[more], doc[more], a[more], a[more])
            if more.all():
                continue
            h, doc, a, crowded = h[~more], doc[~more], a[~more], None
        h, doc, a = np.r_[held_h, h], np.r_[held_doc, doc], np.r_[held_a, a]
        if not len(h):
            continue
        end = int(np.searchsorted(h, h[-1], "left"))
        several = np.zeros(end, bool)
        if end > 1:
            equal = h[1:end] == h[: end - 1]
            several[1:] |= equal
            several[:-1] |= equal
        if several.any():
            yield rows(SORTED, h[:end][several], doc[:end][several], a[:end][several], a[:end][several])
        held_h, held_doc, held_a = h[end:], doc[end:], a[end:]
        if len(held_h) > crowd:
            crowded = held_h[0]
            yield rows(CROWDED, held_h, held_doc, held_a, held_a)
            held_h = held_doc = held_a = empty
    if len(held_h) > 1:
        yield rows(SORTED, held_h, held_doc, held_a, held_a)


def _common(hashes: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common beginning of suffixes i and j, by binary search on their prefix hashes."""
    low, high = np.zeros(len(i), np.int64), np.minimum(sizes[i], sizes[j])
    for _ in range(int(hashes.shape[1]).bit_length()):
        middle = (low + high + 1) // 2
        equal = hashes[i, middle] == hashes[j, middle]
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
    return low


def suffix_sort(text: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (rows of ``text``, ``sizes`` bytes each) within each run of equal ``group``, and the
    length that each has in common with the one before it in that order (0 at a group's start).

    A merge sort of all groups side by side: in each round an element's place in the merged run is its place in its own
    run plus the number of elements before it in the other, found by binary search; suffixes are compared through
    their common beginning. The order is verified on the bytes; after a hash collision they are sorted directly.
    """
    m, width = text.shape
    padded = np.where(np.arange(width) < sizes[:, None], text.astype(np.int16) + 1, 0)
    padded = np.concatenate([padded, np.zeros((m, 1), np.int16)], axis=1)
    hashes = np.zeros((m, width + 1), _U)
    for k in range(width):
        hashes[:, k + 1] = hashes[:, k] * _U(_BASES[0]) + padded[:, k].astype(_U)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    counts = np.diff(np.r_[starts, m])
    base, count = np.repeat(starts, counts), np.repeat(counts, counts)
    order, run = np.arange(m), 1
    while run < counts.max():
        p = np.flatnonzero(count > run)
        place = p - base[p]
        number, left = place // run, (place // run) % 2 == 0
        other = np.where(left, number + 1, number - 1) * run
        low = np.minimum(other, count[p])
        first, high = low.copy(), np.minimum(other + run, count[p])
        me = order[p]
        while (open_ := low < high).any():
            q = np.flatnonzero(open_)
            middle = (low[q] + high[q]) // 2
            you = order[base[p[q]] + middle]
            common = _common(hashes, sizes, me[q], you)
            mine, yours = padded[me[q], common], padded[you, common]
            before = (yours < mine) | ((yours == mine) & ~left[q])  # of equal ones the left run's come first
            low[q], high[q] = np.where(before, middle + 1, low[q]), np.where(before, high[q], middle)
        order[base[p] + number // 2 * 2 * run + place % run + low - first] = me
        run *= 2
    common = _true_common(padded, sizes, order)
    i, j = order[:-1], order[1:]
    inside = group[i] == group[j]
    if (inside & (padded[i, common[1:]] > padded[j, common[1:]])).any():  # a collision misled the merge
        order = np.lexsort((*[padded[:, k] for k in range(width - 1, -1, -1)], group))
        common = _true_common(padded, sizes, order)
    common[np.r_[True, group[order[1:]] != group[order[:-1]]]] = 0
    return order, common


def _true_common(padded: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common beginnings of neighbours in an order, byte by byte."""
    i, j = order[:-1], order[1:]
    differ = padded[i] != padded[j]
    return np.r_[0, np.minimum(np.where(differ.any(1), differ.argmax(1), padded.shape[1] - 1), np.minimum(sizes[i], sizes[j]))]


def covered(group: np.ndarray, left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """For places of anchors in corpus order within each group: which strings around them start earlier, too.

    Row i, column x of the result is true if the string that begins x bytes before place i is also found, x bytes
    before it, at an earlier place of its group. ``left`` has the bytes before the anchor, read backwards.
    """
    order_r, common_r = suffix_sort(right, right_size, group)
    order_l, common_l = suffix_sort(left, left_size, group)
    m = len(group)
    found = np.zeros((m, SLIDE + 1), bool)
    new_r, new_l = (np.r_[True, group[o[1:]] != group[o[:-1]]] for o in (order_r, order_l))
    block_r, block_l = np.empty(m, np.int64), np.empty(m, np.int64)
    for x in range(SLIDE + 1):
        block_r[order_r] = np.cumsum(new_r | (common_r < LENGTH - x))
        block_l[order_l] = np.cumsum(new_l | (common_l < x))
        can = np.flatnonzero((right_size >= LENGTH - x) & (left_size >= x))
        _, first = np.unique(block_r[can] * (m + 1) + block_l[can], return_index=True)
        found[can, x] = True
        found[can[first], x] = False
    return found


def _sorted_spans(batches):
    """Over places sorted by h, doc_id, a with their contexts: spans (doc_id, a, b) covered by earlier strings."""
    held: list = []
    n = 0

    def out(table_):
        h, doc, a, left = (table_.column(k).to_numpy() for k in ("h", "doc_id", "a", "l"))
        raw = table_.column("data").to_pylist()
        left = left.astype(np.int64)
        size = np.array(list(map(len, raw)), np.int64)
        flat = np.frombuffer(b"".join(raw) + b"\0" * LENGTH, np.uint8)
        at = np.cumsum(np.r_[0, size[:-1]]) + left
        rights = flat[np.minimum(at[:, None] + np.arange(LENGTH), len(flat) - 1)]
        lefts = flat[np.maximum(at[:, None] - 1 - np.arange(SLIDE), 0)]
        found = covered(h, lefts, left, rights, size - left)
        edge = np.diff(np.concatenate([np.zeros((len(h), 1), np.int8), found.astype(np.int8), np.zeros((len(h), 1), np.int8)], axis=1), axis=1)
        (i, x0), (_, x1) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        spans = _joined(doc[i], a[i] - (x1 - 1), a[i] - x0 + LENGTH)
        return _batch(["doc_id", "a", "b"], spans[0], spans[1].astype(np.int32), spans[2].astype(np.int32))

    import pyarrow as pa

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            whole = pa.Table.from_batches(held).combine_chunks()
            h = whole.column("h").to_numpy()
            end = int(np.searchsorted(h, h[-1], "left"))
            if end:
                yield out(whole.slice(0, end))
            held = whole.slice(end).combine_chunks().to_batches()
            n = whole.num_rows - end
    if n:
        yield out(pa.Table.from_batches(held).combine_chunks())


def _runs(places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Copies (source, source_a, a, b) of a document, those joined that go on together with the same source."""
    out: list[tuple[int, int, int, int]] = []
    for source, source_a, a, b in sorted(places, key=lambda p: (p[0], p[2] - p[1], p[2])):
        if out and out[-1][0] == source and out[-1][2] - out[-1][1] == a - source_a and a <= out[-1][3]:
            out[-1] = (*out[-1][:3], max(b, out[-1][3]))
        else:
            out.append((source, source_a, a, b))
    return out


_BYTES = "kind int, key long, doc_id long, a int, l int, data binary"


def _bytes_of(doc_id, text, *places):
    """Bytes of places: runs of copies (key: the source, l: where it begins there), contexts and strings of crowded anchors
    (key: the anchor, l: bytes before it)."""
    out: list[list] = [[] for _ in range(6)]
    for doc, t, *of_doc in zip(doc_id.to_pylist(), text, *(p.to_pylist() for p in places), strict=True):
        raw = (t.as_py() or "").encode()
        rows, copies = [], []
        for kind, h, a, b, source, source_a in zip(*of_doc, strict=True):
            start = max(0, a - SLIDE)
            if kind == COPIED:
                copies.append((source, source_a, a, b))
            elif kind == SORTED:
                rows.append((kind, h, doc, a, a - start, raw[start : a + LENGTH]))
            else:
                rows += [(kind, h, doc, s, a - s, raw[s : s + LENGTH]) for s in range(start, min(a, len(raw) - LENGTH) + 1)]
        rows += [(COPIED, source, doc, a, source_a, raw[a:b]) for source, source_a, a, b in _runs(copies)]
        for row in rows:
            for column, value in zip(out, row, strict=True):
                column.append(value)
    return out


def repeated_spans(docs: DataFrame, *, crowd: int = CROWD, seeds: int = 4) -> DataFrame:
    """Spans ``doc_id, a, b`` (bytes, end exclusive; they may overlap) of ``docs`` (doc_id, text) that repeat earlier text.

    ``seeds`` is how many hashes are tried before colliding ones are an error.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = _identified(docs)
    for seed in range(seeds):
        rows = docs.mapInArrow(partial(_anchor_rows, seed=seed), _ANCHOR).repartition(n, "h").sortWithinPartitions("h", "c", "doc_id", "a")
        places = cut(rows.mapInArrow(partial(_settle, crowd=crowd), _PLACE))
        wanted = ["kind", "h", "a", "b", "source", "source_a"]
        of_doc = places.where(F.col("kind") > SETTLED).groupBy("doc_id").agg(F.collect_list(F.struct(*wanted)).alias("places"))
        with_text = docs.join(of_doc, "doc_id").select("doc_id", "text", *[F.col(f"places.{c}").alias(f"of_{c}") for c in wanted])
        found = map_blocks(with_text, _bytes_of, _BYTES, rows=64)
        runs = found.where(F.col("kind") == COPIED).select(F.col("key").alias("doc_id"), F.col("doc_id").alias("copy"), "a", "l", "data")
        size = F.octet_length("data")
        equal = F.substring(F.col("text").cast("binary"), F.col("l") + 1, size) == F.col("data")
        copies = cut(runs.join(docs, "doc_id").select(F.col("copy").alias("doc_id"), "a", (F.col("a") + size).alias("b"), F.coalesce(equal, F.lit(False)).alias("equal")))
        if copies.where("NOT equal").isEmpty():
            break
    else:
        raise RuntimeError(f"hashes of contexts collide with each of {seeds} seeds")
    spans = places.where(F.col("kind") == SETTLED).select("doc_id", "a", "b").unionByName(copies.select("doc_id", "a", "b"))
    ordered = found.where(F.col("kind") == SORTED).select(F.col("key").alias("h"), "doc_id", "a", "l", "data").repartition(n, "h").sortWithinPartitions("h", "doc_id", "a")
    spans = spans.unionByName(ordered.mapInArrow(_sorted_spans, "doc_id long, a int, b int"))
    if not places.where(F.col("kind") == CROWDED).isEmpty():
        # anchors with too many contexts for one task: string by string, aggregated before the shuffle
        strings = found.where(F.col("kind") == CROWDED).select("data", "doc_id", "a", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
        first = strings.groupBy("data").agg(F.min(F.struct("doc_id", "a")).alias("first"), F.count("*").alias("n")).where("n > 1")
        salted = first.select("data", "first", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]).cast("array<bigint>")).alias("salt"))
        later = strings.join(salted, ["data", "salt"]).where(F.struct("doc_id", "a") > F.col("first"))
        spans = spans.unionByName(later.select("doc_id", "a", (F.col("a") + LENGTH).alias("b")))
    return spans


def _kept(raw: bytes, starts: list[int], ends: list[int]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what stays of a text."""
    out, at, removed, spans, last = [], 0, 0, 0, -1
    for start, end in sorted(zip(starts, ends, strict=True)):
        start, end = max(start, at), min(end, len(raw))
        if end <= start:
            continue
        out.append(raw[at:start])
        spans += start != last
        removed += end - start
        at = last = end
    out.append(raw[at:])
    return removed, spans, b"".join(out)


def _identified(docs: DataFrame) -> DataFrame:
    """Rows that have a doc_id. Both joins with the texts read this same plan, so that Spark shuffles the texts once."""
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL")


def _with_spans(docs: DataFrame, crowd: int) -> DataFrame:
    of_doc = repeated_spans(docs, crowd=crowd).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = _identified(docs).join(of_doc, "doc_id", "left").select("doc_id", "text", F.col("spans.a").alias("starts"), F.col("spans.b").alias("ends"))
    none = F.lit(None).cast("array<int>")
    return joined.unionByName(docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id IS NULL").select("doc_id", "text", none.alias("starts"), none.alias("ends")))


def remove_repeats(docs: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """``docs`` (doc_id, text) as ``doc_id, n_bytes, n_removed, n_spans, kept binary``: texts without their repeats.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a smaller doc_id,
    or in the same one before. Strings are judged on the input and never cross documents. A null or short text stays
    whole. A row without a doc_id has no place in the order: it stays whole and makes nothing go. Repeated rows of one
    doc_id count as one document. One row per row; other columns are ignored; an empty table gives no rows.
    """

    def work(doc_id, text, starts, ends):
        out: list[list] = [[] for _ in range(4)]
        for t, s, e in zip(text, starts.to_pylist(), ends.to_pylist(), strict=True):
            raw = (t.as_py() or "").encode()
            for column, value in zip(out, (len(raw), *_kept(raw, s or [], e or [])), strict=True):
                column.append(value)
        return doc_id, *out

    return map_blocks(_with_spans(docs, crowd), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", rows=64)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages, as counts and a digest."""
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
