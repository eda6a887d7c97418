"""SimHash near-duplicates: segment popcounts as an embedding, joined on a grid, verified exactly.

A fingerprint's 32 segments of two bits are mapped to their bit counts. The Manhattan distance of two such vectors is at
most the Hamming distance of the fingerprints, so fingerprints within three bits have vectors within three, and in one
half of the segments within one. Each half with one coordinate left open is a cell of the grid; fingerprints that share
a cell are compared exactly. Equal fingerprints count once, and cells that many fingerprints share are linked through
common midpoints instead of pair by pair, which finds the same groups.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import cut, map_blocks, table
from tabulon.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words in a shingle, and the most differing bits of a link.
SHINGLE, BITS = 3, 3
SEED = 42
#: Fingerprints of a cell that are compared pair by pair; larger cells are linked through midpoints.
CELL = 256
FIELDS = 0x55555555


def fingerprint(text: str) -> int:
    """The fingerprint of a whole text as an unsigned number: a bit is set if over half the shingle hashes have it."""
    import xxhash

    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(a + b" " + b + b" " + c, SEED) for a, b, c in zip(words, words[1:], words[2:], strict=False)]
    raw = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(raw[i : i + 65536], axis=1).sum(0, dtype=np.int64) for i in range(0, len(raw), 65536))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as ``doc_id, fp``, the fingerprint as a signed long. A null text has no words: zero."""

    def work(doc_id, text):
        return doc_id, [f - (1 << 64) if (f := fingerprint(t.as_py() or "")) >> 63 else f for t in text]

    return map_blocks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), work, "doc_id long, fp long")


def cells(prints: DataFrame) -> DataFrame:
    """Each fingerprint with the 32 grid cells it lies in: a half of its segment counts with one count left open."""
    keys = []
    for half in (0, 1):
        bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        counts = bits.bitwiseAND(F.lit(FIELDS)) + F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(FIELDS))
        keys += [counts.bitwiseAND(F.lit(0xFFFFFFFF & ~(3 << 2 * i))).bitwiseOR(F.lit((16 * half + i) << 32)) for i in range(16)]
    return prints.select(F.explode(F.array(*keys)).alias("cell"), "fp")


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links that join something not joined before: they connect the same nodes as all of them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def _in_cells(cell: np.ndarray, fp: np.ndarray, most: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between fingerprints of equal cells (rows sorted by cell), and the fingerprints of too large cells."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    large = np.repeat(sizes > most, sizes)
    crowd, cell, fp = np.unique(fp[large]), cell[~large], fp[~large]
    a, b = [], []
    at, gap = np.arange(max(0, len(cell) - 1)), 1
    at = at[cell[at] == cell[at + 1]]
    while len(at):
        near = np.bitwise_count((fp[at] ^ fp[at + gap]).view(np.uint64)) <= BITS
        a.append(fp[at[near]])
        b.append(fp[at[near] + gap])
        gap += 1
        at = at[at + gap < len(cell)]
        at = at[cell[at] == cell[at + gap]]
    return _forest(np.concatenate(a), np.concatenate(b)) if a else [], crowd


def _link_cells(batches, most: int = CELL):
    """Over rows sorted by cell: links (a, b), and (a, null) for a fingerprint of a cell with more than ``most``."""
    import pyarrow as pa

    def out(links, crowd):
        a = [x for x, _ in links] + crowd.tolist()
        b = [y for _, y in links] + [None] * len(crowd)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    cell = fp = np.empty(0, np.int64)
    crowded = None  # the cell whose rows are too many to hold
    for batch in batches:
        cell = np.concatenate([cell, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy()])
        if not len(cell):
            continue
        if crowded is not None:
            more = int(np.searchsorted(cell, crowded, "right"))
            yield out([], np.unique(fp[:more]))
            cell, fp = cell[more:], fp[more:]
            if not len(cell):
                continue
            crowded = None
        end = int(np.searchsorted(cell, cell[-1], "left"))
        if len(cell) - end > most:
            crowded, end = cell[-1], len(cell)
        if end:
            yield out(*_in_cells(cell[:end], fp[:end], most))
        cell, fp = cell[end:], fp[end:]
    if len(cell):
        yield out(*_in_cells(cell, fp, most))


def _through_midpoints(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever lies within three bits, without comparing pairs.

    Two fingerprints within three bits have a midpoint within one bit of the one and two of the other. All within two
    bits of a midpoint are linked to the smallest within one bit of it, from which each is three bits away at most.
    """
    one = [0, *(1 << i for i in range(64))]
    two = [1 << i | 1 << j for i in range(64) for j in range(i)]
    signed = lambda masks: F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    around = lambda masks: prints.select("fp", F.explode(signed(masks)).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("middle"))
    near = around(one)
    hubs = near.groupBy("middle").agg(F.min("fp").alias("hub"))
    return near.unionByName(around(two)).join(hubs, "middle").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def links(prints: DataFrame, *, most: int = CELL) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all that differ in three bits or fewer.

    Cells of over ``most`` fingerprints are linked through midpoints; either way gives the same groups.
    """
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells(prints).repartition(n, "cell").sortWithinPartitions("cell", "fp")
    found = cut(rows.mapInArrow(partial(_link_cells, most=most), "a long, b long"))
    crowd = cut(found.where("b IS NULL").select(F.col("a").alias("fp")).distinct())
    sure = found.where("b IS NOT NULL")
    return sure if crowd.isEmpty() else sure.unionByName(_through_midpoints(crowd))


def near_duplicates(docs: DataFrame, *, most: int = CELL) -> DataFrame:
    """``docs`` (doc_id, text) as ``doc_id, fp, component_id``.

    Documents are linked if their fingerprints differ in three bits or fewer; ``component_id`` is the smallest doc_id that
    a document reaches, itself included. One row per row, repeated rows stay, other columns are ignored. Texts without
    words (null, empty, blank) have fingerprint zero and are linked like any other. A null doc_id is never a
    component_id unless nothing else is there (then it is null). An empty table gives no rows.
    """
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp"), most=most))
    linked = cut(roots.join(classes, roots["node"] == classes["fp"]).select("node", "root", "first"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_linked = linked.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    # written before the last join, so that Spark can split the documents of one very common fingerprint
    of_class = cut(classes.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return prints.join(of_class, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, the one with the smallest doc_id, with all its columns.

    Of rows that share that doc_id the one with the smallest text stays, then the smallest other columns in their order. Rows
    without a doc_id all stay, since none can stand for a group. An empty table gives no rows.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    orders = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]
    kept = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi")
    ranked = kept.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.row_number().over(Window.partitionBy("doc_id").orderBy("text", *orders)).alias("i"))
    kept = ranked.where("i = 1").select("row.*")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its group of near duplicates."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
