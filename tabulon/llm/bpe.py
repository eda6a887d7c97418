"""Byte-level BPE with a rank queue whose buckets are found through a hierarchical bitmap.

Each merge rank has a bucket of positions in a linked list of tokens; a two-level bitmap of non-empty buckets gives the
lowest rank by find-first-set. A merge renews the pairs on both sides; entries left behind are recognised as stale and
skipped. One queue serves all new pre-tokens of a block of texts, laid end to end with links that never cross from one to
the next; a pre-token of n bytes costs O(n log n), so very long ones are no special case.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.common import map_blocks, table

#: Bits of one bitmap word, as a power of two.
WORD = 8
LAST = (1 << WORD) - 1
#: Texts whose new pre-tokens share one queue.
BLOCK = 256


class Ranks:
    """A rank file: tokens by rank and ranks by token, with tables for single bytes and for pairs of bytes."""

    def __init__(self, ranks_file: bytes):
        self.of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.bytes_of = [b""] * (max(self.of.values()) + 1)
        self.two = np.full(1 << 16, -1, np.int32)
        for token, rank in self.of.items():
            self.bytes_of[rank] = token
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank
        self.one = np.array([self.of[bytes([b])] for b in range(256)], np.int32)


class _Bitmap:
    """The ranks that have a bucket: words of bits, and one number whose bits are the words in use."""

    def __init__(self, ranks):
        self.top, self.words = 0, {}
        for rank in ranks:
            self.add(rank)

    def add(self, rank: int) -> None:
        word = rank >> WORD
        if word in self.words:
            self.words[word] |= 1 << (rank & LAST)
        else:
            self.words[word] = 1 << (rank & LAST)
            self.top |= 1 << word

    def remove(self, rank: int) -> None:
        word = rank >> WORD
        self.words[word] &= ~(1 << (rank & LAST))
        if not self.words[word]:
            del self.words[word]
            self.top &= ~(1 << word)

    def lowest(self) -> int:
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        return (word << WORD) + (bits & -bits).bit_length() - 1


def _ints(values: np.ndarray) -> array:
    out = array("i")
    out.frombytes(values.astype(np.int32).tobytes())
    return out


def merge(pieces: list[bytes], ranks: Ranks) -> list[tuple[int, ...]]:
    """Ids of each pre-token: the pair of lowest rank is merged, the leftmost first, until no pair has a rank.

    Pre-tokens don't touch each other, so the lowest rank of all is also the lowest of those that have it. ``pair[i]`` is
    the rank of the token at i with the one after it, -1 for none or past a pre-token's end; a bucket's entry is stale if
    the pair has gone or become another since. A bucket's leftmost position is taken first; if a merge makes a pair of
    lower rank, that comes before the rest of the bucket.
    """
    flat, get = b"".join(pieces), ranks.of.get
    n = len(flat)
    if not n:
        return [() for _ in pieces]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    edge = bytearray(n + 1)  # 1 where a pre-token begins, and behind the last one
    np.frombuffer(edge, np.uint8)[np.r_[0, ends]] = 1
    data = np.frombuffer(flat, np.uint8)
    start = np.full(n, -1, np.int32)
    start[:-1] = ranks.two[data[:-1].astype(np.int32) << 8 | data[1:]]
    start[ends[sizes > 0] - 1] = -1
    order = np.argsort(start, kind="stable")
    order = order[np.searchsorted(start[order], 0) :]
    found, first = np.unique(start[order], return_index=True)
    buckets = dict(zip(found.tolist(), map(np.ndarray.tolist, np.split(order, first[1:])), strict=False))
    queue = _Bitmap(buckets)
    add = queue.add
    pair, token = _ints(start), _ints(ranks.one[data])
    after, before = _ints(np.arange(1, n + 2)), _ints(np.arange(-1, n))
    waiting: dict[int, int] = {}  # sizes of sorted buckets that a lower rank has interrupted
    while queue.top:
        rank = queue.lowest()
        bucket = buckets[rank]
        if waiting.pop(rank, None) != len(bucket):
            bucket.sort(reverse=True)
        lower = False
        while bucket and not lower:
            at = bucket.pop()
            if pair[at] != rank:
                continue
            gone = after[at]
            end = after[at] = after[gone]
            token[at], token[gone], pair[at], pair[gone] = rank, -1, -1, -1
            if not edge[end]:
                before[end] = at
                pair[at] = new = get(flat[at : after[end]], -1)
                if new in buckets:
                    buckets[new].append(at)
                    lower = new < rank
                elif new >= 0:
                    buckets[new] = [at]
                    add(new)
                    lower = new < rank
            if not edge[at]:
                i = before[at]
                pair[i] = new = get(flat[i:end], -1)
                if new in buckets:
                    buckets[new].append(i)
                    lower |= new < rank
                elif new >= 0:
                    buckets[new] = [i]
                    add(new)
                    lower |= new < rank
        if bucket:
            waiting[rank] = len(bucket)
        else:
            del buckets[rank]
            queue.remove(rank)
    ids = np.frombuffer(token, np.int32)
    kept = ids >= 0
    upto = np.r_[0, np.cumsum(kept)][np.r_[0, ends]].tolist()
    held = ids[kept].tolist()
    return [tuple(held[a:b]) for a, b in zip(upto, upto[1:], strict=False)]


class Coder:
    """Encoder and decoder of one rank file.

    Ids of pre-tokens are kept in two generations of at most ``keep`` each: when the younger one is full it becomes the
    older one, so that what is still in use stays.
    """

    def __init__(self, ranks_file: bytes, pattern: str, keep: int = 250_000):
        import regex

        self.ranks = Ranks(ranks_file)
        self.decimal = [str(i) for i in range(len(self.ranks.bytes_of))]
        self.pieces = regex.compile(pattern).findall
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.keep = keep

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text of a block."""
        pieces = [self.pieces(t) for t in texts]
        now: dict[str, tuple[int, ...]] = {}
        new: list[str] = []
        for piece in set(chain.from_iterable(pieces)):
            ids = self.young.get(piece)
            if ids is None:
                ids = self.old.get(piece)
                if ids is None:
                    new.append(piece)
                    continue
                self._hold(piece, ids)
            now[piece] = ids
        raw = [p.encode() for p in new]
        whole = list(map(self.ranks.of.get, raw))
        merged = iter(merge([r for r, w in zip(raw, whole, strict=True) if w is None], self.ranks))
        for piece, w in zip(new, whole, strict=True):
            now[piece] = ids = next(merged) if w is None else (w,)
            if len(piece) <= 64:
                self._hold(piece, ids)
        return [list(chain.from_iterable(map(now.__getitem__, ps))) for ps in pieces]

    def _hold(self, piece: str, ids: tuple[int, ...]) -> None:
        if len(self.young) >= self.keep:
            self.old, self.young = self.young, {}
        self.young[piece] = ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(ranks_file: bytes, pattern: str) -> Coder:
    """One coder for each worker process."""
    return Coder(ranks_file, pattern)


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None, max_bytes: int = 64_000_000):
    """The rank file, read once by the driver and broadcast; its size is checked."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        data = file.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise ValueError(f"a rank file has at most {max_bytes} bytes")
    return spark.sparkContext.broadcast(data), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) as ``doc_id, ids array<int>``, without special tokens.

    A null or empty text has no ids. One row per row, repeated rows stay, other columns are ignored, an empty table
    gives no rows. No shuffle; the rank file is broadcast.
    """
    data, pattern = _vocabulary(docs.sparkSession, path, pattern)

    def work(doc_id, text):
        return doc_id, coder(data.value, pattern).encode([t or "" for t in text.to_pylist()])

    return map_blocks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), work, "doc_id long, ids array<int>", rows=BLOCK)


def decode(tokens: DataFrame, *, path: str | None = None) -> DataFrame:
    """``tokens`` (doc_id, ids) as ``doc_id, data binary``; null ids are empty, an unknown id is an error."""
    held, pattern = _vocabulary(tokens.sparkSession, path, None)

    def work(doc_id, ids):
        decode = coder(held.value, pattern).decode
        return doc_id, [decode(x or []) for x in ids.to_pylist()]

    return map_blocks(tokens.select("doc_id", "ids"), work, "doc_id long, data binary", rows=64)


def digests(docs: DataFrame, *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Counts and digests of the ids and of what they decode to, without moving the ids out of the worker."""
    data, pattern = _vocabulary(docs.sparkSession, path, pattern)

    def work(doc_id, text):
        c = coder(data.value, pattern)
        n, of_ids, of_bytes = [], [], []
        for ids in c.encode([t or "" for t in text.to_pylist()]):
            n.append(len(ids))
            of_ids.append(sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(sha256(c.decode(ids)).hexdigest())
        return doc_id, n, of_ids, of_bytes

    return map_blocks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=BLOCK)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    return digests(table(spark, sf_dir, "documents"))
