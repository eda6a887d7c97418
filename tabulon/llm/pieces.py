"""SentencePiece models of BPE type with byte fallback: encoding by rounds of merges over flat arrays, and decoding.

Texts are cut where no piece of the model holds both neighbouring characters, so that nothing merges across a cut. All new
words of a block lie end to end in flat numpy arrays. A round finds the least pair rank of every word (segmented minimum)
and merges all pairs of that rank from the left at once; when enough symbols are gone the arrays are compacted, until no
pair is left. Merging at once equals merging one by one unless a merge makes a pair that comes before the next one of the
same rank; words where that happens are merged one by one for this rank.
"""

from __future__ import annotations

import codecs
import struct
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.common import map_blocks, table

#: Texts whose new words share one run of rounds.
BLOCK = 256
#: Rank of a pair that is no piece.
NONE = np.int32(2**31 - 1)
SPACE = "▁"


def _one_by_one(e: UnicodeDecodeError) -> tuple[str, int]:
    """Each byte that is part of no character becomes a replacement character of its own."""
    return "�", e.start + 1


codecs.register_error("each-byte", _one_by_one)


def fields(message: bytes):
    """(number, value) of each field of a protocol-buffer message; values are numbers or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError("not a SentencePiece model")
            size = number()
        yield key >> 3, message[at : at + size]
        at += size


class Model:
    """The pieces of a model file with their ranks, and which pairs of symbols make a piece.

    Symbols are piece ids; characters that occur in pieces only with others follow after them, and ``none`` stands for any
    other character. Models of another type, without byte fallback, or that normalise or define symbols of their own raise
    ``ValueError``, as their results would be wrong.
    """

    def __init__(self, data: bytes):
        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normal: dict = {}
        for number, value in fields(data):
            if number == 1:
                got = dict(fields(value))
                pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, 1)))
            elif number in (2, 3):
                (trainer if number == 2 else normal).update(fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only BPE models with byte fallback and leading spaces are read")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("models that normalise texts or define symbols of their own are not read")
        self.prefix = SPACE if normal.get(3, 1) else ""
        self.unknown = trainer.get(44, b" \xe2\x81\x87 ")
        plain = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        scores = sorted({pieces[i][1] for i in plain.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = np.full(len(pieces) + 1, NONE, np.int32)  # the last one is of id -1
        for i in plain.values():
            self.rank[i] = place[pieces[i][1]]
        self.byte = [0] * 256
        self.bytes_of: list[bytes] = []
        self.kind = [kind for _, _, kind in pieces]
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            else:
                self.bytes_of.append({2: self.unknown, 3: b""}.get(kind, p.replace(SPACE, " ").encode()))
        self._pairs(plain, len(pieces))

    def _pairs(self, plain: dict[str, int], n: int) -> None:
        symbols, self.size = dict(plain), n
        for c in sorted({c for p in plain for c in p} - set(plain)):
            symbols[c] = n
            n += 1
        self.none = n
        self.width = n + 1
        merged = sorted((symbols[p[:k]] * self.width + symbols[p[k:]], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.merged = dict(merged)
        self.keys = np.array([k for k, _ in merged] + [2**62], np.int64)
        self.made = np.array([i for _, i in merged] + [-1], np.int32)
        self.symbol = np.full(0x110000, self.none, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        joined = {(ord(a), ord(b)) for p in plain for a, b in zip(p, p[1:], strict=False)}
        self.group = np.zeros(0x110000, np.uint32)
        for k, c in enumerate(sorted({c for pair in joined for c in pair}), 1):
            self.group[c] = k
        self.groups = int(self.group.max()) + 1
        close = np.array(sorted(int(self.group[a]) * self.groups + int(self.group[b]) for a, b in joined), np.int64)
        if self.groups <= 4096:
            self.close = np.zeros(self.groups**2, bool)
            self.close[close] = True
        else:
            self.close = close

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Whether nothing can merge across the place behind each code point but the last."""
        g = self.group[points].astype(np.int64)
        pair = g[:-1] * self.groups + g[1:]
        if self.close.dtype == bool:
            return ~self.close[pair]
        at = np.minimum(np.searchsorted(self.close, pair), max(len(self.close) - 1, 0))
        return self.close[at] != pair

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs of symbols make, -1 for none."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)


class _Rounds:
    """Flat arrays of the symbols of words: a linked list each, and behind all of them one symbol that pairs with none."""

    def __init__(self, words: list[str], model: Model):
        self.model = model
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.point = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        n = len(self.point)
        self.word = np.arange(len(words))
        self.symbol = np.append(model.symbol[self.point], model.none)
        self.link()
        self.alive = np.ones(n, bool)
        self.made = model.pair(self.symbol, np.append(self.symbol[1:], model.none))
        self.made[np.append(self.last, n)] = -1
        self.rank = model.rank[self.made]

    def link(self) -> None:
        """Neighbours of symbols that lie side by side."""
        n = len(self.point)
        self.first = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.last = self.first + self.sizes - 1
        self.after, self.before = np.arange(1, n + 2), np.arange(-1, n)
        self.after[self.last] = n
        self.before[self.first] = n

    def run(self) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(self.word)
        while len(self.word):
            n = len(self.point)
            least = np.minimum.reduceat(self.rank[:n], self.first)
            over = least == NONE
            gone = n - np.count_nonzero(self.alive) + int(self.sizes[over].sum())
            if 4 * gone >= n or over.all():
                self.compact(over, out)
                continue
            self.round(least)
        return out

    def round(self, least: np.ndarray) -> None:
        """All pairs of the least rank of each word, from the left."""
        n, m, after, symbol = len(self.point), self.model, self.after, self.symbol
        own = np.repeat(least, self.sizes)
        at = np.flatnonzero((self.rank[:n] == own) & (own != NONE))
        opens = np.r_[True, after[at[:-1]] != at[1:]]  # a pair that doesn't begin where the one before ends
        step = np.arange(len(at))
        all_at, at = at, at[(step - np.maximum.accumulate(np.where(opens, step, 0))) % 2 == 0]
        gone = after[at]
        end, new = after[gone], self.made[at]
        left = symbol[self.before[at]]
        beside = np.r_[False, gone[:-1] == self.before[at[1:]]]
        left = np.where(beside, np.r_[0, new[:-1]], left)
        rank = self.rank[at]
        early = (m.rank[m.pair(left, new)] <= rank) | (m.rank[m.pair(new, symbol[end])] <= rank)
        if early.any():
            of = lambda x: np.searchsorted(self.first, x, side="right") - 1
            odd = np.zeros(len(self.word), bool)
            odd[of(at[early])] = True
            keep = ~odd[of(at)]
            slow = all_at[odd[of(all_at)]]
            lowest = self.rank[slow]
            self.merge(at[keep], gone[keep], end[keep], new[keep])
            self.merge_singly(slow.tolist(), lowest.tolist())
        else:
            self.merge(at, gone, end, new)

    def merge(self, at, gone, end, new) -> None:
        m, n = self.model, len(self.point)
        self.symbol[at] = new
        self.alive[gone] = False
        self.rank[gone], self.made[gone] = NONE, -1
        self.after[at] = end
        self.before[end] = at
        ahead = self.before[at]
        for i in (at, ahead[ahead != n]):
            self.made[i] = new = m.pair(self.symbol[i], self.symbol[self.after[i]])
            self.rank[i] = m.rank[new]

    def merge_singly(self, places: list[int], ranks: list[int]) -> None:
        """Pairs of a word's least rank from the left, one after the other, with all that then comes before the next one."""
        get, width, rank_of, n = self.model.merged.get, self.model.width, self.model.rank, len(self.point)
        symbol, rank, made, after, before = self.symbol, self.rank, self.made, self.after, self.before
        for at, lowest in zip(places, ranks, strict=True):
            if rank[at] != lowest:
                continue
            while rank[at] <= lowest:
                gone = int(after[at])
                end = int(after[gone])
                symbol[at] = made[at]
                self.alive[gone] = False
                rank[gone], made[gone], after[at] = NONE, -1, end
                before[end] = at
                ahead = int(before[at])
                for i in (at, ahead):
                    if i != n:
                        made[i] = new = get(int(symbol[i]) * width + int(symbol[after[i]]), -1)
                        rank[i] = rank_of[new]
                if ahead != n and rank[ahead] <= rank[at]:
                    at = ahead

    def compact(self, over: np.ndarray, out: list) -> None:
        """Words that are done go to ``out``; of the others only the symbols that are left stay."""
        alive = self.alive
        count = np.add.reduceat(alive, self.first)
        done = np.repeat(over, self.sizes) & alive
        ids, points = self.symbol[:-1][done], self.point[done]
        known = ids < self.model.size
        upto = np.r_[0, np.cumsum(count[over])].tolist()
        held = ids.tolist()
        odd = np.flatnonzero(~known)
        if len(odd):
            which = set((np.searchsorted(upto, odd, side="right") - 1).tolist())
        else:
            which = set()
        byte = self.model.byte
        for k, (w, a, b) in enumerate(zip(self.word[over].tolist(), upto, upto[1:], strict=False)):
            if k in which:
                out[w] = tuple(chain.from_iterable((i,) if i < self.model.size else map(byte.__getitem__, chr(p).encode()) for i, p in zip(held[a:b], points[a:b].tolist(), strict=True)))
            else:
                out[w] = tuple(held[a:b])
        stay = np.repeat(~over, self.sizes) & alive
        self.word, self.sizes = self.word[~over], count[~over]
        if not len(self.word):
            return
        self.point = self.point[stay]
        for name in ("symbol", "made", "rank"):
            was = getattr(self, name)
            setattr(self, name, np.append(was[:-1][stay], was[-1:]))
        self.alive = np.ones(len(self.point), bool)
        self.link()


class Coder:
    """Encoder and decoder of one model; ids of words are kept in two generations of at most ``keep`` each."""

    def __init__(self, data: bytes, keep: int = 250_000):
        self.model = Model(data)
        self.decimal = [str(i) for i in range(self.model.size)]
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.keep = keep

    def words(self, texts: list[str]) -> list[list[str]]:
        """Each text with its leading space, cut where nothing merges across."""
        ready = [self.model.prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(ready)
        if not whole:
            return [[] for _ in texts]
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        cut = np.r_[True, self.model.cuts(points), True]
        bounds = np.r_[0, np.cumsum(np.fromiter(map(len, ready), np.int64, len(ready)))]
        cut[bounds] = True
        at = np.flatnonzero(cut)
        place = at.tolist()
        parts = [whole[a:b] for a, b in zip(place, place[1:], strict=False)]
        upto = np.searchsorted(at, bounds).tolist()
        return [parts[a:b] for a, b in zip(upto, upto[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text of a block."""
        words = self.words(texts)
        now: dict[str, tuple[int, ...]] = {}
        new: list[str] = []
        for word in set(chain.from_iterable(words)):
            ids = self.young.get(word)
            if ids is None:
                ids = self.old.get(word)
                if ids is None:
                    new.append(word)
                    continue
                self._hold(word, ids)
            now[word] = ids
        for word, ids in zip(new, _Rounds(new, self.model).run() if new else (), strict=True):
            now[word] = ids
            if len(word) <= 64:
                self._hold(word, ids)
        return [list(chain.from_iterable(map(now.__getitem__, ws))) for ws in words]

    def _hold(self, word: str, ids: tuple[int, ...]) -> None:
        if len(self.young) >= self.keep:
            self.old, self.young = self.young, {}
        self.young[word] = ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids: spaces for their marks but the leading one, bytes as the characters that they make."""
        kind = self.model.kind
        first = next((k for k, i in enumerate(ids) if kind[i] != 3), len(ids))
        parts = list(map(self.model.bytes_of.__getitem__, ids))
        if self.model.prefix and first < len(ids) and kind[ids[first]] == 1 and parts[first].startswith(b" "):
            parts[first] = parts[first][1:]
        return b"".join(parts).decode("utf-8", "each-byte")


@lru_cache(maxsize=2)
def coder(data: bytes) -> Coder:
    """One coder for each worker process."""
    return Coder(data)


def _model(spark: SparkSession, path: str | None, max_bytes: int = 64_000_000):
    """The model file, read once by the driver, looked through there and broadcast; its size is checked."""
    import public_tokenizers

    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        data = file.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise ValueError(f"a model file has at most {max_bytes} bytes")
    coder(data)
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) as ``doc_id, ids array<int>``, without begin and end ids.

    A null or empty text has no ids. One row per row, repeated rows stay, other columns are ignored, an empty table
    gives no rows. No shuffle; the model file is broadcast.
    """
    data = _model(docs.sparkSession, path)

    def work(doc_id, text):
        return doc_id, coder(data.value).encode([t or "" for t in text.to_pylist()])

    return map_blocks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), work, "doc_id long, ids array<int>", rows=BLOCK)


def decode(tokens: DataFrame, *, path: str | None = None) -> DataFrame:
    """``tokens`` (doc_id, ids) as ``doc_id, text string``; null ids are empty, an unknown id is an error."""
    data = _model(tokens.sparkSession, path)

    def work(doc_id, ids):
        decode = coder(data.value).decode
        return doc_id, [decode(x or []) for x in ids.to_pylist()]

    return map_blocks(tokens.select("doc_id", "ids"), work, "doc_id long, text string", rows=64)


def digests(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """Counts and digests of the ids and of the text that they decode to, without moving the ids out of the worker."""
    data = _model(docs.sparkSession, path)

    def work(doc_id, text):
        c = coder(data.value)
        n, of_ids, of_text = [], [], []
        for ids in c.encode([t or "" for t in text.to_pylist()]):
            n.append(len(ids))
            of_ids.append(sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
            of_text.append(sha256(c.decode(ids).encode()).hexdigest())
        return doc_id, n, of_ids, of_text

    return map_blocks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=BLOCK)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    return digests(table(spark, sf_dir, "documents"))
