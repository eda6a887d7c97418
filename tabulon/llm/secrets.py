"""Secret scans through a trigram inverted index.

A Boolean query over trigrams is derived from each rule's regex: every text that matches satisfies it. Blocks of
documents are indexed by the trigrams that the queries name; postings are joined and intersected, and only the
candidates are searched. A rule without mandatory trigrams searches every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from hashlib import sha256
from re import _constants as c
from re import _parser as parser

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.common import map_blocks, table


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has ``least`` characters or more; failing matches are dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The base rules in their listed order, then further ones for tokens of well-known shape.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("live_key", r"[sr]k_live_[A-Za-z0-9]{20,}"),
)
BASE = ("assign", "access", "hex")

#: Letters beyond ASCII that a pattern without regard to case takes for an ASCII one; texts are indexed with that one.
FOLDED = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}

#: Sets of strings larger than this end a literal run.
MOST = 64


def _exact(nodes) -> set[str] | None:
    """All strings that a parsed sequence can match, in lower case, or None if they are too many to list."""
    found = {""}
    for op, arg in nodes:
        if op is c.LITERAL:
            step = {chr(arg).lower()}
        elif op is c.IN and all(x is c.LITERAL for x, _ in arg):
            step = {chr(x).lower() for _, x in arg}
        elif op is c.SUBPATTERN:
            step = _exact(arg[3])
        elif op is c.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            step = None if None in parts else set().union(*parts)
        elif op is c.MAX_REPEAT and arg[:2] == (0, 1) and (once := _exact(arg[2])) is not None:
            step = once | {""}
        elif op is c.AT:
            step = {""}
        else:
            step = None
        if step is None or len(found) * len(step) > MOST:
            return None
        found = {a + b for a in found for b in step}
    return found


def trigram_query(nodes) -> tuple:
    """What every match needs: ``("and", parts)``, ``("or", parts)`` or a trigram; ``("and", ())`` asks for nothing.

    Only ASCII trigrams are indexed, so those with other letters are not asked for.
    """
    needs, run = [], {""}

    def flush() -> None:
        nonlocal run
        needs.append(("or", tuple(("and", tuple(dict.fromkeys(t for i in range(len(s) - 2) if (t := s[i : i + 3]).isascii()))) for s in sorted(run))))
        run = {""}

    for node in nodes:
        op, arg = node
        exact = _exact([node])
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        flush()
        if exact is not None:
            run = exact
        elif op is c.SUBPATTERN:
            needs.append(trigram_query(arg[3]))
        elif op is c.BRANCH:
            needs.append(("or", tuple(trigram_query(x) for x in arg[1])))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] > 0:
            needs.append(trigram_query(arg[2]))
    flush()
    return ("and", tuple(n for n in needs if not _empty(n)))


def _folded(text: str) -> str:
    if not text.isascii():
        for letter, plain in FOLDED.items():
            text = text.replace(letter, plain)
    return text


def _empty(query) -> bool:
    """True if a query asks for nothing."""
    return not isinstance(query, str) and (any if query[0] == "or" else all)(map(_empty, query[1]))


def _trigrams(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]), set())


def _candidates(query, postings: dict[str, np.ndarray], none: np.ndarray) -> np.ndarray:
    """Sorted numbers of the texts that satisfy a query that asks for something."""
    if isinstance(query, str):
        return postings.get(query, none)
    parts = [_candidates(q, postings, none) for q in query[1] if not _empty(q)]
    join = np.intersect1d if query[0] == "and" else np.union1d
    found = parts[0]
    for part in sorted(parts[1:], key=len):
        found = join(found, part)
    return found


class Scanner:
    """Rules with their compiled patterns and trigram queries, and the table from trigram code to number."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), trigram_query(parser.parse(r.pattern))) for r in rules]
        self.order = {r.kind: i for i, r in enumerate(rules)}
        named = sorted(set().union(*(_trigrams(q) for _, _, q in self.rules)))
        self.numbers = np.zeros(1 << 24, np.uint16)
        self.named = named
        for i, t in enumerate(named):
            a, b, d = t.encode()
            self.numbers[a << 16 | b << 8 | d] = i + 1

    def index(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Postings of the named trigrams over a block of texts."""
        raw = [_folded(t).encode().lower() for t in texts]
        starts = np.cumsum([0, *(len(r) + 3 for r in raw)])
        data = np.frombuffer(b"\0\0\0".join(raw) + b"\0\0\0", np.uint8)
        codes = data[:-2].astype(np.uint32) << 16
        codes |= data[1:-1].astype(np.uint32) << 8
        codes |= data[2:]
        number = self.numbers[codes]
        at = np.flatnonzero(number)
        keys = np.unique(number[at].astype(np.int64) * len(texts) + np.searchsorted(starts, at, "right") - 1)
        t, doc = keys // len(texts) - 1, keys % len(texts)
        cuts = np.searchsorted(t, np.arange(len(self.named) + 1))
        return {name: doc[cuts[i] : cuts[i + 1]] for i, name in enumerate(self.named)}

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """By text, its (start, number of the kind, end, kind) sorted by start, then kind as listed."""
        spans: list[list] = [[] for _ in texts]
        postings, none = self.index(texts), np.empty(0, np.int64)
        for rule, pattern, query in self.rules:
            where = range(len(texts)) if _empty(query) else _candidates(query, postings, none).tolist()
            for i in where:
                for m in pattern.finditer(texts[i]):
                    if len(m[rule.group]) >= rule.least:
                        spans[i].append((m.start(), self.order[rule.kind], m.end(), rule.kind))
        return [sorted(s) for s in spans]


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One scanner for each worker process."""
    return Scanner(rules)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (doc_id, text) as ``doc_id, kinds, starts, ends``: arrays over the found spans, by start, then kind.

    Positions are code points, end exclusive; spans of different kinds may overlap. A null or empty text has none. One
    row per row; repeated rows stay; other columns are ignored; an empty table gives no rows. No shuffle.
    """

    def work(doc_id, text):
        found = scanner(rules).scan([t or "" for t in text.to_pylist()])
        return doc_id, [[x[3] for x in s] for s in found], [[x[0] for x in s] for s in found], [[x[2] for x in s] for s in found]

    return map_blocks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), work, "doc_id long, kinds array<string>, starts array<int>, ends array<int>", rows=128)


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The spans of :func:`find_secrets` as counts by base kind, a digest of the base spans and one string of all."""

    def work(doc_id, kinds, starts, ends):
        out: list[list] = [[] for _ in range(5)]
        for ks, ss, es in zip(kinds.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
            listed = [f"{k}:{s}:{e}" for k, s, e in zip(ks, ss, es, strict=True)]
            base = [x for x, k in zip(listed, ks, strict=True) if k in BASE]
            for i, kind in enumerate(BASE):
                out[i].append(ks.count(kind))
            out[3].append(sha256(",".join(base).encode()).hexdigest())
            out[4].append(",".join(listed))
        return doc_id, *out

    return map_blocks(find_secrets(docs, rules), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", rows=2048)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return digests(table(spark, sf_dir, "documents"))
