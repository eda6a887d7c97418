"""Main text of HTML pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks of text in one forward pass. Blocks inside elements that are never main text (menus, forms,
scripts, page footers) are no candidates. Of the others, word count and link density, those of the blocks before and after,
and how strongly class names hint at a part around the article are the features of a decision tree, trained on a small
labelled table of blocks. No text is shortened and no block is dropped for its length alone.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.common import map_blocks, table
from tabulon.llm.trees import Forest, boost

#: Elements whose contents are never text of the page, to their end tag. The first few reach to the page's end without one.
RAW = ("script", "style", "textarea", "title")
SKIPPED = (*RAW, "template", "noscript", "iframe", "svg", "select", "object", "canvas", "math")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles that hold menus, forms and the like by their meaning.
FRAME = frozenset("nav footer aside form menu dialog button fieldset head".split())
FRAME_ROLES = frozenset("navigation contentinfo complementary banner search dialog menu menubar".split())
#: Words in class and id values that hint at parts around the article: comments, strong hints, weak ones.
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion reply replies respond".split())
STRONG_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adbox adsense adslot sponsored sponsor nav navbar navigation menu menubar
    breadcrumb breadcrumbs sidebar rail footer masthead topbar toolbar cookie cookies consent gdpr popup modal overlay newsletter
    subscribe subscription signup login related recommended pagination pager""".split()
)
WEAK_WORDS = frozenset("banner promo promotion side foot head header notice notices alert warning share sharing social widget search form copyright legal disclaimer skip note".split())
#: Words that make a class name speak of the page's layout or state instead, and those of main text.
LAYOUT_WORDS = frozenset("no non not without has have with layout open closed enabled allowed status hoc work works".split())
MAIN_WORDS = frozenset("article main content post entry story body text".split())

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*+")
_IN_TAG = re.compile(r""">|=\s*+(["'])""")
_END = {name: re.compile(rf"</{name}(?![a-z0-9:-])", re.I) for name in SKIPPED}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[a-z]++")

#: Words from which a block is running text.
RUNNING = 40

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "hint")

#: The labelled table: words, link density, the same of the block before and after, hint (1 weak, 2 strong), label.
LABELLED = """
4 1.0 0 0.0 5 1.0 0 0
2 1.0 2 1.0 2 1.0 0 0
1 1.0 1 1.0 1 1.0 0 0
1 1.0 1 1.0 12 0.0 0 0
2 1.0 1 1.0 90 0.0 0 0
3 1.0 0 0.0 4 1.0 0 0
3 1.0 0 0.0 60 0.0 0 0
2 1.0 3 1.0 2 1.0 0 0
5 0.9 4 1.0 6 0.8 0 0
7 0.8 2 1.0 5 1.0 0 0
1 1.0 5 1.0 0 0.0 0 0
9 1.0 8 1.0 11 1.0 0 0
8 1.0 5 0.0 9 1.0 0 0
10 1.0 9 1.0 5 0.0 0 0
12 0.7 3 1.0 9 0.8 0 0
14 0.6 6 0.9 3 1.0 0 0
25 0.9 60 0.0 30 0.8 0 0
30 1.0 5 0.0 4 0.0 0 0
40 0.8 3 1.0 2 1.0 0 0
60 0.9 4 0.0 0 0.0 0 0
18 0.6 12 0.7 20 0.6 0 0
6 0.6 80 0.0 4 1.0 0 0
3 0.7 50 0.0 3 0.7 0 0
4 1.0 60 0.0 3 1.0 0 0
6 1.0 90 0.0 7 1.0 0 0
2 0.0 1 1.0 2 1.0 0 0
3 0.0 4 1.0 5 1.0 0 0
6 0.0 8 1.0 4 1.0 0 0
4 0.0 2 1.0 3 1.0 0 0
1 0.0 2 1.0 1 1.0 0 0
4 0.0 0 0.0 3 1.0 0 0
2 0.0 0 0.0 1 1.0 0 0
5 0.0 60 0.0 8 1.0 0 0
4 0.0 45 0.1 6 1.0 0 0
3 0.0 90 0.0 9 1.0 0 0
6 0.0 30 0.0 10 0.9 0 0
4 0.0 3 1.0 0 0.0 0 0
6 0.0 2 1.0 0 0.0 0 0
3 0.3 1 1.0 0 0.0 0 0
8 0.0 1 1.0 60 0.0 1 0
3 0.0 1 1.0 80 0.0 1 0
15 0.0 2 1.0 70 0.0 1 0
12 0.1 90 0.0 3 1.0 1 0
10 0.0 70 0.0 50 0.0 1 0
6 0.2 60 0.0 40 0.0 1 0
5 0.0 8 0.0 5 0.0 1 0
2 0.0 0 0.0 4 0.0 1 0
4 0.0 0 0.0 90 0.0 1 0
18 0.0 80 0.0 0 0.0 1 0
9 0.0 0 0.0 12 0.0 1 0
16 0.0 60 0.0 80 0.0 1 0
30 0.5 60 0.0 40 0.0 1 0
45 0.6 3 1.0 0 0.0 1 0
8 0.0 1 1.0 10 0.0 2 0
12 0.0 1 1.0 60 0.0 2 0
30 0.0 2 1.0 45 0.0 2 0
25 0.1 80 0.0 0 0.0 2 0
60 0.0 40 0.0 30 0.0 2 0
45 0.0 20 0.0 45 0.0 2 0
15 0.0 70 0.0 12 0.0 2 0
120 0.0 60 0.0 90 0.0 2 0
90 0.05 30 0.0 10 0.0 2 0
5 0.0 9 0.0 40 0.0 2 0
1 0.0 90 0.0 90 0.0 2 0
10 0.0 12 1.0 60 0.0 0 1
8 0.0 9 0.0 70 0.0 0 1
8 0.0 2 1.0 70 0.0 0 1
5 0.0 1 1.0 9 0.0 0 1
3 0.0 1 1.0 40 0.0 0 1
1 0.0 3 1.0 25 0.0 0 1
2 0.0 0 0.0 30 0.0 0 1
7 0.0 0 0.0 4 0.0 0 1
1 0.0 40 0.0 60 0.0 0 1
2 0.0 30 0.0 5 0.0 0 1
3 0.0 8 0.0 8 0.0 0 1
1 0.0 1 0.0 2 0.0 0 1
5 0.0 10 0.2 1 0.0 0 1
1 0.0 8 0.0 12 0.1 0 1
4 0.0 90 0.0 0 0.0 0 1
2 0.0 6 0.0 0 0.0 0 1
1 0.0 0 0.0 0 0.0 0 1
9 0.0 5 0.0 7 0.0 0 1
60 0.0 8 0.0 90 0.0 0 1
90 0.1 60 0.0 40 0.0 0 1
40 0.2 90 0.0 12 0.1 0 1
150 0.0 10 0.0 9 0.2 0 1
25 0.3 60 0.0 30 0.0 0 1
25 0.55 25 0.55 25 0.55 0 1
40 0.55 0 0.0 40 0.55 0 1
60 0.55 60 0.5 0 0.0 0 1
30 0.5 40 0.6 30 0.55 0 1
18 0.4 50 0.0 60 0.0 0 1
7 0.4 50 0.0 60 0.0 0 1
4 1.0 70 0.0 80 0.0 0 1
5 1.0 40 0.0 60 0.0 0 1
3 0.7 60 0.0 90 0.0 0 1
9 0.0 2 1.0 10 0.2 0 1
300 0.0 10 0.0 10 0.0 0 1
20 0.0 0 0.0 0 0.0 0 1
60 0.0 3 1.0 80 0.0 0 1
80 0.05 60 0.0 5 1.0 0 1
45 0.1 4 1.0 50 0.0 0 1
12 0.0 60 0.0 70 0.0 0 1
30 0.0 40 0.0 6 0.5 0 1
18 0.0 25 0.0 20 0.0 0 1
12 0.0 70 0.0 4 1.0 0 1
15 0.0 50 0.0 3 1.0 0 1
100 0.2 5 1.0 4 1.0 0 1
25 0.0 30 0.1 2 1.0 0 1
30 0.0 2 1.0 0 0.0 0 1
15 0.1 40 0.0 35 0.0 0 1
40 0.0 50 0.0 60 0.0 1 1
60 0.0 30 0.0 20 0.0 1 1
35 0.1 80 0.0 90 0.0 1 1
80 0.0 12 0.0 50 0.0 1 1
150 0.0 9 0.0 0 0.0 1 1
30 0.0 40 0.0 30 0.0 1 1
"""


@cache
def block_tree() -> Forest:
    """The decision tree grown on the labelled table."""
    rows = np.array([line.split() for line in LABELLED.split("\n") if line], float)
    return boost(rows[:, :-1], rows[:, -1], [0] * len(FEATURES), trees=1, depth=6, rate=1.0, ridge=0.1, least=1, single=True)


@dataclass
class Block:
    """A flat block of text: words, words inside links, and where it stands.

    ``hint`` is 0 for none, 1 for a weak one, 2 for a strong one, 3 for reader comments; ``inside`` says whether the block is
    part of a ``main`` or ``article`` element.
    """

    text: str
    words: int
    linked: int
    framed: bool
    hint: int
    inside: bool = False

    @property
    def density(self) -> float:
        return min(self.linked / self.words, 1.0)


@cache
def _hint(value: str) -> int:
    """How strongly one class name or id hints at a part around the article; a name that also speaks of layout does not."""
    words = set(_LETTERS.findall(_CAMEL.sub(" ", value).lower()))
    if words & LAYOUT_WORDS:
        return 0
    if words & COMMENT_WORDS:
        return 3
    if words & STRONG_WORDS:
        return 2
    return int(bool(words & WEAK_WORDS) and not words & MAIN_WORDS)


def _role(name: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is a frame part by its meaning, and the hint of its class, id and role."""
    hint, framed = 0, name in FRAME
    for m in _ATTRIBUTE.finditer(attributes):
        for value in (m[2] or m[3] or m[4] or "").split():
            if m[1].lower() == "role":
                framed = framed or value.lower() in FRAME_ROLES
            else:
                hint = max(hint, _hint(value[:200]))
    if name == "header" and not in_article:
        hint = max(hint, 1)
    return framed, hint


def _decoded(text: str) -> list[str]:
    """Words of text with its character references decoded; numbers beyond all code points become U+FFFD."""
    if "&" in text:
        if "&#" in text:
            text = re.sub(r"&#[0-9]{9,}+;?", "�", re.sub(r"&#0++(?=[0-9])", "&#", text))
        text = unescape(text)
    return text.split()


def blocks(html: str) -> list[Block]:
    """Flat blocks in page order, in time linear in the page.

    Tags of block elements part blocks; inline ones do not, and inside ``pre`` their classes mark code, not parts. Character references are decoded, white space inside a block
    becomes one space. ``main`` and ``article`` elements end the hints of what stands around them, but for comments. A tag
    that does not end before the page does is dropped with what follows it; an unclosed comment or script likewise.
    """
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    opened: list[tuple[str, bool, int, bool]] = []  # name, framed, hint, in an article
    count: Counter = Counter()
    last = {q: html.rfind(q) for q in "\"'"}
    ended: set[str] = set()  # skipped elements without a further end tag
    framed, hint, in_article, links, at, n = False, 0, False, False, 0, len(html)

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = _decoded("".join(text))
            if words:
                out.append(Block(" ".join(words), len(words), len(_decoded(" ".join(linked))), framed, hint, in_article))
            text, linked = [], []

    def push(name: str, attributes: str) -> None:
        nonlocal framed, hint, in_article
        opened.append((name, framed, hint, in_article))
        count[name] += 1
        now_framed, now_hint = _role(name, attributes, in_article)
        if name in ("main", "article"):
            in_article = True
            hint = 3 if hint == 3 else 0
        framed, hint = framed or now_framed, max(hint, now_hint)

    def pop() -> str:
        nonlocal framed, hint, in_article
        name, framed, hint, in_article = opened.pop()
        count[name] -= 1
        return name

    while at < n:
        tag = html.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            text.append(html[at:tag])
            if links:
                linked.append(html[at:tag])
        if tag == n:
            break
        if html.startswith("<!--", tag):
            end = html.find("-->", tag + 4)
            if end < 0:
                break
            at = end + 3
            continue
        named = _NAME.match(html, tag + 1)
        if not named:
            if html[tag + 1 : tag + 2] in ("!", "?", "/"):
                end = html.find(">", tag)
                if end < 0:
                    break
                at = end + 1
            else:
                text.append("<")
                at = tag + 1
            continue
        at = named.end()
        end = -1
        while m := _IN_TAG.search(html, at):  # to the > that is in no quoted value
            at = m.end()
            if not m[1]:
                end = m.start()
                break
            if at <= last[m[1]]:
                at = html.find(m[1], at) + 1
        if end < 0:
            break
        closing = named[0][0] == "/"
        name = named[0].lstrip("/").lower()
        attributes = html[named.end() : end]
        if name in SKIPPED:
            if not closing and name not in ended:
                m = _END[name].search(html, at)
                if m:
                    text.append(" ")
                    at = m.start()
                elif name in RAW:
                    break
                else:
                    ended.add(name)
            continue
        if name == "br":
            text.append("\n")
        elif name in INLINE:
            if name == "a":
                links = not closing
            elif name in ("img", "wbr"):
                continue
            elif closing:
                if count[name] and opened[-1][0] == name:
                    flush()
                    pop()
            elif not attributes.endswith("/") and not count["pre"] and (count[name] or _role(name, attributes, in_article) != (False, 0)):
                flush()
                push(name, attributes)
        else:
            flush()
            if closing:
                if count[name]:
                    links = False
                    while pop() != name:  # end tags left out are closed with the element around them
                        pass
            elif name not in VOID:
                if opened and (opened[-1][0] == "p" or opened[-1][0] == name == "li"):
                    pop()  # its end tag was left out
                if not attributes.endswith("/"):
                    push(name, attributes)
    flush()
    return out


def _features(found: list[Block]) -> np.ndarray:
    """The tree's features. Hints are void on a page that has running text under hints alone: they speak of its layout. Inside
    an article a hint does not overrule running text, but for reader comments."""
    plain = sum(b.words for b in found if not b.framed and not b.hint)
    void = plain < 10 and any(b.hint in (1, 2) and not b.framed and b.words >= RUNNING and b.density < 0.5 for b in found)
    w = np.array([0, *(b.words for b in found), 0], float)
    d = np.array([0, *(b.density for b in found), 0])
    hint = [2 if b.hint == 3 else 0 if void or b.inside and b.words >= RUNNING and b.density < 0.3 else b.hint for b in found]
    return np.column_stack([w[1:-1], d[1:-1], w[:-2], d[:-2], w[2:], d[2:], hint])


def main_text(html: str) -> str:
    """The main text of a page: its candidate blocks that the tree takes, joined by empty lines."""
    found = blocks(html)
    if not found:
        return ""
    taken = block_tree().score(_features(found)) > 0
    return "\n\n".join(b.text for b, t in zip(found, taken.tolist(), strict=True) if t and not b.framed)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as ``page_id, url, text, n_chars``: the main text and its code points.

    A null or empty html, or one without main text, gives an empty text. Broken markup is read as far as it goes. One
    row per row; repeated rows stay; other columns are ignored; an empty table gives no rows. No shuffle.
    """

    def work(page_id, url, html):
        texts = [main_text(h.as_py() or "") for h in html]
        return page_id, url, texts, list(map(len, texts))

    return map_blocks(pages.selectExpr("cast(page_id as bigint) page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long", rows=64)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(table(spark, sf_dir, "pages"))
