"""Personal data: strict patterns find base spans; weak supervision adds further ones.

Everything on the main path is a DataFrame expression. Candidate spans (numbers, pairs of capitalised words) get votes of
four labelers each, which may abstain and disagree: shape (regex), gazetteers, a check (sums and ranges for numbers, family
names and places for names) and context words. The corpus is aggregated to counts by pattern of votes and features, a
bounded table; expectation maximisation on it estimates how often each labeler is right about either class, its posteriors
train a logistic regression over votes and features, and that classifier scores every candidate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import sha256, table

#: Patterns of the base kinds, in their listed order. Each matches what the plain pattern matches, leftmost and not
#: overlapping; possessive quantifiers and the looks behind only keep the matcher from trying runs again and again.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)

#: Candidates beyond the base kinds: separated digits or a long run of them, and capitalised pairs of words.
NUMBER = r"(?=[0-9(])(?<![\p{L}0-9+.,$€£#_-])(?:(?:\([0-9]{2,5}\)[\x20-]?)?[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){1,4}|[0-9]{9,19})(?![\p{L}0-9_]|[.,-][0-9])"
NAME = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}{1,20}\x20(?:\p{Lu}\.\x20)?\p{Lu}\p{Ll}{1,20}(?![\p{L}\p{N}])"
CANDIDATES = {"number": NUMBER, "name": NAME}
#: What a text with a match must hold: a character, or a pattern that is cheap to look for.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){7}", "phone": "+", "number": "[0-9][0-9]", "name": r"\p{Lu}\p{Ll}++\x20\p{Lu}"}

#: Gazetteers: common given and family names of the four languages, words of places, calendars and firms, large area codes.
GIVEN = """Alexander Alice Amelie Ana Andrea Andrew Anna Anthony Antonio Barbara Benjamin Bernard Bernd Birgit Brian Camille Carlos
Carmen Caroline Charles Charlotte Christian Christine Claire Claudia Daniel David Dieter Elena Elisabeth Elizabeth Emily Emma
Eric Eva Felix Fernando Francisco Frank Gabriel George Hannah Hans Heinrich Helen Ines Isabel Jacques James Javier Jean Jennifer
Jessica Joachim John Jorge Jose Joseph Juan Julia Julien Karen Karin Karl Katherine Katja Klaus Laura Leon Linda Louis Louise Lucas
Lucia Luis Lukas Manuel Marc Margaret Maria Marie Mark Markus Marta Martin Mary Mathilde Maximilian Michael Michelle Miguel Monika
Nancy Nathalie Nicole Olivia Pablo Patricia Patrick Paul Pedro Peter Petra Philippe Pierre Rafael Richard Robert Rosa Sabine Sandra
Sarah Sebastian Simon Sofia Sophie Stefan Steven Susan Sylvie Teresa Thomas Tobias Ursula Victor Walter William Wolfgang Yves""".split()
FAMILY = """Adams Allen Alvarez Anderson Baker Bauer Becker Bernard Bertrand Blanc Bonnet Braun Brown Campbell Carter Clark Collins
Cooper Davis Diaz Dubois Dupont Durand Edwards Evans Fernandez Fischer Fontaine Garcia Garnier Gomez Gonzalez Green Gutierrez Hall
Harris Hartmann Hernandez Hill Hoffmann Jackson Johnson Jones Keller King Klein Koch Krause Krüger Lambert Lange Laurent Lefebvre
Legrand Lehmann Leroy Lewis Lopez Marchand Martinez Mercier Meyer Miller Mitchell Moore Morales Moreau Moreno Morris Müller Muñoz
Murphy Nelson Neumann Ortiz Parker Perez Petit Phillips Ramirez Reyes Richter Rivera Roberts Robinson Rodriguez Romero Roux Ruiz
Sanchez Schmidt Schmitt Schneider Schröder Schulz Schwarz Scott Simon Smith Suarez Taylor Thompson Torres Turner Wagner Walker Weber
Werner White Williams Wilson Wolf Wright Young Zimmermann""".split()
PLACES = """Avenue Bank Bay Beach Berlin Boulevard Bridge Castle Center Centre Church City Club College Company Corporation County Court
East Festival Forest Foundation France Fund Garden Group Hall Hill Hospital Hotel Institute International Island Lake London Madrid
Market Mountain Museum National New North Ocean Palace Paris Park Plaza Port River Road Royal Saint San Santa School Sea Society South
Square Station Street Theatre Tower United University Valley Village West World York January February March April May June July August
September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Januar Februar März Mai Juni Juli Oktober
Dezember Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag The This That These When With From And But For""".split()
AREAS = """201 202 205 206 212 213 214 215 216 301 303 305 310 312 313 314 315 317 323 336 347 404 407 408 410 412 413 414 415 416 424 425
469 470 480 503 504 510 512 513 514 516 601 602 603 604 609 610 612 614 615 616 617 618 619 646 650 678 702 703 704 706 707 708 713 714
716 718 719 720 757 770 772 773 774 801 802 803 804 805 808 813 815 816 817 818 832 845 847 858 860 901 903 904 908 909 910 912 913 914
915 916 917 918 919 925 949 954 970 971 972 973 978 980""".split()

#: Words before a span that speak for personal data and against, and words after it that speak against.
FOR = r"(?i)(?:phone|tel|telefon|téléphone|teléfono|mobile|cell|fax|call|ssn|social security|passport|iban|account|konto|compte|cuenta|card|karte|tarjeta|carte|dob|born|name|named|contact|contacto|signed|patient|client|herr|frau|mr|mrs|ms|dr|prof|señor|señora|madame|monsieur)\.?(?: (?:number|no|is|at|by))?:?\x20*$"
AGAINST = r"(?i)(?:isbn|issn|version|page|pages|pp|vol|volume|chapter|figure|fig|table|year|years|price|total|item|order|model|serial|room|part|street|saint|san|st|in|near|of|on)\.?:?\x20*$"
#: Articles and the like, of the four languages, which don't stand before a person's name.
ARTICLES = r"(?i)(?<![\p{L}\p{N}])(?:the|a|an|our|your|my|his|its|their|this|that|these|those|every|each|some|any|no|to|into|at|from|der|die|das|den|dem|des|ein|eine|einen|le|la|les|l'|un|une|du|au|aux|el|los|las|una|del|al)\x20$"
AFTER = r"(?i)^\x20?(?:%|€|\$|kg|km|mm|cm|mb|gb|hz|usd|eur|euros?|dollars?|pages?|inc|ltd|gmbh|street|avenue|road|river|lake|university|museum|park|city)\b"
STRICT = r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\([0-9]{3}\)[\x20-]?[0-9]{3}-[0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}|(?:[0-9]{2}[\x20]){4}[0-9]{2}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$"
LOOSE = r"^(?:[0-9]{4}[-.][0-9]{2}(?:[-.][0-9]{2})?|[0-9]{4}[\x20-][0-9]{4}|[0-9]{2}[.-][0-9]{2}|[0-9]{1,3}(?:[\x20.][0-9]{3})+|97[89]-?.*)$"
LABELERS = ("shape", "gazetteer", "check", "context")
#: First guesses of the labelers' shares of right votes, by kind; sums rarely come out right or wrong by chance.
GUESS = {"number": (0.85, 0.85, 0.97, 0.85), "name": (0.6, 0.85, 0.85, 0.95)}
#: What those shares are at most. Two capitalised words alone say little: titles and places look the same.
MOST = {"number": (0.99, 0.99, 0.99, 0.99), "name": (0.7, 0.99, 0.99, 0.99)}


def marked(text: Column, pattern: str, gate: str) -> Column:
    """``text`` split at the matches of a Java pattern: what stands before the first, then each match with what follows.

    Matches are marked with two control characters, which are replaced in the text first, one for one; no pattern here
    can match those. The mark at a match's end stays in the part. Null if nothing matches: ``gate`` is a cheap pattern
    that a text with matches has, so that most texts are never copied.
    """
    clean = F.when(text.rlike("[\u0001\u0002]"), F.translate(text, "\u0001\u0002", "\u0003\u0003")).otherwise(text)
    has = text.contains(gate) if len(gate) == 1 else text.rlike(gate)
    return F.when(has & text.rlike(pattern), F.split(F.regexp_replace(clean, pattern, "\u0001$0\u0002"), "\u0001", -1))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, of) -> Column:
    """For each element of an int array, ``of`` (sum, or greatest) over those before it, beginning with zero.

    Runs of about the square root of the length are folded one by one, so that no array grows element by element.
    """

    def scan(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, first, lambda acc, v: F.struct(of(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def whole(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int")), lambda k: F.slice(v, k * size + 1, size))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))

        def step(acc: Column, part: Column) -> Column:
            return _let(scan(part, acc["at"]), lambda done: F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

        return F.flatten(F.aggregate(runs, first, step, lambda acc: acc["out"]))

    return _let(values, whole)


SPANS = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def found(parts: Column) -> Column:
    """Spans ``array<struct<start, end, match, before, after>>`` of :func:`marked` parts; code points, end exclusive.

    ``before`` is what stands in front back to the match before, ``after`` what follows up to the next; 24 characters at
    most. ``parts`` should be a column of an earlier projection, since it is used more than once.
    """
    sizes = F.transform(parts, lambda p, i: F.char_length(p) - F.when(i > 0, 1).otherwise(0))

    def span(start: Column, i: Column) -> Column:
        part, last = F.element_at(parts, i + 1), F.element_at(parts, i)
        match = F.substring_index(part, "\u0002", 1)
        before = F.right(F.replace(F.right(last, F.lit(25)), F.lit("\u0002"), F.lit("")), F.lit(24))
        after = F.left(F.substring_index(part, "\u0002", -1), F.lit(24))
        return F.struct(start.alias("start"), (start + F.char_length(match)).alias("end"), match.alias("match"), before.alias("before"), after.alias("after"))

    def spans(starts: Column) -> Column:
        return F.transform(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), lambda start, i: span(start, i + 1))

    return F.when(F.size(parts) > 1, _let(running(sizes, lambda a, b: a + b), spans)).otherwise(F.array().cast(SPANS))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True if a string of digits has a Luhn check sum of zero."""
    back = F.reverse(digits)
    one = lambda i: F.substr(back, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, one(i)).otherwise(F.when(one(i) > 4, one(i) * 2 - 9).otherwise(one(i) * 2))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        trimmed = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(trimmed, lambda p: (F.char_length(p) <= 3) & (F.substr(p, F.lit(1), F.lit(3)).cast("int") <= 255))
    size = F.char_length(_digits(match))
    if kind == "card":
        return F.when(size.between(16, 19), _luhn(_digits(match))).otherwise(False)
    return size.between(8, 15) if kind == "phone" else F.lit(True)


def _of_kind(parts: Column, kind: str) -> Column:
    """Valid spans of one base kind."""
    return F.filter(found(parts), lambda s: _valid(kind, s["match"]))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "+").when(no, "-").otherwise("0")


def _number_features(span: Column) -> Column:
    """Votes of the four labelers on a number, then its digits, separators, groups and what stands before it."""
    m, b, d = span["match"], span["before"], _digits(span["match"])
    n = F.char_length(d)
    shape = _vote(m.rlike(STRICT), m.rlike(LOOSE))
    area = (n == 10) & ~m.rlike(r"^[0-9]{9}") | m.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")
    issuer = n.between(15, 19)
    known = F.when(area, _vote(F.left(d, F.lit(3)).isin(AREAS), d.rlike("^[01]"))).when(issuer, _vote(d.rlike("^(?:4|5[1-5]|3[47]|35|6011|65|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720))"), F.lit(True))).when(m.rlike(r"^(?:19|20)[0-9]{2}(?![0-9])"), "-").otherwise("0")
    social = m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    check = F.when(social, _vote(~d.rlike("^(?:000|666|9)|^...00|0000$"), F.lit(True))).when(issuer, _vote(_luhn(d), F.lit(True))).otherwise("0")
    context = _vote(b.rlike(FOR), b.rlike(AGAINST) | span["after"].rlike(AFTER))
    size = F.when(n <= 5, "a").when(n <= 8, "b").when(n == 9, "c").when(n <= 11, "d").when(n <= 14, "e").otherwise("f")
    separator = F.when(m.contains("("), "(").when(m.contains("-"), "-").when(m.contains("."), ".").when(m.contains(" "), "_").otherwise("n")
    groups = F.least(F.size(F.split(m, r"[\x20.-]")), F.lit(4)).cast("string")
    return F.concat(shape, known, check, context, size, separator, groups, F.when(b.rlike(r":\x20*$"), ":").otherwise("0"))


def _name_features(span: Column) -> Column:
    """Votes of the four labelers on a pair of capitalised words, then its length, initial and place in the sentence."""
    words = F.split(span["match"], " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    begins = span["before"].rlike(r"(?:^|[.!?:;\n\u2026\u00bb\u201d\"]\s*)$")
    short = (F.char_length(first) < 3) | (F.char_length(last) < 3)
    initial = F.size(words) == 3
    shape = _vote(initial | (~begins & ~short & (first != last)), (first == last) | short)
    given = _vote(first.isin(GIVEN), first.isin(PLACES))
    family = _vote(last.isin(FAMILY), last.isin(PLACES))
    against = span["before"].rlike(AGAINST) | span["before"].rlike(ARTICLES) | span["after"].rlike(AFTER) | span["after"].rlike(r"^\x20\p{Lu}\p{Ll}")
    context = _vote(span["before"].rlike(FOR), against)
    size = F.when(F.char_length(span["match"]) > 14, "l").otherwise("s")
    return F.concat(shape, given, family, context, size, F.when(initial, "i").otherwise("o"), F.when(begins, "b").otherwise("m"))


def _candidates(parts: Column, kind: str) -> Column:
    """Candidate spans of one further kind with their feature patterns."""
    pattern = _name_features if kind == "name" else _number_features
    return F.transform(found(parts), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), pattern(s).alias("pattern")))


@dataclass(frozen=True)
class KindModel:
    """Labelers' estimated shares of right votes on spans that are personal data and on others, and the classifier.

    ``weights`` has a bias and a table from character to weight for each place of a feature pattern.
    """

    true_right: tuple[float, ...]
    false_right: tuple[float, ...]
    share: float
    bias: float
    weights: tuple[dict[str, float], ...]

    def score(self, pattern: str) -> float:
        """Probability that a candidate of this pattern is personal data."""
        return float(1 / (1 + np.exp(-self.bias - sum(w.get(c, 0.0) for w, c in zip(self.weights, pattern, strict=True)))))

    def column(self, pattern: Column) -> Column:
        """:meth:`score` as an expression."""
        total = F.lit(self.bias)
        for i, table_ in enumerate(self.weights):
            letter = F.substr(pattern, F.lit(i + 1), F.lit(1))
            weight = F.lit(0.0)
            for c, w in sorted(table_.items()):
                weight = F.when(letter == c, F.lit(w)).otherwise(weight)
            total = total + weight
        return 1 / (1 + F.exp(-total))


@dataclass(frozen=True)
class SpanModel:
    """A model for each kind that has candidates, and the probability from which a candidate is taken."""

    kinds: dict[str, KindModel]
    threshold: float = 0.6


def fit_kind(counts: dict[str, int], guess: tuple[float, ...] = GUESS["name"], most: tuple[float, ...] = MOST["name"], *, rounds: int = 60, steps: int = 800, prior: float = 0.2, sure: float = 20.0) -> KindModel:
    """Expectation maximisation over vote patterns, then a logistic regression on its posteriors.

    ``counts`` has the number of candidates by pattern, a bounded number of them whatever the corpus. Each labeler has one
    share of right votes on either class; abstentions say nothing. ``sure`` pseudo-votes hold rare labelers near their
    first ``guess``, and shares stay between 0.5 and ``most``, so a labeler never counts against what it says. Patterns weigh by
    the square root of their counts in the regression, so that one frequent pattern does not drown the rest.
    """
    keys = sorted(counts)
    votes = np.array([[{"+": 1, "-": -1}.get(c, 0) for c in k[: len(LABELERS)]] for k in keys])
    n = np.array([counts[k] for k in keys], float)
    said, yes = votes != 0, votes == 1
    first = np.array(guess)
    right = np.tile(first, (2, 1))  # on what is personal data, on what is not
    share = prior
    for _ in range(rounds):
        true = np.where(yes, np.log(right[0]), np.log(1 - right[0]))
        false = np.where(yes, np.log(1 - right[1]), np.log(right[1]))
        p = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + ((true - false) * said).sum(1))))
        for k, (weight, agrees) in enumerate(((n * p, yes), (n * (1 - p), ~yes))):
            right[k] = (weight @ (said & agrees) + first * sure) / (weight @ said + sure)
        right = np.clip(right, 0.5, np.array(most))
        share = float(np.clip((n @ p + sure * prior) / (n.sum() + sure), 0.02, 0.6))
    names = sorted({(i, c) for k in keys for i, c in enumerate(k)})
    at = {name: j for j, name in enumerate(names)}
    x = np.zeros((len(keys), len(names)))
    for row, k in zip(x, keys, strict=True):
        row[[at[i, c] for i, c in enumerate(k)]] = 1
    w, bias, weight = np.zeros(len(names)), 0.0, np.sqrt(n) / np.sqrt(n).sum()
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-(x @ w + bias))) - p)
        w -= 1.5 * (x.T @ error + 1e-3 * w)
        bias -= 1.5 * error.sum()
    weights = tuple({c: round(float(w[at[i, c]]), 6) for i2, c in names if i2 == i} for i in range(len(keys[0])))
    return KindModel(tuple(right[0].round(4).tolist()), tuple(right[1].round(4).tolist()), round(share, 4), round(float(bias), 6), weights)


def train_spans(docs: DataFrame) -> SpanModel:
    """The span model from the candidates of all documents: one pass, one aggregation to bounded pattern counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(*[marked(text, p, GATES[k]).alias(k) for k, p in CANDIDATES.items()])
    spans = parts.select(F.explode(F.concat(*[_candidates(F.col(k), k) for k in CANDIDATES])).alias("c"))
    rows = spans.groupBy(F.col("c.kind").alias("kind"), F.col("c.pattern").alias("pattern")).count().collect()
    counts: dict[str, dict[str, int]] = {}
    for r in rows:
        counts.setdefault(r["kind"], {})[r["pattern"]] = r["count"]
    return SpanModel({kind: fit_kind(c, GUESS[kind], MOST[kind]) for kind, c in sorted(counts.items())})


def _taken(model: SpanModel, kind: str):
    return lambda c: model.kinds[kind].column(c["pattern"]) >= model.threshold


def with_spans(docs: DataFrame, text: Column, model: SpanModel) -> DataFrame:
    """``docs`` packed in a struct ``row``, with one column of spans by base kind, and ``added``."""
    further = {k: p for k, p in CANDIDATES.items() if k in model.kinds}
    text = F.coalesce(text, F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    parts = docs.select(row, *[marked(text, p, GATES[k]).alias(k) for k, p in (BASE | further).items()])
    spans = parts.select("row", *[_of_kind(F.col(k), k).alias(k) for k in KINDS], *[F.filter(_candidates(F.col(k), k), _taken(model, k)).alias(k) for k in further])
    if not further:
        return spans.withColumn("added", F.array().cast("array<struct<kind:string,start:int,end:int,pattern:string>>"))
    return spans.select("row", *KINDS, _apart(F.concat(*further), [F.col(k) for k in KINDS]).alias("added"))


#: More than any place in a text.
_FAR = 2**30


def _apart(candidates: Column, base: list[Column]) -> Column:
    """The candidates that overlap no base span, by start: all spans in one sorted list, and for each the furthest end of the
    base spans before it and the nearest start of those behind, so that the time follows the number of spans."""
    kind = "struct<kind:string,start:int,end:int,pattern:string>"
    of = lambda spans, flag, held: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(flag).alias("flag"), s["end"].alias("end"), held(s).alias("held")))
    every = F.array_sort(F.concat(*[of(b, 0, lambda s: F.lit(None).cast(kind)) for b in base], of(candidates, 1, lambda s: s.cast(kind))))

    def kept(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: F.when(s["flag"] == 0, s["end"]).otherwise(0)), F.greatest)
        ahead = F.reverse(running(F.transform(F.reverse(spans), lambda s: F.when(s["flag"] == 0, _FAR - s["start"]).otherwise(0)), F.greatest))
        free = F.zip_with(F.arrays_zip(spans.alias("s"), reach.alias("reach")), ahead, lambda x, a: F.when((x["s"]["flag"] == 1) & (x["reach"] <= x["s"]["start"]) & (_FAR - a >= x["s"]["end"]), x["s"]["held"]))
        return F.filter(free, lambda c: c.isNotNull())

    return F.when((F.size(candidates) == 0) | (F.size(F.concat(*base)) == 0), candidates).otherwise(_let(every, kept))


def find_pii(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with arrays of spans: one column by base kind, and ``added``.

    Spans are ``struct<start, end, ...>`` in code points, end exclusive. ``added`` has the candidates (with ``kind``) that
    the classifier takes and that overlap no base span. A null or empty text has no spans; repeated rows stay; other
    columns are ignored; an empty table gives no rows. Two passes without a shuffle of texts.
    """
    model = model or train_spans(docs)
    spans = with_spans(docs.select("doc_id", "text"), F.col("text"), model)
    return spans.select("row.doc_id", "row.text", *KINDS, "added")


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets, like ``[EMAIL]``; other columns stay.

    Overlapping spans become one, named after the one that starts first (of those the longest). A null text stays null, a
    text without spans as it is. One row per row, repeated rows stay, an empty table gives no rows. No shuffle of texts.
    """
    spans = with_spans(docs, F.col("text"), model or train_spans(docs))
    of = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), kind(s).alias("kind")))
    tagged = spans.select("row", F.array_sort(F.concat(*[of(F.col(k), lambda s, k=k: F.lit(k)) for k in KINDS], of(F.col("added"), lambda s: s["kind"]))).alias("spans"))
    # how far the spans before each one reach; one that starts earlier is part of them
    reach = running(F.transform("spans", lambda s: -s["minus_end"]), F.greatest)
    reached = tagged.select("row", F.zip_with("spans", reach, lambda s, r: F.struct(s["start"].alias("start"), (-s["minus_end"]).alias("end"), s["kind"].alias("kind"), r.alias("reach"))).alias("spans"))

    def joined(letters: Column) -> Column:
        piece = lambda s: F.concat(F.array_join(F.slice(letters, s["reach"] + 1, s["start"] - s["reach"]), ""), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        end = F.array_max(F.transform("spans", lambda s: s["end"]))
        tail = F.array_join(F.slice(letters, end + 1, F.size(letters)), "")
        return F.concat(F.array_join(F.transform(F.filter("spans", lambda s: s["start"] >= s["reach"]), piece), ""), tail)

    redacted = F.when(F.size("spans") > 0, _let(F.split(F.col("row.text"), ""), joined)).otherwise(F.col("row.text"))
    return reached.select(*[redacted.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _listed(spans: Column, kind: str | None = None) -> Column:
    """Spans as ``kind:start:end`` strings; without ``kind`` each names its own."""
    name = lambda s: F.lit(kind) if kind else s["kind"]
    return F.transform(spans, lambda s: F.concat(name(s), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, as counts and digests."""
    spans = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.concat(*[_listed(F.col(k), k) for k in KINDS])
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        sha256(F.array_join(listed, ",")).alias("base_sha256"),
        F.array_join(F.concat(listed, _listed(F.array_sort("added"))), ",").alias("spans"),
    )
