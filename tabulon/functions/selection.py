"""Exact quantiles of many columns at once by distributed selection, without a map of their values.

A round counts the values of equal bins between the least and the most of what is still open; the bin of each wanted rank
becomes the next interval, narrowed to the least and most of its values. Intervals of few rows are finished by counting
their distinct values. What the driver gets in a round is bounded by the number of columns, quantiles and bins, and so is what a task holds; a thousand
bins narrow a trillion rows to a few hundred in three rounds, unless their values span very many orders of magnitude.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an interval that are counted by value.
FEW = 2000
#: Numbers that a round may send to the driver, about.
SENT = 100_000


@dataclass
class _Open:
    """An interval of one column that holds wanted ranks; ``before`` values are smaller."""

    column: int
    low: float
    high: float
    before: int
    n: int
    ranks: list[int]
    by_value: bool = False


def _gather(waiting: list[_Open], bins: int):
    """Counts the values of Arrow batches by interval and bin, or by value, with the least and the most of each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros((len(waiting), bins), np.int64)
        least, most = np.full((len(waiting), bins), np.inf), np.full((len(waiting), bins), -np.inf)
        each: dict[tuple[int, float], int] = {}
        for batch in batches:
            for k, o in enumerate(waiting):
                x = batch.column(o.column).to_numpy(zero_copy_only=False)
                x = x[(x >= o.low) & (x <= o.high)]  # unknown ones are NaN
                if o.by_value:
                    for v, n in zip(*np.unique(x, return_counts=True), strict=True):
                        each[k, float(v)] = each.get((k, float(v)), 0) + int(n)
                elif len(x):
                    at = np.minimum(((x / 2 - o.low / 2) / (o.high / 2 - o.low / 2) * bins).astype(np.int64), bins - 1)
                    counts[k] += np.bincount(at, minlength=bins)
                    np.minimum.at(least[k], at, x)
                    np.maximum.at(most[k], at, x)
        k, at = np.nonzero(counts)
        n, a, b = counts[k, at], least[k, at], most[k, at]
        vk, v = (np.array([key[i] for key in each], kind) for i, kind in enumerate((np.int64, np.float64)))
        columns = [np.r_[k, vk].astype(np.int32), np.r_[at, np.full(len(v), -1)].astype(np.int32), np.r_[np.zeros(len(k)), v], np.r_[n, np.fromiter(each.values(), np.int64, len(each))], np.r_[a, v], np.r_[b, v]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "bin", "v", "n", "a", "b"])

    return run


def order_statistics(df: DataFrame, columns: list[Column], ranks) -> tuple[list[int], list[dict[int, float]]]:
    """How many known values each column has, and the values at ``ranks(n)`` (counted from 0) of each; NaN is unknown."""
    known = []
    for c in columns:
        x = c.cast("double")
        known.append(F.when(~F.isnan(x), x))
    if not known:
        return [], []
    row = df.agg(*[e.alias(f"{n}{i}") for i, x in enumerate(known) for n, e in (("n", F.count(x)), ("a", F.min(x)), ("b", F.max(x)))]).first()
    counts = [row[f"n{i}"] for i in range(len(known))]
    found: list[dict[int, float]] = [{} for _ in known]
    waiting = [_Open(i, row[f"a{i}"], row[f"b{i}"], 0, n, sorted(set(ranks(n)))) for i, n in enumerate(counts) if n]
    while waiting := [o for o in waiting if not _ends(o, found)]:
        bins = max(16, min(1024, SENT // len(waiting)))
        for o in waiting:
            o.by_value |= o.n <= FEW or o.high / 2 - o.low / 2 <= 0
        rows = df.select(*[x.alias(f"x{i}") for i, x in enumerate(known)]).mapInArrow(_gather(waiting, bins), "k int, bin int, v double, n long, a double, b double")
        got: dict[int, list] = {}
        for r in rows.groupBy("k", "bin", "v").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).collect():
            got.setdefault(r["k"], []).append((r["a"], r["b"], r["n"]))
        following = []
        for k, o in enumerate(waiting):
            before = o.before
            for a, b, n in sorted(got.get(k, [])):
                mine = [q for q in o.ranks if before <= q < before + n]
                if mine:
                    stuck = n == o.n and (a, b) == (o.low, o.high)
                    following.append(_Open(o.column, a, b, before, n, mine, stuck))
                before += n
        waiting = following
    return counts, found


def _ends(o: _Open, found: list[dict[int, float]]) -> bool:
    """Takes the ranks at the ends of an interval, and whether none is left inside."""
    rest = []
    for q in o.ranks:
        if q == o.before or o.low == o.high:
            found[o.column][q] = o.low
        elif q == o.before + o.n - 1:
            found[o.column][q] = o.high
        else:
            rest.append(q)
    o.ranks = rest
    return not rest


def exact_quantiles(df: DataFrame, columns: list[Column], at: list[float]) -> list[list[float | None]]:
    """The quantiles ``at`` of each column by linear interpolation, null for a column without values; NaN is left out.

    Two passes for few rows, three or four for many; each evaluates ``df`` once for all columns.
    """

    def wanted(n: int) -> list[int]:
        return [r for p in at for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]

    out = []
    for n, values in zip(*order_statistics(df, columns, wanted), strict=True):
        mine: list[float | None] = []
        for p in at:
            if not n:
                mine.append(None)
                continue
            place = p * (n - 1)
            a, b = math.floor(place), math.ceil(place)
            low, high = values[a], values[b]
            mine.append(low if low == high else (b - place) * low + (place - a) * high)
        out.append(mine)
    return out


def quantile_arrays(df: DataFrame, columns: list[Column], at: list[float], *, exact: bool = True) -> list[Column]:
    """An array of the quantiles ``at`` for each column, to be used among the aggregates of ``df``: found beforehand, or by
    sketches of bounded size where ``exact`` is false."""
    from tabulon.functions.stats import quantiles

    if not exact:
        return [quantiles(c, at, exact=False) for c in columns]
    return [F.array(*[F.lit(v).cast("double") for v in values]) for values in exact_quantiles(df, columns, at)]
