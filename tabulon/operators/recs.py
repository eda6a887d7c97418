"""Recommendations for all users at once: similarities from sparse joins, never a dense matrix or a cross join."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabulon.functions.storage import cut, stored


def prepare(df: DataFrame, user: str, item: str, rating: str, *, least_user: int = 5, least_item: int = 5) -> DataFrame:
    """``user, item, rating``: one row for each pair (the first by rating), of active users and items."""
    rows = df.select(F.col(user).alias("user"), F.col(item).alias("item"), F.col(rating).cast("double").alias("rating")).na.drop()
    rows = stored(rows.groupBy("user", "item").agg(F.min("rating").alias("rating")), "ratings")
    kept = rows
    for side, least in (("user", least_user), ("item", least_item)):
        idle = rows.groupBy(side).agg(F.count("*").alias("n_")).where(F.col("n_") < least).select(side)
        kept = kept.join(_light(idle), side, "left_anti")
    return stored(kept.select("user", "item", "rating"), "ratings")


def _light(keys: DataFrame, few: int = 500_000) -> DataFrame:
    """``keys``, to be broadcast where they are few, so that the side they are joined to stays in place."""
    return F.broadcast(keys) if keys.limit(few + 1).count() <= few else keys


def statistics(ratings: DataFrame) -> DataFrame:
    """One row: users, items, interactions, sparsity, mean rating."""
    a = ratings.agg(F.count_distinct("user").alias("users"), F.count_distinct("item").alias("items"), F.count("*").alias("interactions"), F.avg("rating").alias("mean_rating"))
    return a.withColumn("sparsity", 1 - F.col("interactions") / (F.col("users") * F.col("items")))


def activity_histograms(ratings: DataFrame, bins: int = 10) -> DataFrame:
    """``side, bin, low, high, n``: how many users (items) have how many ratings, in equal bins from the least to the most; and
    the same of the ratings themselves. Empty bins have no row; one value only is one bin."""
    parts = [ratings.groupBy(side).agg(F.count("*").cast("double").alias("v")).select(F.lit(side).alias("side"), "v") for side in ("user", "item")]
    rows = parts[0].unionByName(parts[1]).unionByName(ratings.select(F.lit("rating").alias("side"), F.col("rating").cast("double").alias("v")))
    spans = F.broadcast(rows.groupBy("side").agg(F.min("v").alias("least"), F.max("v").alias("most")))  # three rows
    width = (F.col("most") - F.col("least")) / bins
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("least"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = rows.join(spans, "side").groupBy("side", "least", "most", at.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select("side", "bin", (F.col("least") + F.col("bin") * width).alias("low"), (F.col("least") + (F.col("bin") + 1) * width).alias("high"), "n")


#: Pairs of ratings by one user (or item) that a range of items meets at most, that a range has before it is split for more tasks, and
#: those that a task holds at once.
BLOCK, LEAST, CHUNK = 64_000_000, 4_000_000, 2_000_000
#: Ranges whose bits one number holds.
MASK = 62


def _ranges(df: DataFrame, work: int, block: int, least: int = LEAST) -> int:
    """Ranges of about ``block`` units of ``work``; of fewer, so that all tasks have one, while a range keeps ``least``."""
    return max(1, -(-work // block), min(df.sparkSession.sparkContext.defaultParallelism, work // least))


def _narrow(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """``columns`` in the shortest numeric type that holds all their values exactly."""
    kinds = dict(df.dtypes)
    ends = {"smallint": 1 << 15, "int": 1 << 31}
    steps = {c: ["smallint", "int", *(["float"] if kinds[c] == "double" else [])] for c in columns if kinds[c] in ("bigint", "int", "double")}
    if not steps:
        return {c: F.col(c) for c in columns}
    whole = lambda c: F.col(c) == F.rint(c) if kinds[c] == "double" else F.lit(True)
    same = lambda c, k: whole(c) & F.col(c).between(-ends[k], ends[k] - 1) if k in ends else F.col(c).cast(k).cast(kinds[c]) == F.col(c)
    facts = df.agg(*[F.bool_and(F.coalesce(same(c, k), F.col(c).isNull())).alias(f"{c}_{k}") for c, some in steps.items() for k in some]).first()
    return {c: F.col(c).cast(next((k for k in steps.get(c, []) if facts[f"{c}_{k}"]), kinds[c])) for c in columns}


def _dealt(sent: DataFrame, ranges: int, one, schema: str) -> DataFrame:
    """``one(p, batches)``, which yields pandas frames, over the rows of each range ``p``; a range is one task."""

    shape = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches):
        held = {}
        for batch in batches:
            p = batch.column("p").to_numpy()
            for now in np.unique(p):
                held.setdefault(int(now), []).append(batch.filter(pa.array(p == now)) if (p != now).any() else batch)
        while held:
            for frame in one(*held.popitem()):
                yield pa.RecordBatch.from_pandas(frame, schema=shape, preserve_index=False)

    return sent.repartitionById(ranges, "p").mapInArrow(work, schema)


def _flat(batches, column: str) -> pa.Array:
    """The values of a column's lists in one array."""
    return pa.concat_arrays([b.column(column).flatten() for b in batches])


def _coded(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    coded = values.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(names, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return names[order].astype(np.int64) if names.dtype.kind == "i" else names[order], rank[coded.indices.to_numpy()]


def _met(rows: DataFrame, finish, schema: str, *, needs: tuple[str, ...] = ("r", "q", "s"), most: int | None = None, block: int | None = None, chunk: int | None = None) -> DataFrame:
    """``finish`` over all pairs of different ``x`` that share ``z``, in both directions, all pairs of an ``x`` at once.

    ``x`` is cut into ranges of about ``block`` pairs, and each ``z`` sends its list once to every range it has an ``x`` in; no
    pair is shuffled. A task goes through its range ``chunk`` pairs at a time (or one ``x``). ``finish(a, b, dot, qa, sa, qb, sb)``
    gets arrays ordered by ``a`` and ``b`` with the sum of rating products, the squares' sums and the sums of either side. Lists hold
    what it ``needs`` only (``r`` for products, else pairs are counted; ``q``, ``s``), in the shortest types that are exact.
    """
    rows = rows.where("x IS NOT NULL")
    met = F.col("z").isNotNull() if most is None else F.col("z").isNotNull() & (F.col("m") <= most)
    work = rows.groupBy("z").agg(F.count("*").alias("m")).where(met).agg(F.sum(F.col("m") * F.col("m")).alias("w")).first()["w"] or 0
    whole = Window.partitionBy("x")
    blocks = _ranges(rows, int(work), block or BLOCK)
    given = {"r": F.col("rating").cast("double"), "q": F.sum(F.col("rating") * F.col("rating")).over(whole).cast("double"), "s": F.sum("rating").over(whole).cast("double")}
    placed = stored(rows.repartitionByRange(blocks, "x").select("x", "z", *[given[n].alias(n) for n in needs], F.spark_partition_id().alias("p")), "ranges")
    short = _narrow(placed, ["x", *needs])
    entry = F.struct(F.col("p").cast("smallint" if blocks < 1 << 15 else "int").alias("p"), *[c.alias(n) for n, c in short.items()])
    lists = placed.groupBy("z").agg(F.sort_array(F.collect_list(entry)).alias("l")).withColumn("m", F.size("l")).where(met)
    apart = lists.select(F.array_distinct("l.p").alias("ps"), F.col("l.p").alias("of"), *[F.col(f"l.{n}").alias(n) for n in short])
    sent = apart.select(F.explode("ps").alias("p"), "of", *short).withColumn("p", F.col("p").cast("int"))
    chunk = chunk or CHUNK

    def one(p, batches):
        sizes = np.concatenate([b.column("of").value_lengths().to_numpy() for b in batches]).astype(np.int64)
        own = np.flatnonzero(_flat(batches, "of").to_numpy() == p)
        ids, at = _coded(_flat(batches, "x"))
        held = {n: _flat(batches, n).to_numpy(zero_copy_only=False) for n in needs}
        batches.clear()
        r, sides = held.get("r"), {}
        for n in ("q", "s"):
            if n in needs:
                sides[n] = np.empty(len(ids))
                sides[n][at] = held.pop(n)
        of = np.searchsorted(np.cumsum(sizes), own, side="right")  # the list of each own entry
        order = np.argsort(at[own], kind="stable")
        own, of = own[order], of[order]
        start, size = (np.cumsum(sizes) - sizes)[of], sizes[of]
        upto, ends = np.cumsum(size), np.flatnonzero(np.r_[at[own][1:] != at[own][:-1], True])
        i = 0
        while i < len(own):
            done = upto[i - 1] if i else 0
            k = np.searchsorted(upto[ends], done + chunk, side="right") - 1
            j = int(ends[max(k, np.searchsorted(ends, i))]) + 1
            n = size[i:j]
            left = np.repeat(own[i:j], n)
            right = np.repeat(start[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key = at[left].astype(np.int64) * len(ids) + at[right]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            dot = np.diff(np.r_[first, len(key)]) if r is None else np.add.reduceat((r[left].astype(float) * r[right])[order], first)
            a, b = key[first] // len(ids), key[first] % len(ids)
            a, b, dot = (v[a != b] for v in (a, b, dot))
            if len(a):
                yield finish(ids[a], ids[b], dot, *[sides[n][side] if n in sides else None for side in (a, b) for n in ("q", "s")])
            i = j

    return _dealt(sent, blocks, one, schema)


def similarity(ratings: DataFrame, by: str = "item", metric: str = "cosine", *, neighbours: int | None = 50, most: int | None = None, totals: bool = False) -> DataFrame:
    """``a, b, similarity`` between items (or users) that share users (items), the best ``neighbours`` of each (or all).

    ``metric``: cosine, pearson or euclid (1 / (1 + distance)) on the zero-filled matrix; all come from the sums of shared
    ratings and the norms. All ratings count, unless ``most`` leaves out sides with more: these give no pairs, but stay in the norms.
    ``totals`` gives ``a, n, best, total, size`` instead: the number of an item's similarities to all others, the largest, their sum
    and that of their absolute values; they are summed where the pairs are made.
    """
    other = "user" if by == "item" else "item"
    rows = ratings.select(F.col(by).alias("x"), F.col(other).alias("z"), "rating")
    kind = dict(rows.dtypes)["x"]
    width = rows.agg(F.count_distinct("z")).first()[0] if metric == "pearson" else 0

    def finish(a, b, dot, qa, sa, qb, sb):
        with np.errstate(divide="ignore", invalid="ignore"):
            if metric == "cosine":
                low, value = np.sqrt(qa) * np.sqrt(qb), dot
            elif metric == "euclid":
                low, value = 1 + np.sqrt(np.maximum(0.0, qa + qb - 2 * dot)), np.ones(len(dot))
            else:
                low, value = np.sqrt(qa - sa * sa / width) * np.sqrt(qb - sb * sb / width), dot - sa * sb / width
            value = np.where(low == 0, np.nan, value / low)
        if totals:
            heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            known = np.where(np.isnan(value), 0.0, value)
            best = np.fmax.reduceat(value, heads)
            return pd.DataFrame({"a": a[heads], "n": np.diff(np.r_[heads, len(a)]), "best": best, "total": np.where(np.isnan(best), np.nan, np.add.reduceat(known, heads)), "size": np.add.reduceat(np.abs(known), heads)})
        out = pd.DataFrame({"a": a, "b": b, "similarity": value})
        if neighbours is None:
            return out
        out = out.sort_values("similarity", ascending=False, kind="stable")  # ties stay by b
        return out[out.groupby("a", sort=False).cumcount() < neighbours]

    shape = f"a {kind}, n long, best double, total double, size double" if totals else f"a {kind}, b {kind}, similarity double"
    return _met(rows, finish, shape, needs=("r", "q", "s") if metric == "pearson" else ("r", "q"), most=most)


def _askers(placed: DataFrame, key: str) -> DataFrame:
    """``key, g, m``: the ranges ``p`` that have a key, as the bits of numbers ``m``, ``MASK`` ranges each."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p") % MASK)
    return placed.groupBy(key, F.floor(F.col("p") / MASK).cast("int").alias("g")).agg(F.bit_or(bit).alias("m"))


def _to_askers(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` once for each range ``p`` of ``g, m``."""
    on = F.filter(F.sequence(F.lit(0), F.lit(MASK - 1)), lambda i: F.call_function("shiftright", F.col("m"), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return df.select(F.explode(on).alias("p"), "g", *columns).select((F.col("g") * MASK + F.col("p")).cast("int").alias("p"), *columns)


def reachable(ratings: DataFrame, *, block: int = 2_000_000, room: int = 1 << 28) -> DataFrame:
    """``user, items``: how many items are similar to any that the user rated, that is, share a user with another item.

    Users lie in ranges of about ``block`` ratings; a range gets once the list of each user that shares an item with one of its
    own. There a user's items are marked through these lists; what an item reaches is kept as a row of bits (``room`` bytes at
    most) where that is less work than going through its users' lists for each user of the range again.
    """
    rows = ratings.where("user IS NOT NULL AND item IS NOT NULL").select("user", "item")
    blocks = _ranges(rows, rows.count(), block, 100_000)
    placed = stored(rows.repartitionByRange(blocks, "user").withColumn("p", F.spark_partition_id()), "ranges")
    shared = _askers(placed, "item").join(placed.select("item", "user"), "item").groupBy("user", "g").agg(F.bit_or("m").alias("m"))
    lists = placed.select("user", _narrow(placed, ["item"])["item"].alias("item"), "p").groupBy("user").agg(F.sort_array(F.collect_set("item")).alias("l"), F.min("p").alias("home"))
    sent = _to_askers(shared.join(lists, "user"), "user", "home", "l")

    def one(p, batches):
        size = np.concatenate([b.column("l").value_lengths().to_numpy() for b in batches]).astype(np.int64)
        users = pa.concat_arrays([b.column("user") for b in batches])
        mine = np.flatnonzero(np.concatenate([b.column("home").to_numpy() for b in batches]) == p)
        ids, i = _coded(_flat(batches, "l"))
        batches.clear()
        start = np.cumsum(size) - size
        own = np.concatenate([i[start[v] : start[v] + size[v]] for v in mine])
        often = np.bincount(own, minlength=len(ids))  # users of this range, by item
        kept = often[i] > 0
        of, by = np.repeat(np.arange(len(size), dtype=np.int32), size)[kept], i[kept]
        of = of[np.argsort(by, kind="stable")]  # the users of each item asked for
        upto = np.r_[0, np.cumsum(np.bincount(by, minlength=len(ids)))]
        long = np.bincount(np.repeat(np.arange(len(ids)), np.diff(upto)), size[of], len(ids))
        crowded = 25 * long * often > 25 * long + 20_000 + len(ids) * (0.2 + 0.02 * often)  # about nanoseconds: through lists each time, or by bits
        flag, width = np.zeros(len(ids), bool), -(-len(ids) // 64) * 8

        def mark(lists):
            for a in np.split(lists, np.flatnonzero(np.diff(np.cumsum(size[lists]) // CHUNK)) + 1):
                n = size[a]
                flag[i[np.repeat(start[a] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True

        def counted(some):
            entries = np.concatenate([i[start[v] : start[v] + size[v]] for v in some])
            held = np.unique(entries[crowded[entries]])
            if len(held) * width > room:
                if len(some) > 1:
                    yield from counted(some[: len(some) // 2])
                    yield from counted(some[len(some) // 2 :])
                    return
                held = held[:0]
            bits, place = np.zeros((len(held), width), np.uint8), np.full(len(ids), -1)
            place[held] = np.arange(len(held))
            for k, item in enumerate(held):
                flag[:] = False
                mark(of[upto[item] : upto[item + 1]])
                packed = np.packbits(flag)
                bits[k, : len(packed)] = packed
            bits = bits.view(np.uint64)
            for v in some:
                a = i[start[v] : start[v] + size[v]]
                k = place[a]
                known = np.bitwise_or.reduce(bits[k[k >= 0]], axis=0)
                more = a[k < 0]
                if len(more):
                    flag[:] = np.unpackbits(known.view(np.uint8), count=len(ids)) if len(more) < len(a) else False
                    mark(np.unique(np.concatenate([of[upto[x] : upto[x + 1]] for x in more])))
                # an only item isn't similar to itself
                yield (np.count_nonzero(flag) if len(more) else int(np.bitwise_count(known).sum())) - (len(a) == 1)

        if len(mine):
            yield pd.DataFrame({"user": users.take(pa.array(mine)).to_numpy(zero_copy_only=False), "items": np.fromiter(counted(mine), np.int64, len(mine))})

    return _dealt(sent, blocks, one, f"user {dict(rows.dtypes)['user']}, items long")


def _scored(ratings: DataFrame, similar: DataFrame, then, schema: str, *, k: int, block: int, chunk: int, own: DataFrame | None = None) -> DataFrame:
    """``then(found, seen)`` over the scores of items near what users rated, whole users at a time.

    Users lie in ranges of about ``block`` ratings met by neighbours; an item's list of neighbours goes once to each range
    that rated it, and the rows of candidates are made, ranked and summed there ``chunk`` at a time (or one user), never
    shuffled. ``found`` has ``user, item, score`` (and ``worth``, if ``similar`` gives one for ``b``), ordered by user and item;
    ``seen`` whether the user rated it.

    With ``own`` (user, item, mean) the roles are those of similar users: ``ratings`` hold a similar user as ``item`` and how similar,
    ``similar`` what that user thinks of ``b``; the former are ranked and weigh the latter. Users' own items and ``mean`` come from there.
    """
    met = similar.where("a IS NOT NULL AND b IS NOT NULL")
    value = {"s": "similarity"} | ({"w": "worth"} if "worth" in met.columns else {})
    listed = F.collect_list(F.struct("b", *[F.coalesce(c, F.lit(float("nan"))).alias(n) for n, c in value.items()]))  # in one order
    lists = met.groupBy(F.col("a").alias("item")).agg(listed.alias("l")).select("item", *[F.col(f"l.{n}").alias(n) for n in ("b", *value)])
    lists = stored(lists, "neighbours")
    rows = ratings.where("user IS NOT NULL AND item IS NOT NULL").select("user", "item", F.col("rating").cast("double").alias("r"))
    width = lists.agg(F.avg(F.size("b"))).first()[0] or 1.0
    blocks = _ranges(rows, int(rows.count() * width), block)
    placed = stored(rows.repartitionByRange(blocks, "user").withColumn("p", F.spark_partition_id()), "ranges")
    short = _narrow(placed, ["user", "item", "r"])
    every = lists.select(F.explode("b").alias("b")) if own is None else lists.select(F.explode("b").alias("b")).unionByName(own.select(F.col("item").alias("b")))
    kinds = {"b": _narrow(every, ["b"])["b"]} | {n: F.col(n) for n in value}
    kinds = {n: every.select(c).dtypes[0][1] if n == "b" else "double" for n, c in kinds.items()}
    some = {n: F.col(n).cast(f"array<{t}>").alias(n) for n, t in kinds.items()}
    none = {n: F.array().cast(f"array<{t}>").alias(n) for n, t in kinds.items()}  # not null: Arrow's writer takes long over runs of null lists
    types = dict(placed.select(*[c.alias(n) for n, c in short.items()]).dtypes)
    empty = lambda n: F.lit(None).cast(types[n]).alias(n)
    # a rating has no list, a list of neighbours no user
    both = placed.select("p", *[c.alias(n) for n, c in short.items()], *none.values())
    sent = _to_askers(_askers(placed, "item").join(lists, "item"), "item", "b", *value)
    both = both.unionByName(sent.select("p", empty("user"), F.col("item").cast(types["item"]), empty("r"), *some.values()))
    if own is not None:
        home = placed.groupBy("user").agg(F.min("p").alias("p"))
        theirs = own.groupBy("user").agg(F.collect_list("item").alias("b"), F.collect_list(F.lit(0.0)).alias("s"), F.min("mean").alias("r")).join(home, "user")
        both = both.unionByName(theirs.select("p", F.col("user").cast(types["user"]), empty("item"), F.col("r").cast("double"), *some.values()))

    by_users = own is not None

    def one(_, batches):
        every = pa.Table.from_batches(batches)
        batches.clear()
        rated = pc.equal(pc.list_value_length(every["b"]), 0)
        mine, lists = every.filter(rated), every.filter(pc.and_(pc.invert(rated), pc.is_null(every["user"])))
        seen = every.filter(pc.and_(pc.invert(rated), pc.is_valid(every["user"])))
        del every
        if not len(mine) or not len(lists):
            return
        users, u = _coded(mine["user"].combine_chunks())
        items, i = _coded(pa.concat_arrays([*mine["item"].chunks, *lists["item"].chunks]))
        turn = np.argsort(i[len(mine) :], kind="stable")
        lists, which = lists.take(pa.array(turn)), np.full(len(items), -1)
        which[i[len(mine) :][turn]] = np.arange(len(lists))
        i = i[: len(mine)]
        flat = lambda t, n: pa.concat_arrays([c.flatten() for c in t[n].chunks] or [pa.array([], t.schema.field(n).type.value_type)])
        size = pc.list_value_length(lists["b"]).to_numpy().astype(np.int64)
        start = np.cumsum(size) - size
        ids, cand = _coded(pa.concat_arrays([flat(lists, "b"), flat(seen, "b")]))
        cand, theirs = cand[: size.sum()], cand[size.sum() :]
        near = flat(lists, "s").to_numpy()
        worth = np.full(len(ids), np.nan)
        if "w" in value:
            worth[cand] = flat(lists, "w").to_numpy()
        del lists
        order = np.lexsort((i, u))
        u, i, r = u[order], i[order], mine["r"].to_numpy()[order].astype(float)
        mean = np.full(len(users), np.nan)
        if not by_users:
            at = np.searchsorted(ids, items).clip(max=len(ids) - 1)
            at = np.where(ids[at] == items, at, -1)[i]  # a user's own item among the candidates
            known = np.unique((u.astype(np.int64) * len(ids) + at)[at >= 0])
        else:
            who = np.searchsorted(users, seen["user"].to_numpy())
            mean[who] = seen["r"].to_numpy()
            known = np.unique(np.repeat(who, pc.list_value_length(seen["b"]).to_numpy()) * len(ids) + theirs)
        l = which[i]
        u, r, l = u[l >= 0], r[l >= 0], l[l >= 0]
        upto = np.cumsum(size[l])
        ends = np.flatnonzero(np.r_[u[1:] != u[:-1], True]) if len(u) else np.array([], int)
        first = 0
        while first < len(u):
            done = upto[first - 1] if first else 0
            e = np.searchsorted(upto[ends], done + chunk, side="right") - 1
            last = int(ends[max(e, np.searchsorted(ends, first))]) + 1
            n = size[l[first:last]]
            src = np.repeat(np.arange(first, last), n)
            to = np.repeat(start[l[first:last]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key = u[src].astype(np.int64) * len(ids) + cand[to]
            turn = np.argsort(key, kind="stable")  # sources of a pair stay by item
            key, sim, rate = key[turn], near[to[turn]], r[src[turn]]
            if by_users:
                sim, rate = rate, sim
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            many = np.diff(np.r_[heads, len(key)])
            if many.max() > k:
                turn = np.lexsort((-sim, key))
                key, sim, rate = key[turn], sim[turn], rate[turn]
                keep = np.arange(len(key)) - np.repeat(heads, many) < k
                key, sim, rate = key[keep], sim[keep], rate[keep]
                heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            top, low = sim * rate, np.abs(sim)
            above, below = np.add.reduceat(np.where(np.isnan(top), 0.0, top), heads), np.add.reduceat(np.where(np.isnan(low), 0.0, low), heads)
            bare = np.logical_and.reduceat(np.isnan(top), heads) | (below == 0)
            score = np.where(bare, np.nan, above / np.where(bare, 1.0, below))
            pair = key[heads]
            if by_users:
                score = mean[pair // len(ids)] + np.where(bare, 0.0, score)
            found = pd.DataFrame({"user": users[pair // len(ids)], "item": ids[pair % len(ids)], "score": score} | ({"worth": worth[pair % len(ids)]} if "w" in value else {}))
            yield then(found, np.isin(pair, known, assume_unique=True))
            first = last

    return _dealt(both, blocks, one, schema)


def _best(found: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series]:
    """Rows by user, falling score and item, and their rank for the user."""
    found = found.sort_values(["user", "score"], ascending=[True, False], kind="stable", na_position="last")  # ties stay by item
    return found, found.groupby("user", sort=False).cumcount() + 1


def _pair(ratings: DataFrame, similar: DataFrame, *more: str) -> str:
    kinds = dict(ratings.dtypes), dict(similar.dtypes)
    return ", ".join([f"user {kinds[0]['user']}", f"item {kinds[1]['b']}", *more])


def predict_items(ratings: DataFrame, similar: DataFrame, *, k: int = 50, block: int = BLOCK // 2, chunk: int = CHUNK) -> DataFrame:
    """``user, item, score`` for items near what a user rated: Σ similarity · rating / Σ |similarity| over ``k`` neighbours."""
    return _scored(ratings, similar, lambda found, _: found, _pair(ratings, similar, "score double"), k=k, block=block, chunk=chunk)


def recommend_items(ratings: DataFrame, similar: DataFrame, n: int = 10, *, k: int = 50, block: int = BLOCK // 2, chunk: int = CHUNK) -> DataFrame:
    """``user, item, score, rank``: :func:`top_n` of :func:`predict_items` among items that the user has not rated, without
    a row for each candidate leaving its task."""

    def best(found, seen):
        found, rank = _best(found[~seen])
        return found.assign(rank=rank.astype("int32"))[rank <= n]

    return _scored(ratings, similar, best, _pair(ratings, similar, "score double", "rank int"), k=k, block=block, chunk=chunk)


def blend_popular(ratings: DataFrame, similar: DataFrame, popular: DataFrame, *, k: int = 50, block: int = BLOCK // 2, chunk: int = CHUNK) -> DataFrame:
    """``user, item, score``: :func:`blend` by ``rank`` of :func:`predict_items` and of the popularity (item, score) of the same
    items; both are ranked where a user's items are scored. Popularity comes along with the neighbours."""

    def both(found, _):
        own = _best(found)[1]
        popular = _best(found.assign(score=found["worth"]).dropna(subset="score"))[1]
        return found[["user", "item"]].assign(score=1 / (pd.concat([own, popular], axis=1).mean(axis=1) + 1))

    worth = similar.join(popular.select(F.col("item").alias("b"), F.col("score").cast("double").alias("worth")), "b", "left")
    return _scored(ratings, worth, both, _pair(ratings, similar, "score double"), k=k, block=block, chunk=chunk)


def predict_users(ratings: DataFrame, similar: DataFrame, *, k: int = 50, block: int = BLOCK // 2, chunk: int = CHUNK) -> DataFrame:
    """``user, item, score``: the user's mean plus the weighted deviations of ``k`` similar users who rated the item."""
    return _by_users(ratings, similar, lambda found, _: found.dropna(subset="score"), "score double", k=k, block=block, chunk=chunk)


def recommend_users(ratings: DataFrame, similar: DataFrame, n: int = 10, *, k: int = 50, block: int = BLOCK // 2, chunk: int = CHUNK) -> DataFrame:
    """``user, item, score, rank``: :func:`top_n` of :func:`predict_users` among items that the user has not rated, without
    a row for each candidate leaving its task."""

    def best(found, seen):
        found, rank = _best(found[~seen].dropna(subset="score"))
        return found.assign(rank=rank.astype("int32"))[rank <= n]

    return _by_users(ratings, similar, best, "score double, rank int", k=k, block=block, chunk=chunk)


def _by_users(ratings: DataFrame, similar: DataFrame, then, more: str, **limits) -> DataFrame:
    """:func:`_scored` of similar users: each has a list of items and how far their ratings are from that user's mean."""
    means = ratings.groupBy("user").agg(F.avg("rating").alias("mean"))
    own = stored(ratings.where("user IS NOT NULL AND item IS NOT NULL").join(means, "user").select("user", "item", "mean", (F.col("rating") - F.col("mean")).alias("d")), "deviations")
    theirs = own.select(F.col("user").alias("a"), F.col("item").alias("b"), F.col("d").alias("similarity"))
    asked = similar.select(F.col("a").alias("user"), F.col("b").alias("item"), F.coalesce("similarity", F.lit(float("nan"))).alias("rating"))
    kinds = dict(ratings.dtypes)
    return _scored(asked, theirs, then, f"user {dict(similar.dtypes)['a']}, item {kinds['item']}, {more}", own=own, **limits)


def popularity(ratings: DataFrame) -> DataFrame:
    """``item, n, mean, score`` of every item: count times mean rating."""
    return ratings.groupBy("item").agg(F.count("*").alias("n"), F.avg("rating").alias("mean")).withColumn("score", F.col("n") * F.col("mean"))


def popular(ratings: DataFrame, k: int = 100) -> DataFrame:
    """``item, n, mean, score, rank`` of the ``k`` items of largest count times mean rating."""
    return popularity(ratings).orderBy(F.desc("score"), "item").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "item")))


def top_n(scores: DataFrame, seen: DataFrame, n: int = 10) -> DataFrame:
    """``user, item, score, rank``: the ``n`` best items of each user that the user has not seen.

    They are among the best ``n`` and as many more as the user has seen; only these meet what was seen. Pairs of
    ``scores`` are unique.
    """
    w = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    known = seen.select("user", "item").distinct()
    first = scores.withColumn("rank", F.row_number().over(w)).join(known.groupBy("user").agg(F.count("*").alias("m_")), "user", "left")
    first = first.where(F.col("rank") <= n + F.coalesce("m_", F.lit(0))).drop("rank", "m_")
    fresh = first.join(known, ["user", "item"], "left_anti")
    return fresh.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def with_fallback(recommended: DataFrame, users: DataFrame, ratings: DataFrame, n: int = 10) -> DataFrame:
    """``recommended`` plus the most popular items for users who have no recommendation; their number is bounded by ``n``."""
    best = F.broadcast(popular(ratings, n).select("item", "score", "rank"))
    cold = users.select("user").distinct().join(recommended.select("user"), "user", "left_anti")
    return recommended.select("user", "item", "score", "rank").unionByName(cold.crossJoin(best))


def factorise(ratings: DataFrame, *, rank: int = 10, rounds: int = 5, implicit: bool = False, seed: int = 42) -> DataFrame:
    """``user, item, score`` of the given pairs by alternating least squares over integer ids; unknown pairs get the mean."""
    from pyspark.ml.recommendation import ALS

    rows = ratings.select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), "rating")
    model = ALS(rank=rank, maxIter=rounds, userCol="user", itemCol="item", ratingCol="rating", implicitPrefs=implicit, alpha=40.0, seed=seed, nonnegative=True, coldStartStrategy="nan").fit(rows)
    mean = F.broadcast(rows.agg(F.avg("rating").alias("mean_")))
    return model.transform(rows).crossJoin(mean).select("user", "item", F.coalesce(F.nanvl("prediction", F.col("mean_")), "mean_").cast("double").alias("score"))


def biases(ratings: DataFrame, *, rounds: int = 3, damping: float = 10.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mean rating (one row ``mean``), ``user, user_bias`` and ``item, item_bias``.

    Items first, then users, each from what the mean and the other side leave, summed over the ratings plus ``damping``, in
    turn for ``rounds``; so that a side with few ratings stays near 0. Two joins and two sums for each round, over rows that
    are written once.
    """
    mean = cut(ratings.agg(F.avg("rating").alias("mean")))
    rows = stored(ratings.crossJoin(F.broadcast(mean)).select("user", "item", (F.col("rating") - F.col("mean")).alias("d")), "deviations")
    side = lambda left, key: cut(left.groupBy(key).agg((F.sum("d") / (F.count("*") + damping)).alias(f"{key}_bias")))
    less = lambda known, key: rows.join(known, key).withColumn("d", F.col("d") - F.col(f"{key}_bias"))
    items = side(rows, "item")
    users = side(less(items, "item"), "user")
    for _ in range(rounds - 1):
        items = side(less(users, "user"), "item")
        users = side(less(items, "item"), "user")
    return mean, users, items


def biased_scores(pairs: DataFrame, mean: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """``pairs`` with ``score``: the mean and both biases; users and items not seen have none."""
    known = pairs.join(users, "user", "left").join(items, "item", "left").crossJoin(F.broadcast(mean))
    return known.select(*[F.col(f"`{c}`") for c in pairs.columns], (F.col("mean") + F.coalesce("user_bias", F.lit(0.0)) + F.coalesce("item_bias", F.lit(0.0))).alias("score"))


def factorise_biased(ratings: DataFrame, asked: DataFrame | None = None, *, rank: int = 10, rounds: int = 5, bias_rounds: int = 3, damping: float = 10.0, regularisation: float = 0.5, seed: int = 42, known: tuple[DataFrame, DataFrame, DataFrame] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``user, item, score`` of ``asked`` pairs (by default those rated): mean, biases, and factors of what these leave.

    The factors are alternating least squares over the residuals, in units of their deviation, so that they needn't carry how
    users and items rate in general; a user or item without factors keeps mean and biases. ``bias_rounds=0`` leaves the
    biases out. ``known`` gives the :func:`biases` of these ratings where the caller has them, ``keep`` names columns of ``asked`` that
    stay.
    """
    from pyspark.ml.recommendation import ALS

    asked = (ratings if asked is None else asked).select("user", "item", *keep)
    mean, users, items = known or biases(ratings, rounds=bias_rounds, damping=damping)
    as_ids = lambda df, *more: df.select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), *more)
    left = stored(as_ids(biased_scores(ratings.select("user", "item", "rating"), mean, users, items), (F.col("rating") - F.col("score")).alias("rating")), "residuals")
    unit = left.agg(F.stddev_pop("rating")).first()[0] or 1.0
    left = left.withColumn("rating", F.col("rating") / unit)
    model = ALS(rank=rank, maxIter=rounds, regParam=regularisation, userCol="user", itemCol="item", ratingCol="rating", seed=seed, coldStartStrategy="nan", checkpointInterval=1).fit(left)  # so that a round's shuffle files go with the round
    found = model.transform(as_ids(biased_scores(asked, mean, users, items), *keep, "score"))
    return found.select("user", "item", *keep, (F.col("score") + unit * F.coalesce(F.nanvl("prediction", F.lit(0.0)), F.lit(0.0))).cast("double").alias("score"))


def blend(parts: dict[str, tuple[DataFrame, float]], how: str = "average") -> DataFrame:
    """``user, item, score`` from several score tables: weighted ``average``, ``rank`` fusion (1 / (mean rank + 1)) or ``sum``."""
    rows = None
    for name, (df, weight) in sorted(parts.items()):
        w = Window.partitionBy("user").orderBy(F.desc("score"), "item")
        part = df.select("user", "item", "score", F.row_number().over(w).alias("r"), F.lit(float(weight)).alias("w"), F.lit(name).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    value = {"average": F.sum(F.col("w") * F.col("score")) / F.sum("w"), "rank": 1 / (F.avg("r") + 1), "sum": F.sum("score")}[how]
    return rows.groupBy("user", "item").agg(value.alias("score"))


def context_blend(ratings: DataFrame, context: str, base: DataFrame, weight: float = 0.3, least: int = 10) -> DataFrame:
    """``user, item, context, score``: base scores moved towards the item's mean in each context with over ``least`` rows."""
    by_context = ratings.groupBy("item", F.col(context).alias("context")).agg(F.avg("rating").alias("c_"), F.count("*").alias("n_"))
    enough = ratings.groupBy(F.col(context).alias("context")).agg(F.count("*").alias("m_")).where(F.col("m_") > least)
    joined = base.join(by_context.join(enough, "context"), "item")
    return joined.select("user", "item", "context", ((1 - weight) * F.col("score") + weight * F.col("c_")).alias("score"))


def ranking_metrics(recommended: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """``k, users, precision, recall, f1, ndcg, map``: means over the users with relevant items (``truth``: user, item)."""
    wanted = truth.select("user", "item").distinct()
    sizes = wanted.groupBy("user").agg(F.count("*").alias("relevant"))
    hits = recommended.select("user", "item", "rank").join(wanted.withColumn("hit", F.lit(1)), ["user", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = Window.partitionBy("user").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("upto", F.sum("hit").over(w))
    gain = lambda i: 1 / F.log2(i + 1.0)
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias(f"h{k}"), F.sum(F.when(inside, F.col("hit") * gain(F.col("rank"))).otherwise(0.0)).alias(f"d{k}"), F.sum(F.when(inside, F.col("hit") * F.col("upto") / F.col("rank")).otherwise(0.0)).alias(f"a{k}")]
    by_user = sizes.join(hits.groupBy("user").agg(*aggs), "user", "left")
    structs = []
    for k in ks:
        h, n = F.coalesce(F.col(f"h{k}"), F.lit(0)), F.col("relevant")
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + gain(i.cast("double")))
        structs.append(F.struct(F.lit(k).alias("k"), (h / k).alias("p"), (h / n).alias("r"), (F.coalesce(F.col(f"d{k}"), F.lit(0.0)) / ideal).alias("nd"), (F.coalesce(F.col(f"a{k}"), F.lit(0.0)) / F.least(n, F.lit(k))).alias("ap")))
    rows = by_user.select(F.explode(F.array(*structs)).alias("m")).select("m.*")
    out = rows.groupBy("k").agg(F.count("*").alias("users"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("nd").alias("ndcg"), F.avg("ap").alias("map"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def diversity(recommended: DataFrame, attributes: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``diversity, users``: mean over users of 1 less the mean share of equal attributes in a list's pairs."""
    a = recommended.select("user", "item").join(attributes.select("item", *columns), "item")
    left = a.select("user", F.col("item").alias("i"), *[F.col(c).alias(f"{c}_l") for c in columns])
    right = a.select("user", F.col("item").alias("j"), *[F.col(c).alias(f"{c}_r") for c in columns])
    equal = sum((F.coalesce((F.col(f"{c}_l") == F.col(f"{c}_r")).cast("double"), F.lit(0.5)) for c in columns), F.lit(0.0)) / len(columns)
    return left.join(right, "user").where("i < j").groupBy("user").agg((1 - F.avg(equal)).alias("d")).agg(F.avg("d").alias("diversity"), F.count("*").alias("users"))


def coverage(recommended: DataFrame, ratings: DataFrame, k: int = 100) -> DataFrame:
    """One row ``coverage, novelty``: share of the catalogue recommended; .3 for popular items, .8 for others, averaged."""
    best = popular(ratings, k).select("item", F.lit(1).alias("popular"))
    novelty = recommended.join(F.broadcast(best), "item", "left").agg(F.avg(F.when(F.col("popular") == 1, 0.3).otherwise(0.8)).alias("novelty"), F.count_distinct("item").alias("shown"))
    return novelty.crossJoin(F.broadcast(ratings.agg(F.count_distinct("item").alias("catalogue")))).select((F.col("shown") / F.col("catalogue")).alias("coverage"), "novelty")


def content_similarity(attributes: DataFrame, columns: list[str], *, neighbours: int = 10) -> DataFrame:
    """``a, b, similarity``: the nearest items by the share of equal attributes, among those that agree in any; ties by id.

    For every set of columns, items equal in it meet only its ``neighbours + 1`` smallest ids: each smaller id there is at
    least as similar and comes first, so no true neighbour is lost. Equal rows are compared once, as a class.
    """
    from itertools import combinations

    rows = attributes.select("item", *columns)
    classes = rows.select(*columns).distinct().withColumn("class", F.struct(*columns))
    found = None
    for size in range(1, len(columns) + 1):
        for some in combinations(columns, size):
            w = Window.partitionBy(*some).orderBy("item")
            first = rows.na.drop(subset=list(some)).withColumn("i_", F.row_number().over(w)).where(F.col("i_") <= neighbours + 1)
            part = classes.select("class", *some).join(first.select(*some, F.struct("item", *columns).alias("b")), list(some)).select("class", "b")
            found = part if found is None else found.unionByName(part)
    equal = sum((F.coalesce((F.col(f"class.{c}") == F.col(f"b.{c}")).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0)) / len(columns)
    pairs = found.select("class", F.col("b.item").alias("b"), equal.alias("similarity")).distinct()
    w = Window.partitionBy("class").orderBy(F.desc("similarity"), "b")
    best = pairs.withColumn("i_", F.row_number().over(w)).where(F.col("i_") <= neighbours + 1)
    lists = best.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("i_", "b", "similarity"))).alias("l"))
    members = rows.select(F.col("item").alias("a"), F.struct(*columns).alias("class"))
    mine = members.join(lists, members["class"].eqNullSafe(lists["class"])).select("a", F.explode(F.slice(F.filter("l", lambda x: x["b"] != F.col("a")), 1, neighbours)).alias("x"))
    return mine.select("a", "x.b", "x.similarity")


def pair_rules(baskets: DataFrame, basket: str, item: str, *, least_support: float = 0.0, most: int | None = None) -> DataFrame:
    """``a, b, n, support, confidence, lift`` of item pairs that share baskets (of at most ``most`` items, if given).

    A pair is in no more baskets than either item, so only items that reach ``least_support`` themselves are paired."""
    rows = stored(baskets.select(F.col(basket).alias("k"), F.col(item).alias("x")).distinct(), "baskets")
    total = rows.agg(F.count_distinct("k").alias("total")).first()["total"]
    counts = stored(rows.groupBy("x").agg(F.count("*").alias("n_")).where(F.try_divide("n_", F.lit(total)) >= least_support), "counts")
    kind = dict(rows.dtypes)["x"]
    paired = rows if most is None else rows.join(rows.groupBy("k").agg(F.count("*").alias("m_")).where(F.col("m_") <= most).select("k"), "k", "left_semi")
    paired = paired.join(_light(counts.select("x")), "x", "left_semi")

    def finish(a, b, n, *_):
        enough = n / total >= least_support
        return pd.DataFrame({"a": a[enough], "b": b[enough], "n": n[enough]})

    met = _met(paired.select("x", F.col("k").alias("z")), finish, f"a {kind}, b {kind}, n long", needs=())
    pairs = met.withColumn("support", F.col("n") / F.lit(total))
    joined = pairs.join(counts.select(F.col("x").alias("a"), F.col("n_").alias("na")), "a").join(counts.select(F.col("x").alias("b"), F.col("n_").alias("nb")), "b")
    return joined.select("a", "b", "n", "support", (F.col("n") / F.col("na")).alias("confidence"), (F.col("n") * F.lit(total) / (F.col("na") * F.col("nb"))).alias("lift"))


def rerank_diverse(recommended: DataFrame, similar: DataFrame, *, weight: float = 0.1, compat: bool = False) -> DataFrame:
    """``recommended`` re-ranked by score plus ``weight`` times 1 less the similarity to the most similar earlier item."""
    a = recommended.select("user", F.col("item").alias("a"), F.col("rank").alias("ra"))
    b = recommended.select("user", F.col("item").alias("b"), F.col("rank").alias("rb"))
    near = a.join(b, "user").where("rb < ra").join(similar, ["a", "b"], "left").groupBy("user", "a").agg((F.min if compat else F.max)(F.coalesce("similarity", F.lit(0.0))).alias("s"))
    joined = recommended.join(near.withColumnRenamed("a", "item"), ["user", "item"], "left")
    scored = joined.withColumn("score", F.col("score") + weight * (1 - F.coalesce("s", F.lit(0.0)))).drop("s", "rank")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item")))


def algorithm_choice(ratings: DataFrame) -> DataFrame:
    """One row ``algorithm, sparsity, users``: by sparsity and size."""
    s = statistics(ratings)
    pick = F.when(F.col("sparsity") > 0.99, "matrix_factorisation").when(F.col("users") > 10_000, "item_based").when(F.col("sparsity") < 0.9, "user_based").otherwise("hybrid")
    return s.select(pick.alias("algorithm"), "sparsity", "users")


def algorithms(ratings: DataFrame, *, attributes: bool = False) -> DataFrame:
    """``algorithm`` rows worth training: popularity and factors always, collaborative filtering below a sparsity of .99 with
    over 100 users and items, content where items have attributes."""
    facts = statistics(ratings)
    dense = (F.col("sparsity") < 0.99) & (F.col("users") > 100) & (F.col("items") > 100)
    listed = F.array(F.lit("popularity"), F.lit("matrix_factorisation"), F.when(dense, "collaborative"), F.lit("content" if attributes else None).cast("string"))
    return facts.select(F.explode(F.filter(listed, lambda a: a.isNotNull())).alias("algorithm"))


def best_model(metrics: DataFrame) -> DataFrame:
    """The row of ``metrics`` (model, precision, recall, ndcg) with the best .4 · precision + .3 · recall + .3 · NDCG."""
    scored = metrics.withColumn("combined", 0.4 * F.col("precision") + 0.3 * F.col("recall") + 0.3 * F.col("ndcg"))
    return scored.orderBy(F.desc("combined"), "model").limit(1)


def explained(recommended: DataFrame, reason: Column) -> DataFrame:
    """``recommended`` with a sentence on why."""
    return recommended.withColumn("explanation", F.concat_ws(" ", F.lit("Recommended at rank"), F.col("rank").cast("string"), F.lit("because"), reason))


def business_impact(recommended: DataFrame, *, conversion: float, order_value: float) -> DataFrame:
    """One row ``recommendations, users, expected_orders, expected_revenue``."""
    a = recommended.agg(F.count("*").alias("recommendations"), F.count_distinct("user").alias("users"))
    return a.withColumns({"expected_orders": F.col("recommendations") * conversion, "expected_revenue": F.col("recommendations") * conversion * order_value})
