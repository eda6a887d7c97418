"""Fit once, apply later: statistics, encoders, groups and detectors as small tables to save and to apply to new rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.selection import quantile_arrays

STATE = "kind string, column_name string, a double, b double"


def _spread(row: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """One row of ``a_i, b_i`` as a state row for each column."""
    structs = [F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("column_name"), F.col(f"a_{i}").cast("double").alias("a"), F.col(f"b_{i}").cast("double").alias("b")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def fit_numbers(df: DataFrame, columns: list[str], *, fill: str | None = "mean", clip: tuple[float, float] | None = None, scale: str | None = "standard", exact: bool = True) -> DataFrame:
    """The state ``kind, column_name, a, b`` of filling (mean, median), clipping at quantiles and scaling, each fitted on what
    the steps before leave; two or three aggregates over ``df``."""
    now, state = {c: F.col(f"`{c}`").cast("double") for c in columns}, None

    def add(kind: str, of, at: list[float] | None = None) -> None:
        nonlocal state
        found = quantile_arrays(df, list(now.values()), at, exact=exact) if at else [None] * len(columns)
        pairs = [of(now[c], q) for c, q in zip(columns, found, strict=True)]
        found = _spread(df.agg(*[e.alias(f"{n}_{i}") for i, p in enumerate(pairs) for n, e in zip("ab", p, strict=True)]), kind, columns)
        values = {r["column_name"]: (r["a"], r["b"]) for r in found.collect()}  # a row for each column
        rows = df.sparkSession.createDataFrame([(kind, c, *map(_float, values[c])) for c in columns], STATE)
        state = rows if state is None else state.unionByName(rows)
        for c in columns:
            now[c] = _step(kind, now[c], *values[c])

    if fill:
        add("fill", lambda x, q: (F.avg(x) if q is None else q[0], F.lit(None)), None if fill == "mean" else [0.5])
    if clip:
        add("clip", lambda x, q: (q[0], q[1]), list(clip))
    if scale == "robust":
        add("scale", lambda x, q: (q[1], q[2] - q[0]), [0.25, 0.5, 0.75])
    elif scale:
        add("scale", {"standard": lambda x, q: (F.avg(x), F.stddev_pop(x)), "minmax": lambda x, q: (F.min(x), F.max(x) - F.min(x))}[scale])
    return state


def _float(v):
    return None if v is None else float(v)


def _step(kind: str, x: Column, a, b) -> Column:
    if kind == "fill":
        return F.coalesce(x, F.lit(a).cast("double"))
    if kind == "clip":
        return F.when(x.isNotNull(), F.greatest(F.lit(a).cast("double"), F.least(F.lit(b).cast("double"), x)))
    return F.when(x.isNotNull(), F.coalesce((x - F.lit(a).cast("double")) / F.lit(b if b else None).cast("double"), F.lit(0.0)))


def apply_numbers(df: DataFrame, state: DataFrame) -> DataFrame:
    """``df`` through a state of :func:`fit_numbers`; one pass of expressions, nothing is fitted."""
    values: dict[str, dict[str, tuple]] = {}
    for r in state.collect():  # a few rows for each column
        values.setdefault(r["column_name"], {})[r["kind"]] = (r["a"], r["b"])
    out = {}
    for c, steps in values.items():
        x = F.col(f"`{c}`").cast("double")
        for kind in ("fill", "clip", "scale"):
            if kind in steps:
                x = _step(kind, x, *steps[kind])
        out[c] = x
    return df.withColumns(out)


def fit_codes(df: DataFrame, columns: list[str], method: str = "frequency", target: str | None = None, smoothing: float = 10.0) -> DataFrame:
    """``column_name, value, code`` of each value: its share of the rows, its place in order, or its smoothed target mean.

    ``value`` is null in one row for each column, which holds the code of values not seen.
    """
    parts = []
    for c in columns:
        counted = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("value"))
        if method == "target":
            every = F.broadcast(df.agg(F.avg(target).alias("all_")))
            got = counted.agg(F.count(target).alias("n_"), F.avg(target).alias("m_")).crossJoin(every)
            coded = got.select("value", ((F.col("n_") * F.col("m_") + smoothing * F.col("all_")) / (F.col("n_") + smoothing)).alias("code"))
            other = df.agg(F.avg(target).alias("code"))
        elif method == "frequency":
            total = F.broadcast(df.agg(F.count(f"`{c}`").alias("all_")))
            coded = counted.agg(F.count("*").alias("n_")).crossJoin(total).select("value", (F.col("n_") / F.col("all_")).alias("code"))
            other = total.select(F.lit(0.0).alias("code"))
        else:
            from tabulon.operators.features import label_index

            coded = label_index(df.select(F.col(f"`{c}`").cast("string").alias("v_")), "v_").select("value", F.col("index").cast("double").alias("code"))
            other = df.agg(F.lit(-1.0).alias("code"))
        parts.append(coded.unionByName(other.select(F.lit(None).cast("string").alias("value"), "code")).select(F.lit(c).alias("column_name"), "value", "code"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_codes(df: DataFrame, codes: DataFrame, columns: list[str], suffix: str = "_code") -> DataFrame:
    """``df`` with a code beside each column; null stays null, values not seen get the code of the null row."""
    for i, c in enumerate(columns):
        mine = codes.where(F.col("column_name") == c)
        known = mine.where("value IS NOT NULL").select(F.col("value").alias(f"v_{i}"), F.col("code").alias(f"k_{i}"))
        other = F.broadcast(mine.where("value IS NULL").agg(F.max("code").alias(f"o_{i}")))
        joined = df.join(known, F.col(f"`{c}`").cast("string") == F.col(f"v_{i}"), "left").crossJoin(other)
        df = joined.withColumn(f"{c}{suffix}", F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(f"k_{i}", f"o_{i}"))).drop(f"v_{i}", f"k_{i}", f"o_{i}")
    return df


def save(state: DataFrame, path: str) -> None:
    """A fitted table, written as parquet."""
    state.write.mode("overwrite").parquet(path)


# --- groups and detectors ----------------------------------------------------------------------------------------


def group_centres(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """``cluster, centre, n``: the mean of each group, to which :func:`nearest_centre` assigns new rows."""
    means = F.array(*[F.avg(F.col(f"`{c}`").cast("double")) for c in columns])
    return df.where(F.col(cluster) >= 0).groupBy(F.col(cluster).alias("cluster")).agg(means.alias("centre"), F.count("*").alias("n"))


def nearest_centre(df: DataFrame, columns: list[str], centres: DataFrame, *, most: int = 10_000) -> DataFrame:
    """``df`` with ``cluster`` and ``distance`` of the nearest centre; ties go to the smaller number. ``most`` bounds the
    centres, which every row meets."""
    held = centres.limit(most + 1).agg(F.count("*").alias("n"), F.collect_list(F.struct("cluster", "centre")).alias("centres_"))
    if held.first()["n"] > most:
        raise ValueError(f"more than {most} centres")
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    square = lambda p: F.aggregate(F.zip_with(x, p["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("centres_", lambda p: F.struct(F.sqrt(square(p)).alias("distance"), p["cluster"].alias("cluster"))))
    return df.crossJoin(F.broadcast(held.select("centres_"))).withColumn("best_", best).select(*df.columns, "best_.cluster", "best_.distance")


def fit_envelope(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, mean, inverse``: a row for each column with its row of the inverse covariance."""
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    d = len(columns)
    row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    inverse = np.linalg.pinv(np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)]))
    return df.sparkSession.createDataFrame([(c, row[f"m{i}"], inverse[i].tolist()) for i, c in enumerate(columns)], "column_name string, mean double, inverse array<double>")


def envelope_distance(df: DataFrame, envelope: DataFrame, out: str = "distance") -> DataFrame:
    """``df`` with the squared Gaussian distance under a fitted envelope."""
    rows = envelope.collect()  # a row for each column
    centred = [F.col(f"`{r['column_name']}`").cast("double") - F.lit(r["mean"]) for r in rows]
    return df.withColumn(out, sum((F.lit(float(v)) * centred[i] * centred[j] for i, r in enumerate(rows) for j, v in enumerate(r["inverse"])), F.lit(0.0)))


def detector_sweep(df: DataFrame, scores: dict[str, Column], shares: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """``detector, share, limit, flagged, separation`` for each score and share of anomalies: distance of the mean scores of
    flagged and other rows in standard deviations. Two passes over ``df``."""
    names = sorted(scores)
    scored = df.select(*[scores[n].cast("double").alias(f"s{i}") for i, n in enumerate(names)])
    at = F.array(*[F.lit(1.0 - s) for s in shares])
    limits = F.broadcast(scored.agg(*[F.percentile(f"s{i}", at).alias(f"q{i}") for i in range(len(names))]))
    aggs = []
    for i in range(len(names)):
        for j in range(len(shares)):
            over = F.col(f"s{i}") > F.col(f"q{i}")[j]
            aggs += [F.first(F.col(f"q{i}")[j]).alias(f"l{i}_{j}"), F.count_if(over).alias(f"f{i}_{j}"), F.avg(F.when(over, F.col(f"s{i}"))).alias(f"a{i}_{j}"), F.avg(F.when(~over, F.col(f"s{i}"))).alias(f"n{i}_{j}")]
        aggs.append(F.stddev_pop(f"s{i}").alias(f"d{i}"))
    row = scored.crossJoin(limits).agg(*aggs)
    structs = [F.struct(F.lit(n).alias("detector"), F.lit(s).alias("share"), F.col(f"l{i}_{j}").alias("limit"), F.col(f"f{i}_{j}").alias("flagged"), F.try_divide(F.col(f"a{i}_{j}") - F.col(f"n{i}_{j}"), F.col(f"d{i}")).alias("separation")) for i, n in enumerate(names) for j, s in enumerate(shares)]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
