"""Features: encodings, scalings, date, text and interaction features, selection, splits and folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.stats import correlation, null_out_nan, numeric_columns, spread_rows

# --- rules and combinations --------------------------------------------------------------------------------------


def business_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """``df`` with a column for each rule: ``ratio``, ``binning`` (right-closed bins) or ``combination`` of columns.

    Combinations skip nulls; a ratio adds 1e-8 to the denominator.
    """
    out = {}
    for rule in rules:
        kind = rule["type"]
        if kind == "ratio":
            out[rule["name"]] = F.col(rule["numerator"]) / (F.col(rule["denominator"]) + 1e-8)
        elif kind == "binning":
            x, value = F.col(rule["feature"]), F.lit(None).cast("string")
            for low, high, label in zip(rule["bins"], rule["bins"][1:], rule["labels"], strict=False):
                value = F.when((x > low) & (x <= high), F.lit(str(label))).otherwise(value)
            out[rule["name"]] = value
        else:
            cols = [F.col(c).cast("double") for c in rule["features"]]
            known = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
            total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
            out[rule["name"]] = {"sum": total, "mean": F.when(known > 0, total / known), "max": F.greatest(*cols), "min": F.least(*cols)}[rule["operation"]]
    return df.withColumns(out)


def interactions(df: DataFrame, columns: list[str] | None = None, *, squares: bool = False, most: int = 100) -> DataFrame:
    """``df`` with products of column pairs (and squares), the ``most`` of largest variance where there are more."""
    columns = columns or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i if squares else i + 1 :]]
    made = {f"{a}_x_{b}": F.col(f"`{a}`").cast("double") * F.col(f"`{b}`").cast("double") for a, b in pairs}
    if len(made) > most:
        row = df.agg(*[F.var_samp(e).alias(n) for n, e in made.items()]).first()
        made = {n: made[n] for n in sorted(made, key=lambda n: (-(row[n] or 0.0), n))[:most]}
    return df.withColumns(made)


# --- encodings ---------------------------------------------------------------------------------------------------


def label_index(df: DataFrame, column: str) -> DataFrame:
    """``value, index``: the sorted distinct values of a column numbered from 0."""
    from tabulon.operators.clean import positions

    values = df.select(F.col(f"`{column}`").alias("value")).where("value IS NOT NULL").distinct()
    return positions(values, ["value"]).withColumnRenamed("position", "index")


def _joined(df: DataFrame, column: str, table: DataFrame, out: str, otherwise) -> DataFrame:
    """``df`` with ``out`` from a table (value, out) by ``column``."""
    held = table.select(F.col("value").alias("value_"), F.col(out))
    return df.join(held, F.col(f"`{column}`") == F.col("value_"), "left").withColumn(out, F.coalesce(out, otherwise)).drop("value_")


def label_encode(df: DataFrame, column: str, out: str, fit_on: DataFrame | None = None) -> DataFrame:
    """``df`` with the number of each value; -1 for values unseen in ``fit_on`` and nulls."""
    table = label_index(fit_on if fit_on is not None else df, column).withColumnRenamed("index", out)
    return _joined(df, column, table, out, F.lit(-1).cast("long"))


def binary_encode(df: DataFrame, column: str, bits: int) -> DataFrame:
    """``df`` with the ``bits`` lowest bits of each value's number plus one; unseen values and nulls are all zero."""
    coded = label_encode(df, column, "code_")
    return coded.withColumns({f"{column}_bit{k}": F.shiftright(F.col("code_") + 1, k).bitwiseAND(F.lit(1).cast("long")) for k in range(bits)}).drop("code_")


def one_hot(df: DataFrame, column: str, *, most: int = 20, drop_first: bool = False) -> DataFrame:
    """``df`` with an indicator for each of at most ``most`` values in sorted order; a null is zero everywhere."""
    values = [r["value"] for r in label_index(df, column).orderBy("value").limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(f"`{column}`") == v).cast("int"), F.lit(0)) for v in values[drop_first:]})


def frequency_encode(df: DataFrame, column: str, out: str, fit_on: DataFrame | None = None) -> DataFrame:
    """``df`` with how often each value occurs in ``fit_on``; 0 for unseen ones."""
    counts = (fit_on if fit_on is not None else df).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias(out))
    return _joined(df, column, counts, out, F.lit(0).cast("long"))


def target_encode(df: DataFrame, column: str, target: str, out: str, *, smoothing: float = 1.0, fit_on: DataFrame | None = None) -> DataFrame:
    """``df`` with (sum of target + m · mean) / (n + m) of each value; unseen values get the mean."""
    train = fit_on if fit_on is not None else df
    mean = F.broadcast(train.agg(F.avg(target).alias("mean_")))
    table = train.groupBy(F.col(f"`{column}`").alias("value")).agg(F.sum(target).alias("s_"), F.count(target).alias("n_")).crossJoin(mean)
    table = table.select("value", ((F.col("s_") + smoothing * F.col("mean_")) / (F.col("n_") + smoothing)).alias(out))
    return _joined(df.crossJoin(mean), column, table, out, F.col("mean_")).drop("mean_")


def leave_one_out_encode(df: DataFrame, column: str, target: str, out: str) -> DataFrame:
    """``df`` with the mean target of the other rows of the same value; the overall mean where there is none."""
    mean = F.broadcast(df.agg(F.avg(target).alias("mean_")))
    sums = df.groupBy(F.col(f"`{column}`").alias("value_")).agg(F.sum(target).alias("sum_"), F.count(target).alias("n_"))  # a row for each value
    rest = F.try_divide(F.col("sum_") - F.col(target), F.col("n_") - 1)
    met = df.join(sums, F.col(f"`{column}`").eqNullSafe(F.col("value_")), "left").crossJoin(mean)
    return met.withColumn(out, F.coalesce(rest, "mean_")).drop("value_", "sum_", "n_", "mean_")


def weight_of_evidence(df: DataFrame, column: str, target: str, out: str) -> DataFrame:
    """``df`` with ln of the share of positives over that of negatives of each value, half a row added to each count."""
    every = Window.partitionBy()
    counts = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n"))
    woe = F.ln(((F.col("p") + 0.5) / F.sum("p").over(every)) / ((F.col("n") + 0.5) / F.sum("n").over(every)))
    return _joined(df, column, counts.select("value", woe.alias(out)), out, F.lit(0.0))


def hash_encode(df: DataFrame, column: str, out: str, buckets: int = 32) -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(f"`{column}`"), F.lit(buckets)).cast("int"))


def group_rare(df: DataFrame, column: str, *, least: float = 0.01, other: str = "Other", fit_on: DataFrame | None = None) -> DataFrame:
    """``df`` with values under a share of ``least`` in ``fit_on`` replaced by ``other``; nulls stay."""
    train = fit_on if fit_on is not None else df
    total = F.broadcast(train.agg(F.count(f"`{column}`").alias("total_")))
    common = train.groupBy(F.col(f"`{column}`").alias("value_")).agg(F.count("*").alias("n_")).crossJoin(total).where(F.col("n_") >= least * F.col("total_")).select("value_")
    new = F.when(F.col(f"`{column}`").isNull(), None).otherwise(F.coalesce("value_", F.lit(other)))
    return df.join(common, F.col(f"`{column}`") == F.col("value_"), "left").withColumn(column, new).drop("value_")


# --- scalings ----------------------------------------------------------------------------------------------------


def scale(df: DataFrame, columns: list[str], method: str = "standard", *, fit_on: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """``df`` with columns scaled by statistics of ``fit_on``: standard (ddof 0), minmax or robust (median, quartiles).

    A column without spread becomes 0.
    """
    from tabulon.functions.selection import quantile_arrays

    train = fit_on if fit_on is not None else df
    aggs = []
    quartiles = quantile_arrays(train, [F.col(f"`{c}`") for c in columns], [0.25, 0.5, 0.75], exact=exact) if method == "robust" else []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        if method == "robust":
            q = quartiles[i]
            a, b = q[1], q[2] - q[0]
        else:
            a, b = (F.avg(x), F.stddev_pop(x)) if method == "standard" else (F.min(x), F.max(x) - F.min(x))
        aggs += [a.alias(f"a_{i}"), b.alias(f"b_{i}")]
    scaled = {c: F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(F.try_divide(F.col(f"`{c}`") - F.col(f"a_{i}"), F.col(f"b_{i}")), F.lit(0.0))) for i, c in enumerate(columns)}
    return df.crossJoin(F.broadcast(train.agg(*aggs))).withColumns(scaled).select(*df.columns)


def unit_length(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the row vector of ``columns`` at length 1; a zero vector stays."""
    norm = F.sqrt(sum((F.col(f"`{c}`").cast("double") * F.col(f"`{c}`") for c in columns), F.lit(0.0)))
    return df.withColumn("norm_", norm).withColumns({c: F.coalesce(F.try_divide(F.col(f"`{c}`").cast("double"), "norm_"), F.lit(0.0)) for c in columns}).drop("norm_")


#: Coefficients of a rational approximation of the inverse normal distribution (fixed values).
PROBIT_NEAR = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
PROBIT_FAR = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))


def probit(p: Column) -> Column:
    """The inverse normal distribution at ``p`` in (0, 1), right to about nine digits."""

    def poly(coefficients, x: Column) -> Column:
        value = F.lit(0.0)
        for c in coefficients:
            value = value * x + c
        return value

    q = p - 0.5
    near = q * poly(PROBIT_NEAR[0], q * q) / poly(PROBIT_NEAR[1], q * q)
    tail = lambda x: poly(PROBIT_FAR[0], x) / poly(PROBIT_FAR[1], x)
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(near)


def quantile_transform(df: DataFrame, column: str, out: str, *, normal: bool = False, exact: bool = True, steps: int = 1000) -> DataFrame:
    """``df`` with the place of each value among all, 0 to 1 (ties share their middle), or the normal value of that place.

    Distinct values are counted and placed range by range, then joined: no task orders all rows. ``exact=False`` places
    values between the quantiles of a bounded sketch instead.
    """
    from tabulon.functions.stats import quantiles
    from tabulon.operators.clean import running_totals

    if exact:
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value_")).agg(F.count("*").alias("n_"))
        placed = running_totals(counts, ["value_"], {"upto_": "n_"})
        total = F.broadcast(placed.agg(F.max("upto_").alias("total_")))
        place = F.coalesce(F.try_divide(F.col("upto_") - (F.col("n_") + 1) / 2, F.col("total_") - 1), F.lit(0.5))
        ranked = df.join(placed.crossJoin(total).select("value_", place.alias(out)), F.col(column) == F.col("value_"), "left").drop("value_")
    else:
        edges = F.broadcast(df.agg(quantiles(F.col(column).cast("double"), [i / steps for i in range(steps + 1)], exact=False).alias("edges_")))
        below = (F.size(F.filter("edges_", lambda e: e <= F.col(column))) - 1).cast("double") / steps
        ranked = df.crossJoin(edges).withColumn(out, F.when(F.col(column).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), below)))).drop("edges_")
    return ranked.withColumn(out, probit(F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(out))))) if normal else ranked


def power_transform(df: DataFrame, column: str, out: str, *, method: str = "yeo-johnson", low: float = -3.0, high: float = 4.0, rounds: int = 4) -> DataFrame:
    """``df`` with the Yeo-Johnson (or, for positive values, ``box-cox``) transform of largest likelihood, standardised.

    The likelihood has one peak: each round scores 21 powers in one aggregate and goes on around the best one.
    """
    x = F.col(column).cast("double")

    def to(power: float) -> Column:
        up = F.ln(x + 1) if power == 0 else (F.pow(x + 1, F.lit(power)) - 1) / power
        down = -F.ln(1 - x) if power == 2 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
        if method == "box-cox":
            return F.when(x > 0, F.ln(x) if power == 0 else (F.pow(x, F.lit(power)) - 1) / power)
        return F.when(x >= 0, up).otherwise(down)

    jacobian = F.sum(F.when(x > 0, F.ln(x))) if method == "box-cox" else F.sum(F.sign(x) * F.ln(F.abs(x) + 1))
    best = 1.0
    for _ in range(rounds):
        grid = [round(low + (high - low) * i / 20, 9) for i in range(21)]
        row = df.agg(F.count(x).alias("n"), jacobian.alias("j"), *[F.var_pop(to(p)).alias(f"v{i}") for i, p in enumerate(grid)]).first()
        score = [-row["n"] / 2 * math.log(max(row[f"v{i}"] or 1e-300, 1e-300)) + (p - 1) * (row["j"] or 0.0) for i, p in enumerate(grid)]
        best = grid[max(range(21), key=score.__getitem__)]
        step = (high - low) / 20
        low, high = best - step, best + step
    return scale(df.withColumn(out, to(best)), [out])


# --- dates, text, selection --------------------------------------------------------------------------------------


def datetime_features(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the parts of a time, month and day on a circle, and weekend, month start and month end flags."""
    t = F.col(column)
    turn = lambda x, n: {"sin": F.sin(2 * math.pi * x / n), "cos": F.cos(2 * math.pi * x / n)}
    parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "weekday": F.weekday(t), "yearday": F.dayofyear(t), "quarter": F.quarter(t), "hour": F.hour(t)}
    flags = {"weekend": (F.weekday(t) >= 5).cast("int"), "month_start": (F.dayofmonth(t) == 1).cast("int"), "month_end": (F.last_day(t) == F.to_date(t)).cast("int")}
    circles = {f"month_{k}": v for k, v in turn(F.month(t), 12).items()} | {f"day_{k}": v for k, v in turn(F.dayofmonth(t), 31).items()}
    return df.withColumns({f"{column}_{n}": e for n, e in (parts | flags | circles).items()})


def f_scores(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``column_name, f``: analysis of variance of each column between the classes of ``label``, from grouped sums.

    Values are taken from the column's mean first, as squares of values far from 0 lose the digits that matter.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(f"`{label}`").alias("label_"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    means = F.broadcast(rows.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(columns))]))
    x = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(len(columns))]
    grouped = rows.crossJoin(means).groupBy("label_").agg(*[e for i, v in enumerate(x) for e in (F.count(v).alias(f"n{i}"), F.sum(v).alias(f"s{i}"), F.sum(v * v).alias(f"q{i}"))])
    row = grouped.agg(F.count("*").alias("k"), *[e for i in range(len(columns)) for e in (F.sum(f"n{i}").alias(f"n{i}"), F.sum(f"s{i}").alias(f"s{i}"), F.sum(f"q{i}").alias(f"q{i}"), F.sum(F.try_divide(F.col(f"s{i}") * F.col(f"s{i}"), F.col(f"n{i}"))).alias(f"g{i}"))])

    def f(i: int) -> Column:
        between = F.col(f"g{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col(f"n{i}")
        within = F.col(f"q{i}") - F.col(f"g{i}")
        return F.try_divide(between / (F.col("k") - 1), within / (F.col(f"n{i}") - F.col("k")))

    return spread_rows(row, {c: [("f", f(i))] for i, c in enumerate(columns)})


def f_regression(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``column_name, f``: r² / (1 - r²) · (n - 2) of each column with a numeric target, in one aggregate."""
    y = F.col(target).cast("double")
    row = df.agg(*[e for i, c in enumerate(columns) for e in (correlation(F.col(f"`{c}`").cast("double"), y).alias(f"r{i}"), F.count_if(F.col(f"`{c}`").isNotNull() & y.isNotNull()).alias(f"n{i}"))])
    square = lambda i: F.col(f"r{i}") * F.col(f"r{i}")
    return spread_rows(row, {c: [("f", F.try_divide(square(i) * (F.col(f"n{i}") - 2), 1 - square(i)))] for i, c in enumerate(columns)})


def eliminate(df: DataFrame, columns: list[str], importances, *, keep: int = 10, step: float = 0.2) -> list[str]:
    """The ``keep`` columns left by recursive elimination: ``importances(columns)`` (column, importance) of a model fitted on
    the remaining columns decides which ``step`` of them goes next."""
    left = list(columns)
    while len(left) > keep:
        ranked = sorted(importances(left), key=lambda x: (-x[1], x[0]))
        go = min(len(left) - keep, max(1, int(step * len(left))))
        gone = {c for c, _ in ranked[len(ranked) - go :]}
        left = [c for c in left if c not in gone]
    return left


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """``column_name, mutual_information`` (nats) of each column, in equal-width bins, with ``label``."""
    limits = F.broadcast(df.agg(*[e for i, c in enumerate(columns) for e in (F.min(f"`{c}`").cast("double").alias(f"lo{i}"), F.max(f"`{c}`").cast("double").alias(f"hi{i}"))]))
    at = lambda i, c: F.coalesce(F.least(F.floor(F.try_divide((F.col(f"`{c}`") - F.col(f"lo{i}")) * bins, F.col(f"hi{i}") - F.col(f"lo{i}"))), F.lit(bins - 1)), F.lit(0))
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), at(i, c).alias("bin")) for i, c in enumerate(columns)])
    counts = df.where(F.col(label).isNotNull()).crossJoin(limits).select(F.col(label).alias("label"), F.explode(pairs).alias("p")).groupBy("p.column_name", "p.bin", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column_name")
    total, by_bin, by_label = F.sum("n").over(w), F.sum("n").over(Window.partitionBy("column_name", "bin")), F.sum("n").over(Window.partitionBy("column_name", "label"))
    return counts.withColumn("mi_", F.col("n") / total * F.ln(F.col("n") * total / (by_bin * by_label))).groupBy("column_name").agg(F.sum("mi_").alias("mutual_information"))


def select_best(scores: DataFrame, score: str, share: float = 0.8, most: int = 50) -> list[str]:
    """Names of the best ``share`` of the columns, ``most`` at most, from a table of a row for each column."""
    rows = sorted(((r[score] or 0.0, r["column_name"]) for r in scores.collect()), key=lambda x: (-x[0], x[1]))
    return [name for _, name in rows[: min(most, max(1, int(share * len(rows))))]]


def transformed_metrics(df: DataFrame, high: float = 0.9) -> DataFrame:
    """One row about a table made for models: rows, columns by kind, missing values, pairs correlated above ``high`` and the mean
    absolute correlation.

    The mean is over the full matrix with a zero diagonal; constant columns, whose correlations are undefined, are passed
    over in it. A table of fewer than two numeric columns has no pairs and a null mean.
    """
    from tabulon.operators.profile import correlation_pairs

    df = null_out_nan(df)
    numbers, width = numeric_columns(df), len(df.columns)
    kinds = sorted((len(numbers), width - len(numbers)))
    missing = [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]
    row = df.agg(F.count("*").alias("n_rows"), F.array(*missing).alias("m"))
    total = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x)
    row = row.select("n_rows", F.lit(width).alias("n_columns"), F.size(F.filter("m", lambda x: x > 0)).alias("columns_with_missing"), total.alias("missing_values"), F.coalesce(F.try_divide(total, F.col("n_rows") * width), F.lit(0.0)).alias("missing_ratio"), F.lit(len(numbers)).alias("numeric_columns"), F.lit(width - len(numbers)).alias("other_columns"), F.lit(kinds[0] / max(kinds[1], 1)).alias("kind_diversity"))
    if len(numbers) < 2:
        return row.withColumns({"high_pairs": F.lit(0).cast("long"), "mean_correlation": F.lit(None).cast("double")})
    strength = F.abs("correlation")
    # each pair stands twice in the matrix, and the diagonal of known columns counts as zero
    known = (1 + F.sqrt(1 + 8 * F.count("correlation"))) / 2
    pairs = correlation_pairs(df, numbers).agg(F.count_if(strength > high).alias("high_pairs"), F.try_divide(2 * F.sum(strength), F.when(F.count("correlation") > 0, known * known)).alias("mean_correlation"))
    return row.crossJoin(F.broadcast(pairs))


def discriminant(df: DataFrame, columns: list[str], label: str, k: int = 1) -> DataFrame:
    """``axis, column_name, weight, share``: the ``k`` linear discriminants of numeric columns for the classes of ``label``.

    Class sizes, means and products come from one grouped aggregate; the driver solves a problem of the size of the columns.
    An axis has unit variance within the classes and a positive weight of largest size; ``share`` is its part of the
    variance between the classes. Rows with a missing value or label are left out; at most classes - 1 axes exist.
    """
    import numpy as np

    x = [F.col(f"`{c}`").cast("double") for c in columns]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    rows = null_out_nan(df.select(F.col(f"`{label}`").alias("y"), *[v.alias(f"x{i}") for i, v in enumerate(x)])).na.drop()
    centre = [float(v or 0.0) for v in rows.agg(*[F.avg(f"x{i}") for i in range(len(columns))]).first()]  # products of values far from 0 lose digits
    z = [F.col(f"x{i}") - centre[i] for i in range(len(columns))]
    sums = rows.groupBy("y").agg(F.count("*").alias("n"), F.array(*[F.avg(v) for v in z]).alias("m"), F.array(*[F.sum(z[i] * z[j]) for i, j in pairs]).alias("p")).orderBy("y").collect()  # a row for each class
    spark, schema = df.sparkSession, "axis int, column_name string, weight double, share double"
    if len(sums) < 2:
        return spark.createDataFrame([], schema)
    n, means, products = np.array([r["n"] for r in sums], float), np.array([r["m"] for r in sums]), np.zeros((len(columns),) * 2)
    for (i, j), v in zip(pairs, np.sum([r["p"] for r in sums], axis=0), strict=True):
        products[i, j] = products[j, i] = v
    between = (means.T * n) @ means
    within = (products - between) / max(n.sum() - len(n), 1.0)
    size, turn = np.linalg.eigh(within)
    live = size > size.max() * 1e-10
    white = turn[:, live] / np.sqrt(size[live])
    power, axes = np.linalg.eigh(white.T @ (between / max(len(n) - 1, 1)) @ white)
    out = []
    for rank, i in enumerate(np.argsort(-power)[: min(k, len(sums) - 1, int(live.sum()))]):
        w = white @ axes[:, i]
        w = w * np.sign(w[np.argmax(np.abs(w))])
        out += [(rank + 1, c, float(v), float(power[i] / power.sum())) for c, v in zip(columns, w, strict=True)]
    return spark.createDataFrame(out, schema)


def discriminated(df: DataFrame, axes: DataFrame) -> DataFrame:
    """``df`` with ``axis_1``, … : its rows on the axes of :func:`discriminant`, which may come from another table."""
    rows = axes.collect()  # a row for each axis and column
    every = sorted({r["axis"] for r in rows})
    total = lambda a: sum((F.col(f"`{r['column_name']}`") * F.lit(r["weight"]) for r in rows if r["axis"] == a), F.lit(0.0))
    return df.withColumns({f"axis_{a}": total(a) for a in every}) if every else df


def expansion_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row ``before, after, ratio, complexity`` of the numbers of columns."""
    ratio = len(after.columns) / max(1, len(before.columns))
    label = "low" if ratio < 2 else "medium" if ratio < 5 else "high"
    return after.sparkSession.sql(f"SELECT {len(before.columns)} AS before, {len(after.columns)} AS after, {ratio}D AS ratio, '{label}' AS complexity")


# --- splits and folds --------------------------------------------------------------------------------------------


def _place(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of a key and a seed: the same on any cluster and in other databases."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def split(df: DataFrame, key: str, *, test: float = 0.2, validation: float = 0.0, seed: int = 42) -> DataFrame:
    """``df`` with ``part`` (train, validation, test) by the hash of ``key``; rows of one key stay together."""
    x = _place(F.col(key), seed)
    return df.withColumn("part", F.when(x < test, "test").when(x < test + validation, "validation").otherwise("train"))


def folds(df: DataFrame, key: str, k: int = 5, *, stratify: str | None = None, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` 0 to k - 1: by the hash of ``key``, or dealt in hash order within each class; classes lie in
    ranges together, so that a large one is no single task."""
    if stratify is None:
        return df.withColumn("fold", F.floor(_place(F.col(key), seed) * k).cast("int"))
    from tabulon.operators.clean import grouped_running_totals

    placed = df.withColumns({"place_": _place(F.col(key), seed), "one_": F.lit(1)})
    dealt = grouped_running_totals(placed, stratify, ["place_", key], {"upto_": "one_"})
    return dealt.withColumn("fold", F.pmod(F.col("upto_") - 1, F.lit(k)).cast("int")).drop("place_", "one_", "upto_", "upto__all")


def repeated_folds(df: DataFrame, key: str, k: int = 5, repeats: int = 3, *, seed: int = 42) -> DataFrame:
    """``df`` with ``fold_0``, ``fold_1`` …: independent dealings by the hash of ``key``; a group's rows stay together if
    ``key`` is the group."""
    return df.withColumns({f"fold_{i}": F.floor(_place(F.col(key), seed + i) * k).cast("int") for i in range(repeats)})


def time_folds(df: DataFrame, position: str, n: int, k: int = 5) -> DataFrame:
    """``df`` with ``fold``: 0 for what only trains, f for the f-th later stretch (expanding windows)."""
    return df.withColumn("fold", F.least(F.floor(F.col(position) * (k + 1) / F.lit(n)), F.lit(k)).cast("int"))
