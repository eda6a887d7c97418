"""Cleaning: dropping and filtering rows and columns, filling gaps, clipping outliers, joins and splits on keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.selection import quantile_arrays
from tabulon.functions.stats import datetime_columns, fences, null_out_nan, numeric_columns, string_columns
from tabulon.functions.storage import cut
from tabulon.operators.profile import column_types, correlation_pairs, distinct_counts, missing_summary

# --- dropping ----------------------------------------------------------------------------------------------------


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows with at least one value."""
    return df.na.drop("all")


def drop_incomplete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without nulls in ``columns`` (all by default), as for a null target."""
    return df.na.drop("any", subset=columns)


def _drop_where(df: DataFrame, facts: DataFrame, condition: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns whose row of facts holds ``condition``; reads one row for each column."""
    gone = [r["column_name"] for r in facts.where(condition).select("column_name").collect() if r["column_name"] not in keep]
    return df.drop(*gone)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return _drop_where(df, missing_summary(df), F.col("null_ratio") == 1)


def drop_sparse_columns(df: DataFrame, limit: float = 0.5, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without columns whose share of nulls is over ``limit``."""
    return _drop_where(df, missing_summary(df), F.col("null_ratio") > limit, keep)


def drop_constant_columns(df: DataFrame, *, only_if_few: bool = False) -> DataFrame:
    """``df`` without columns of one value at most (min = max); ``only_if_few``: only if under half of them are."""
    row = df.agg(*[F.coalesce(F.min(f"`{c}`") == F.max(f"`{c}`"), F.lit(True)).alias(c) for c in df.columns]).first()
    gone = [c for c in df.columns if row[c]]
    return df if only_if_few and 2 * len(gone) >= len(df.columns) else df.drop(*gone)


def drop_correlated_columns(df: DataFrame, limit: float = 0.95) -> DataFrame:
    """``df`` without numeric columns that correlate over ``limit`` with an earlier kept one."""
    columns = numeric_columns(df)
    high = {(r["column_a"], r["column_b"]) for r in correlation_pairs(df, columns).where(F.abs("correlation") > limit).collect()}
    kept: list[str] = []
    for c in columns:
        if not any((k, c) in high for k in kept):
            kept.append(c)
    return df.drop(*[c for c in columns if c not in kept])


def most_variable_columns(df: DataFrame, k: int = 20) -> list[str]:
    """The ``k`` numeric columns of largest variance; ties in column order."""
    columns = numeric_columns(df)
    row = df.agg(*[F.var_samp(f"`{c}`").alias(c) for c in columns]).first()
    return sorted(columns, key=lambda c: (-(row[c] or 0.0), columns.index(c)))[:k]


def clean_names(names: list[str]) -> list[str]:
    """Names of word characters joined by single underscores; blank ones become ``column_i``, repeats get ``_1`` and so on."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = re.sub(r"_+", "_", re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "_", name.strip()))).strip("_") or f"column_{i}"
        new, k = base, 0
        while new in out:
            k += 1
            new = f"{base}_{k}"
        out.append(new)
    return out


# --- filters and clips -------------------------------------------------------------------------------------------


def valid_text(text: Column) -> Column:
    """Trimmed length 10 to 10,000 and at least 0.3 letters."""
    t = F.trim(text)
    return F.char_length(t).between(10, 10_000) & (F.char_length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 0.3 * F.char_length(t))


def active(df: DataFrame, user: str, item: str, least_user: int = 5, least_item: int = 5) -> DataFrame:
    """Interactions of users and items that have enough of them, counted once on the input."""
    users = df.groupBy(user).agg(F.count("*").alias("n_")).where(F.col("n_") >= least_user).select(user)
    items = df.groupBy(item).agg(F.count("*").alias("n_")).where(F.col("n_") >= least_item).select(item)
    return df.join(users, user, "left_semi").join(items, item, "left_semi")


def sanitise(value: Column, kind: str = "string", max_length: int = 1000) -> Column:
    """Text without ``< > " '``, trimmed and cut to ``max_length``; other kinds by a cast that gives null on failure."""
    if kind != "string":
        return F.trim(value).try_cast({"integer": "bigint", "float": "double", "boolean": "boolean"}[kind])
    return F.trim(F.substring(F.regexp_replace(value, "[<>\"']", ""), 1, max_length))


def _limits(df: DataFrame, columns: list[str], method: str, *, exact: bool, low: float = 0.05, high: float = 0.95, limit: float = 3.0) -> DataFrame:
    """One row with a lower and an upper limit for each column."""
    out = []
    points = {"iqr": [0.25, 0.75], "zscore": []}.get(method, [low, high])
    found = quantile_arrays(df, [F.col(f"`{c}`") for c in columns], points, exact=exact) if points else []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        if method == "iqr":
            q = found[i]
            a, b = fences(q[0], q[1], F.count(x))
        elif method == "zscore":
            a, b = F.avg(x) - limit * F.stddev_pop(x), F.avg(x) + limit * F.stddev_pop(x)
        else:
            a, b = found[i][0], found[i][1]
        out += [a.alias(f"low_{i}"), b.alias(f"high_{i}")]
    return df.agg(*out)


def clip(df: DataFrame, columns: list[str] | None = None, *, method: str = "iqr", fit_on: DataFrame | None = None, exact: bool = True, **options) -> DataFrame:
    """``df`` with numeric columns clipped to Tukey fences (``iqr``) or quantiles (``quantile``) learned on ``fit_on``."""
    columns = columns or numeric_columns(df)
    limits = F.broadcast(_limits(null_out_nan(fit_on if fit_on is not None else df), columns, method, exact=exact, **options))
    clipped = {c: F.when(F.col(f"`{c}`").isNotNull(), F.least(F.greatest(F.col(f"`{c}`").cast("double"), F.col(f"low_{i}")), F.col(f"high_{i}"))) for i, c in enumerate(columns)}
    return df.crossJoin(limits).withColumns(clipped).select(*df.columns)


def outlier_flags(df: DataFrame, columns: list[str] | None = None, *, method: str = "iqr", exact: bool = True, **options) -> DataFrame:
    """``df`` with a flag ``outlier_<column>`` for each column and ``outlier_any``; nulls are no outliers."""
    columns = columns or numeric_columns(df)
    limits = F.broadcast(_limits(null_out_nan(df), columns, method, exact=exact, **options))
    flag = {f"outlier_{c}": F.coalesce((F.col(f"`{c}`") < F.col(f"low_{i}")) | (F.col(f"`{c}`") > F.col(f"high_{i}")), F.lit(False)) for i, c in enumerate(columns)}
    flagged = df.crossJoin(limits).withColumns(flag)
    every = F.array_contains(F.array(*[F.col(f) for f in flag]), True)
    return flagged.withColumn("outlier_any", every).select(*df.columns, *flag, "outlier_any")


def drop_outliers(df: DataFrame, columns: list[str] | None = None, *, method: str = "iqr", **options) -> DataFrame:
    """Rows without an outlier in any of ``columns``."""
    return outlier_flags(df, columns, method=method, **options).where(~F.col("outlier_any")).select(*df.columns)


def outlier_report(df: DataFrame, key: str, columns: list[str] | None = None, *, method: str = "iqr", k: int = 100) -> DataFrame:
    """``column_name, outlier_count, keys``: how many rows are outliers and their first ``k`` keys."""
    columns = columns or numeric_columns(df)
    flagged = outlier_flags(df, columns, method=method).select(F.col(f"`{key}`").alias("key"), F.explode(F.array(*[F.when(F.col(f"outlier_{c}"), F.lit(c)) for c in columns])).alias("column_name")).where("column_name IS NOT NULL")
    w = Window.partitionBy("column_name").orderBy("key")
    first = flagged.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy("column_name").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return flagged.groupBy("column_name").agg(F.count("*").alias("outlier_count")).join(first, "column_name")


# --- filling -----------------------------------------------------------------------------------------------------


def fill_values(df: DataFrame, columns: dict[str, str] | None = None, *, constant=None, exact: bool = True) -> DataFrame:
    """``df`` with nulls filled by ``mean``, ``median``, ``mode``, ``last`` or ``constant``, chosen by column.

    By default numbers get the median, times the latest value, the rest the most frequent value or ``Unknown``. One pass
    for the statistics, which stay in the plan as one broadcast row.
    """
    df = null_out_nan(df)
    if columns is None:
        numbers, dates = numeric_columns(df), datetime_columns(df)
        columns = {c: "median" if c in numbers else "last" if c in dates else "mode" for c in df.columns}
    kinds = dict(df.dtypes)
    stats = []
    middle = [c for c, how in columns.items() if how == "median"]
    medians = dict(zip(middle, quantile_arrays(df, [F.col(f"`{c}`") for c in middle], [0.5], exact=exact), strict=True))
    for i, (c, how) in enumerate(columns.items()):
        x = F.col(f"`{c}`")
        value = {"mean": lambda x=x: F.avg(x), "median": lambda c=c: medians[c][0], "mode": lambda x=x: F.mode(x, True), "last": lambda x=x: F.max(x), "constant": lambda: F.first(F.lit(constant))}[how]()
        if how == "mode" and kinds[c] == "string":
            value = F.coalesce(value, F.lit("Unknown"))
        stats.append(value.alias(f"fill_{i}"))
    keep = lambda c, i, how: F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"fill_{i}").cast("double")) if how in ("mean", "median") else F.coalesce(F.col(f"`{c}`"), F.col(f"fill_{i}"))
    return df.crossJoin(F.broadcast(df.agg(*stats))).withColumns({c: keep(c, i, how) for i, (c, how) in enumerate(columns.items())}).select(*df.columns)


def fill_strategies(df: DataFrame) -> DataFrame:
    """``column_name, null_ratio, strategy``: over half null drops rows, skewed numbers get the median, other numbers the
    mean, times are interpolated, the rest gets the mode."""
    from tabulon.functions.stats import sample_skewness, spread_rows

    df = null_out_nan(df)
    numbers, dates = numeric_columns(df), datetime_columns(df)
    row = df.agg(F.count("*").alias("n_"), *[e for i, c in enumerate(df.columns) for e in (F.count(f"`{c}`").alias(f"c{i}"), (F.abs(sample_skewness(F.col(f"`{c}`").cast("double"))) if c in numbers else F.lit(None).cast("double")).alias(f"s{i}"))])
    kind = lambda c: "number" if c in numbers else "time" if c in dates else "other"
    ratio = lambda i: F.coalesce(1 - F.try_divide(F.col(f"c{i}"), F.col("n_")), F.lit(0.0))
    facts = spread_rows(row, {c: [("null_ratio", ratio(i)), ("skew", F.col(f"s{i}")), ("kind", F.lit(kind(c)))] for i, c in enumerate(df.columns)})
    how = F.when(F.col("null_ratio") == 0, "none").when(F.col("null_ratio") > 0.5, "drop_rows").when(F.col("kind") == "number", F.when(F.col("skew") > 1, "median").otherwise("mean")).when(F.col("kind") == "time", "interpolate").otherwise("mode")
    return facts.select("column_name", "null_ratio", how.alias("strategy"))


def carried(df: DataFrame, column: str, order_by: list[str], partition_by: list[str], *, how: str = "forward") -> DataFrame:
    """``df`` with gaps of ``column`` filled from the row before (``forward``) or after (``backward``) within each key."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    forward = F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(column, forward if how == "forward" else backward)


def interpolated(df: DataFrame, column: str, order_by: str, partition_by: list[str], *, by: str = "position", tie: str | None = None) -> DataFrame:
    """``df`` with gaps of ``column`` filled on the line between their neighbours, by row position or by time.

    Leading gaps stay null; trailing ones carry the last value.
    """
    w = Window.partitionBy(*partition_by).orderBy(order_by, *([tie] if tie else []))
    at = F.col(order_by).cast("double") if by == "time" else F.row_number().over(w).cast("double")
    placed = df.withColumn("at_", at).withColumn("known_", F.when(F.col(column).isNotNull(), F.struct(F.col("at_").alias("at"), F.col(column).cast("double").alias("v"))))
    before = F.last("known_", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("known_", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = placed.withColumns({"before_": before, "after_": after})
    slope = F.try_divide(F.col("after_.v") - F.col("before_.v"), F.col("after_.at") - F.col("before_.at"))
    line = F.col("before_.v") + F.coalesce(slope, F.lit(0.0)) * (F.col("at_") - F.col("before_.at"))
    return near.withColumn(column, F.coalesce(F.col(column).cast("double"), line)).select(*df.columns)


def iterative_impute(df: DataFrame, columns: list[str] | None = None, *, rounds: int = 3, ridge: float = 1e-6) -> DataFrame:
    """``df`` with nulls of numeric columns predicted from the others by linear regression, in rounds.

    Starts at the means. Each step aggregates the normal equations in one pass (a matrix of the columns' number squared)
    and solves them on the driver; the table is cut from its lineage after each round.
    """
    import numpy as np

    columns = columns or numeric_columns(df)
    holes = [F.col(f"`{c}`").isNull().alias(f"hole_{i}") for i, c in enumerate(columns)]
    now = fill_values(df.select("*", *holes), dict.fromkeys(columns, "mean"))
    means = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]).first()
    for _ in range(rounds):
        for i, c in enumerate(columns):
            if not means[c]:
                continue
            xs = [F.lit(1.0), *[F.col(f"`{o}`").cast("double") for o in columns if o != c]]
            pairs = [(a, b) for a in range(len(xs)) for b in range(a, len(xs))]
            row = now.where(~F.col(f"hole_{i}")).agg(*[F.sum(xs[a] * xs[b]).alias(f"x{a}_{b}") for a, b in pairs], *[F.sum(x * F.col(f"`{c}`")).alias(f"y{a}") for a, x in enumerate(xs)]).first()
            m = np.array([[row[f"x{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(len(xs))] for a in range(len(xs))])
            beta = np.linalg.lstsq(m + ridge * np.eye(len(xs)), np.array([row[f"y{a}"] or 0.0 for a in range(len(xs))]), rcond=None)[0]
            guess = sum((F.lit(float(b)) * x for b, x in zip(beta, xs, strict=True)), F.lit(0.0))
            now = now.withColumn(c, F.when(F.col(f"hole_{i}"), guess).otherwise(F.col(f"`{c}`")))
        now = cut(now)
    return now.select(*df.columns)


# --- types, de-duplication and the whole job ---------------------------------------------------------------------


def convert_types(df: DataFrame, *, number_share: float = 0.8, date_share: float = 0.7) -> DataFrame:
    """``df`` with text columns turned into numbers or times where enough values parse; the rest become null.

    Times are read by the one format that parses most values; the first of equally good formats wins.
    """
    from tabulon.operators.profile import DATE_FORMATS, parsed_datetime

    texts = string_columns(df)
    if not texts:
        return df
    row = df.agg(*[e for i, c in enumerate(texts) for e in (F.count(f"`{c}`").alias(f"n{i}"), F.count_if(F.col(f"`{c}`").try_cast("double").isNotNull()).alias(f"f{i}"), *[F.count_if(parsed_datetime(F.col(f"`{c}`"), f).isNotNull()).alias(f"d{i}_{j}") for j, f in enumerate(DATE_FORMATS)])]).first()
    new = {}
    for i, c in enumerate(texts):
        n = row[f"n{i}"]
        best = max(range(len(DATE_FORMATS)), key=lambda j: row[f"d{i}_{j}"])  # noqa: B023
        if n and row[f"f{i}"] > number_share * n:
            new[c] = F.col(f"`{c}`").try_cast("double")
        elif n and row[f"d{i}_{best}"] > date_share * n:
            new[c] = parsed_datetime(F.col(f"`{c}`"), DATE_FORMATS[best])
    return df.withColumns(new) if new else df


def keep_first(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("i_", F.row_number().over(w)).where("i_ = 1").drop("i_")


def preprocess(df: DataFrame, *, sparse: float = 0.8) -> tuple[DataFrame, list[str]]:
    """The whole cleaning job and its log: sparse columns go, gaps are filled, duplicates go, types convert, numbers clip."""
    log, before = [], df.columns
    df = drop_sparse_columns(drop_empty_rows(df), sparse)
    log.append(f"dropped {len(before) - len(df.columns)} sparse columns")
    df = fill_values(df).dropDuplicates()
    log += ["filled gaps", "dropped duplicate rows"]
    df = convert_types(df)
    log.append("converted types")
    ids = {r["column_name"] for r in column_types(df).where("logical_type = 'id'").collect()}
    numbers = [c for c in numeric_columns(df) if c not in ids]
    if numbers:
        df = clip(df, numbers)
        log.append(f"clipped {len(numbers)} columns")
    return df, log


# --- joins, order and sets ---------------------------------------------------------------------------------------


def with_context(df: DataFrame, context: DataFrame, keys: list[str], fill: str = "unknown") -> DataFrame:
    """``df`` left-joined with context columns; missing text is ``fill``."""
    names = [c for c in context.columns if c not in keys]
    texts = set(string_columns(context))
    return df.join(context, keys, "left").withColumns({c: F.coalesce(c, F.lit(fill)) for c in names if c in texts})


def lookup(df: DataFrame, column: str, values: DataFrame, *, key: str, value: str, otherwise, out: str) -> DataFrame:
    """``df`` with ``out``: the value of ``column`` in a key-value table, or ``otherwise``."""
    table = values.select(F.col(key).alias("key_"), F.col(value).alias(out))
    return df.join(table, F.col(f"`{column}`") == F.col("key_"), "left").withColumn(out, F.coalesce(out, F.lit(otherwise))).drop("key_")


def unseen(candidates: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates without a row of the same keys in ``seen``."""
    return candidates.join(seen.select(*keys), keys, "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], *, ttl_seconds: int | None = None) -> DataFrame:
    """``left`` with the latest ``values`` of ``right`` at or before its time, within the time to live: one shuffle.

    Both sides are united and sorted by key and time; at equal times features come first. No range join.
    """
    payload = F.struct(F.col(ts).alias("at"), *values)
    a = left.select(F.col(key).alias("key_"), F.col(ts).alias("ts_"), F.lit(1).alias("side_"), F.struct(*left.columns).alias("row_"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("feature_"))
    b = right.select(F.col(key).alias("key_"), F.col(ts).alias("ts_"), F.lit(0).alias("side_"), F.lit(None).cast(a.schema["row_"].dataType).alias("row_"), payload.alias("feature_"))
    w = Window.partitionBy("key_").orderBy("ts_", "side_", F.struct(*[F.col(f"feature_.{v}") for v in values])).rowsBetween(Window.unboundedPreceding, 0)
    joined = a.unionByName(b).withColumn("latest_", F.last("feature_", True).over(w)).where("side_ = 1")
    fresh = F.lit(True) if ttl_seconds is None else F.unix_timestamp("ts_") - F.unix_timestamp("latest_.at") <= ttl_seconds
    return joined.select("row_.*", *[F.when(fresh, F.col(f"latest_.{v}")).alias(v) for v in values])


def chronological_split(df: DataFrame, order_by: list[str], test: float = 0.2) -> DataFrame:
    """``df`` with ``part``: the first rows in time are train, the last ``test`` share is test.

    Rows are placed by an exact range: a global sort gives each partition its offset, so no single task numbers all.
    """
    n = df.count()
    placed = positions(df, order_by)
    return placed.withColumn("part", F.when(F.col("position") < F.floor(F.lit(n * (1 - test))), "train").otherwise("test"))


def in_ranges(df: DataFrame, order_by: list) -> DataFrame:
    """``df`` sorted over ranges, with the number of its range; written once, since another run may cut ranges elsewhere."""
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return cut(ordered.withColumns({"range_": F.spark_partition_id(), "in_range_": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))


def _offsets(sizes: DataFrame, name: str) -> Column:
    """For the column ``range_``: the sum of ``name`` over the ranges before; one number for each range on the driver."""
    total, start = 0, {}
    for r in sorted(sizes.collect(), key=lambda r: r["range_"]):
        start[r["range_"]] = total
        total += r[name]
    if not start:
        return F.lit(0)
    return F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("range_"))


def positions(df: DataFrame, order_by: list) -> DataFrame:
    """``df`` with ``position``, 0 to n - 1 in a total order, without a window over all rows in one task."""
    ordered = in_ranges(df, order_by)
    offset = _offsets(ordered.groupBy("range_").agg(F.count("*").alias("n_")), "n_")
    return ordered.withColumn("position", (F.col("in_range_") + offset).cast("long")).drop("range_", "in_range_")


def running_totals(df: DataFrame, order_by: list, sums: dict[str, str]) -> DataFrame:
    """``df`` with, by new name, the sum of a column up to and with each row in the given total order, range by range."""
    ordered = in_ranges(df, order_by)
    sizes = ordered.groupBy("range_").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.partitionBy("range_").orderBy("in_range_").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumns({n: F.sum(c).over(w) + _offsets(sizes, n) for n, c in sums.items()}).drop("range_", "in_range_")


def grouped_running_totals(df: DataFrame, key: str, order_by: list, sums: dict[str, str]) -> DataFrame:
    """``df`` with, by new name, the sum of a column over the rows of the same ``key`` up to and with each in the given order,
    and ``<name>_all`` over all rows of the key.

    All keys lie in ranges together, so that no key is one task; the driver gets a row for each range and key that meet.
    """
    ordered = in_ranges(df, [key, *order_by])
    met = ordered.groupBy("range_", key).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).collect()
    totals: dict = {}
    rows = []
    for m in sorted(met, key=lambda m: m["range_"]):
        so_far = totals.setdefault(m[key], dict.fromkeys(sums, 0))
        rows.append((m["range_"], m[key], dict(so_far)))
        for n in sums:
            so_far[n] += m[n] or 0
    kinds = {f.name: f.dataType.simpleString() for f in ordered.groupBy().agg(*[F.sum(c).alias(n) for n, c in sums.items()]).schema}
    schema = f"range_ int, `{key}` {dict(df.dtypes)[key]}, " + ", ".join(f"{n}_before {kinds[n]}, {n}_all {kinds[n]}" for n in sums)
    places = df.sparkSession.createDataFrame([(r, k, *[v for n in sums for v in (so_far[n], totals[k][n])]) for r, k, so_far in rows], schema)
    w = Window.partitionBy("range_", key).orderBy("in_range_").rowsBetween(Window.unboundedPreceding, 0)
    places = places.withColumnsRenamed({"range_": "place_range_", key: "place_key_"})
    found = ordered.join(F.broadcast(places), (F.col("range_") == F.col("place_range_")) & F.col(f"`{key}`").eqNullSafe(F.col("place_key_")))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], *[e for n, c in sums.items() for e in ((F.sum(c).over(w) + F.col(f"{n}_before")).alias(n), F.col(f"{n}_all"))])


def append_columns(left: DataFrame, left_order: list, right: DataFrame, right_order: list) -> DataFrame:
    """Columns of two tables side by side, row by row in the given total orders; the longer table's rest meets nulls.

    Columns of the right one whose names the left one has get the suffix ``_right``.
    """
    names = {c: f"{c}_right" if c in left.columns else c for c in right.columns}
    placed = positions(right, right_order).select("position", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return positions(left, left_order).join(placed, "position", "full").drop("position")


def sample_by_key(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """A sample that depends on the key alone: rows whose md5 of key and seed begins low enough."""
    head = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return df.where(head < int(share * (1 << 32)))


def distinct_ratio(df: DataFrame) -> DataFrame:
    """``column_name, unique_count`` for every column, exact."""
    return distinct_counts(df)
