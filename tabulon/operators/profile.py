"""Profiles of tables and columns: one numeric aggregate, one value-count shuffle, no collecting.

Percentiles and distinct counts are exact by default; ``exact=False`` uses bounded sketches over all rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.selection import quantile_arrays
from tabulon.functions.stats import correlation, datetime_columns, fences, null_out_nan, numeric_columns, sample_kurtosis, sample_skewness, spread_rows, string_columns

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no", "t", "f")
#: Date formats that the loader knows, tried in this order (fixed values, but for the compact last one).
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "MM-dd-yyyy", "MM-dd-yyyy HH:mm:ss",
    "dd/MM/yyyy", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy", "dd-MM-yyyy HH:mm:ss", "dd.MM.yyyy", "dd.MM.yyyy HH:mm:ss",
    "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy",
    "yyyyMMdd",
)
#: What each part of a format looks like in a value.
_SHAPES = {"yyyy": "[0-9]{4}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "d": "[0-9]{1,2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", "SSSSSS": "[0-9]{1,6}", "XXX": "(?:Z|[+-][0-9]{2}:[0-9]{2})", "'T'": "T", "'Z'": "Z"}


def named_as_id(name: str, *, compat: bool = False) -> bool:
    """Whether a column's name marks an identifier: a word ``id``, ``key`` or ``index``; ``compat`` takes any substring."""
    if compat:
        return any(k in name.lower() for k in ("id", "key", "index"))
    words = re.findall(r"[a-z]+|[A-Z][a-z]*|[0-9]+", name)
    return any(w.lower() in ("id", "key", "index") or w.lower().endswith("key") for w in words)


def long_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df`` as ``(column_name, value)`` rows, values as text; nulls stay."""
    columns = columns or df.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name, value, n``: how often each non-null value occurs; aggregated before the shuffle."""
    return long_values(df, columns).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, *, exact: bool = True) -> DataFrame:
    """``column_name, unique_count``: distinct non-null values of each column."""
    columns = columns or df.columns
    if exact:
        counted = value_counts(df, columns).groupBy("column_name").agg(F.count("*").alias("unique_count"))
        every = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
        return every.join(counted, "column_name", "left").na.fill(0, ["unique_count"])
    row = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in columns])
    return spread_rows(row, {c: [("unique_count", F.col(f"`{c}`"))] for c in columns})


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each column with counts and shares; ties go to the smaller value."""
    from pyspark.sql import Window

    counts = value_counts(df, columns)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(totals), "column_name").select("column_name", "rank", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def missing_summary(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``column_name, null_count, null_ratio, concerning`` in one pass; NaN counts as missing."""
    df = null_out_nan(df)
    row = df.agg(F.count("*").alias("n_"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    ratio = lambda c: F.coalesce(F.try_divide(F.col(f"`{c}`"), F.col("n_")), F.lit(0.0))
    return spread_rows(row, {c: [("null_count", F.col(f"`{c}`")), ("null_ratio", ratio(c)), ("concerning", ratio(c) > threshold)] for c in df.columns})


def duplicate_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``n_rows, duplicate_count, duplicate_ratio``: rows equal to an earlier one; one row."""
    counts = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"))
    return total.withColumn("duplicate_ratio", F.coalesce(F.try_divide("duplicate_count", "n_rows"), F.lit(0.0)))


def numeric_summary(df: DataFrame, columns: list[str] | None = None, *, exact: bool = True) -> DataFrame:
    """Moments and quartiles of numeric columns in one aggregate: one row for each column.

    ``std`` has ddof 1; skewness and kurtosis are bias-corrected.
    """
    df = null_out_nan(df)
    columns = columns or numeric_columns(df)
    aggs, parts = [], {}
    quartiles = quantile_arrays(df, [F.col(f"`{c}`") for c in columns], [0.25, 0.5, 0.75], exact=exact)
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        named = {"n": F.count(x), "null_count": F.count_if(x.isNull()), "min_value": F.min(x).cast("double"), "max_value": F.max(x).cast("double"), "mean_value": F.avg(x).cast("double"), "std_value": F.stddev_samp(x), "skewness": sample_skewness(x.cast("double")), "kurtosis": sample_kurtosis(x.cast("double")), "q": quartiles[i]}
        aggs += [e.alias(f"{i}_{n}") for n, e in named.items()]
        held = lambda n, i=i: F.col(f"{i}_{n}")
        parts[c] = [*[(n, held(n)) for n in named if n != "q"], *[(n, held("q")[k]) for k, n in enumerate(("q1", "median", "q3"))]]
    return spread_rows(df.agg(*aggs), parts)


def outlier_counts(df: DataFrame, columns: list[str] | None = None, *, exact: bool = True, summary: DataFrame | None = None) -> DataFrame:
    """``column_name, lower, upper, outlier_count`` by Tukey fences (ten values and some spread needed): two passes.

    ``summary`` is a :func:`numeric_summary` of the same columns; its quartiles are used and its exchange is shared.
    """
    df = null_out_nan(df)
    columns = columns or numeric_columns(df)
    summary = summary if summary is not None else numeric_summary(df, columns, exact=exact)
    low, high = fences(F.col("q1"), F.col("q3"), F.col("n"))
    numbered = {c: str(i) for i, c in enumerate(columns)}
    named = F.create_map(*[F.lit(x) for kv in numbered.items() for x in kv])
    wide = summary.select(F.element_at(named, F.col("column_name")).alias("i"), low.alias("low"), high.alias("high"))
    limits = F.broadcast(wide.groupBy().pivot("i", list(numbered.values())).agg(F.first("low").alias("low"), F.first("high").alias("high")))  # one row
    inside = df.select(*[F.col(f"`{c}`") for c in columns]).crossJoin(limits)
    outside = [F.count_if((F.col(f"`{c}`") < F.col(f"{i}_low")) | (F.col(f"`{c}`") > F.col(f"{i}_high"))).alias(f"{i}_n") for c, i in numbered.items()]
    row = inside.agg(*outside, *[F.first(f"{i}_{e}").alias(f"{i}_{e}") for i in numbered.values() for e in ("low", "high")])
    return spread_rows(row, {c: [("lower", F.col(f"{i}_low")), ("upper", F.col(f"{i}_high")), ("outlier_count", F.col(f"{i}_n"))] for c, i in numbered.items()})


def zscore_outliers(df: DataFrame, columns: list[str] | None = None, limit: float = 3.0) -> DataFrame:
    """``column_name, outlier_count, outlier_ratio`` of values more than ``limit`` deviations (ddof 0) from the mean."""
    df = null_out_nan(df)
    columns = columns or numeric_columns(df)
    stats = df.agg(*[e for i, c in enumerate(columns) for e in (F.avg(f"`{c}`").alias(f"{i}_m"), F.stddev_pop(f"`{c}`").alias(f"{i}_s"))])
    both = df.select(*columns).crossJoin(F.broadcast(stats))
    row = both.agg(*[e for i, c in enumerate(columns) for e in (F.count_if(F.abs(F.col(f"`{c}`") - F.col(f"{i}_m")) > limit * F.col(f"{i}_s")).alias(f"{i}_n"), F.count(f"`{c}`").alias(f"{i}_c"))])
    return spread_rows(row, {c: [("outlier_count", F.col(f"{i}_n")), ("outlier_ratio", F.coalesce(F.try_divide(F.col(f"{i}_n"), F.col(f"{i}_c")), F.lit(0.0)))] for i, c in enumerate(columns)})


def parsed_datetime(x: Column, pattern: str) -> Column:
    """``x`` as a timestamp by one format, else null; a failing parse is costly, so only what has the format's shape is tried."""
    shape = re.sub("|".join([*_SHAPES, "."]), lambda m: _SHAPES.get(m[0]) or re.escape(m[0]), pattern)
    return F.when(x.rlike(f"^{shape}$"), F.try_to_timestamp(x, F.lit(pattern)))


def _parses_as_datetime(x: Column) -> Column:
    """Whether a known format parses ``x``."""
    looks = x.rlike(r"^(?:[0-9]{1,4}[-/.]?[0-9]{1,2}[-/.]?[0-9]{1,4}|[0-9]{1,2} [A-Za-z]|[A-Za-z]{3,9} [0-9]{1,2},)")
    return F.coalesce(looks & F.coalesce(*[parsed_datetime(x, f) for f in DATE_FORMATS]).isNotNull(), F.lit(False))


def column_types(df: DataFrame, *, compat: bool = False) -> DataFrame:
    """``column_name, logical_type``: numeric, id, categorical, datetime, boolean or text, judged on all rows.

    Digit strings are numeric before they can be dates. One count of values; each distinct text is parsed once.
    """
    kinds = dict(df.dtypes)
    texts, numbers, dates = string_columns(df), numeric_columns(df), datetime_columns(df)
    x, is_text = F.col("value"), F.col("column_name").isin(*texts) if texts else F.lit(False)
    weighed = lambda holds: F.sum(F.when(is_text & holds, F.col("n")).otherwise(0))
    judged = value_counts(df).groupBy("column_name").agg(
        F.count("*").alias("unique_count"), F.sum("n").alias("n"), weighed(x.rlike(EMAIL)).alias("email_"), weighed(x.try_cast("double").isNotNull()).alias("number_"), weighed(_parses_as_datetime(x)).alias("date_"),
        weighed(F.lower(F.trim(x)).isin(*BOOLEAN_WORDS)).alias("bool_"), F.sum(F.when(is_text, F.char_length(x) * F.col("n"))).alias("length_"),
    )
    kind = lambda c: "datetime" if c in dates else "boolean" if kinds[c] == "boolean" else "number" if c in numbers else "string" if c in texts else "other"
    every = df.sparkSession.createDataFrame([(c, kind(c), named_as_id(c, compat=compat)) for c in df.columns], "column_name string, kind string, named_id boolean")
    share = lambda c: F.when(F.col("kind") == "string", F.try_divide(F.col(c), F.col("n")).cast("double"))
    facts = every.join(judged, "column_name", "left").na.fill(0, ["unique_count", "n"]).crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows"))))
    facts = facts.withColumns({"email": share("email_"), "number": share("number_"), "date": share("date_"), "bool": share("bool_"), "length": share("length_")})
    unique = F.coalesce(F.try_divide("unique_count", "n_rows"), F.lit(0.0))
    decided = (
        F.when(F.col("n") == 0, "text").when(F.col("kind").isin("datetime", "boolean"), F.col("kind")).when(F.col("kind") == "other", "text")
        .when(F.col("kind") == "number", F.when(F.col("named_id") | (unique > 0.95), "id").otherwise("numeric"))
        .when(F.col("email") > 0.7, "text").when(F.col("number") > 0.85, "numeric").when(F.col("date") >= 0.8, "datetime").when(F.col("bool") > 0.8, "boolean")
        .when((unique < 0.1) | ((unique < 0.2) & (F.col("length") < 20)), "categorical").otherwise("text")
    )
    return facts.select("column_name", decided.alias("logical_type"), "unique_count", unique.alias("unique_ratio"))


def _texts_judged(df: DataFrame, texts: list[str]) -> DataFrame:
    """``column_name, known, unique_count, length, numbers, whole, dates`` of text columns, each distinct text parsed once.

    ``numbers`` and ``dates`` are rows that parse, ``whole`` says whether all the numbers are whole.
    """
    x, n = F.col("value"), F.col("n")
    number = x.try_cast("double")
    counted = value_counts(df.select(*[F.col(f"`{c}`") for c in texts]), texts)
    judged = counted.groupBy("column_name").agg(
        F.sum("n").alias("known"), F.count("*").alias("unique_count"), (F.sum(F.char_length(x) * n) / F.sum("n")).alias("length"), F.sum(F.when(number.isNotNull() & ~F.isnan(number), n).otherwise(0)).alias("numbers"),
        F.bool_and(F.when(number.isNotNull() & ~F.isnan(number), number == F.floor(number))).alias("whole"), F.sum(F.when(_parses_as_datetime(x), n).otherwise(0)).alias("dates"),
    )
    named = df.sparkSession.createDataFrame([(c,) for c in texts], "column_name string")
    return named.join(judged, "column_name", "left").na.fill(0, ["known", "unique_count", "numbers", "dates"]).crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows"))))


def simple_types(df: DataFrame) -> DataFrame:
    """``column_name, simple_type``: numeric, datetime or boolean by the column's type; texts are categorical if fewer than half
    of the rows are distinct or their mean length is below 50, else text."""
    texts, numbers, dates = string_columns(df), numeric_columns(df), datetime_columns(df)
    kind = lambda c: "numeric" if c in numbers else "datetime" if c in dates else "boolean" if dict(df.dtypes)[c] == "boolean" else "categorical"
    named = df.sparkSession.createDataFrame([(c, kind(c)) for c in df.columns if c not in texts], "column_name string, simple_type string")
    if not texts:
        return named
    few = F.coalesce(F.try_divide("unique_count", "n_rows"), F.lit(0.0)) < 0.5
    judged = _texts_judged(df, texts).select("column_name", F.when(few | (F.coalesce("length", F.lit(0.0)) < 50), "categorical").otherwise("text").alias("simple_type"))
    return named.unionByName(judged)


def text_column_types(df: DataFrame, *, categories: int = 50) -> DataFrame:
    """``column_name, inferred_type`` of text columns by all rows: ``object`` where over nine tenths are missing, ``datetime`` or a
    number (``integer``, ``float``) where over eight tenths of the rows parse, ``category`` with under a tenth distinct and
    fewer than ``categories`` values, else ``object``."""
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_rows")), F.lit(0.0))
    kind = (
        F.when((F.col("n_rows") == 0) | (share("known") < 0.1), "object").when(share("dates") > 0.8, "datetime")
        .when(share("numbers") > 0.8, F.when(F.col("whole"), "integer").otherwise("float"))
        .when((share("unique_count") < 0.1) & (F.col("unique_count") < categories), "category").otherwise("object")
    )
    texts = string_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column_name string, inferred_type string")
    return _texts_judged(df, texts).select("column_name", kind.alias("inferred_type"))


def feature_scores(df: DataFrame, target: str | None = None) -> DataFrame:
    """``column_name, missing_ratio, unique_ratio, target_correlation, score`` of every column but the target.

    The score is completeness, halved below a hundredth of distinct rows, times .7 above 99 hundredths, times one plus the
    size of the correlation with a numeric target, and at most 1.
    """
    columns = [c for c in df.columns if c != target]
    facts = missing_summary(df.select(*[F.col(f"`{c}`") for c in columns])).select("column_name", F.col("null_ratio").alias("missing_ratio"))
    facts = facts.join(distinct_counts(null_out_nan(df), columns), "column_name").crossJoin(F.broadcast(df.agg(F.count("*").alias("n_"))))
    facts = facts.withColumn("unique_ratio", F.coalesce(F.try_divide("unique_count", "n_"), F.lit(0.0)))
    numbers = [c for c in numeric_columns(df) if c in columns] if target in numeric_columns(df) else []
    if numbers:
        row = null_out_nan(df).agg(*[correlation(c, target).alias(f"r{i}") for i, c in enumerate(numbers)])
        facts = facts.join(spread_rows(row, {c: [("target_correlation", F.col(f"r{i}"))] for i, c in enumerate(numbers)}), "column_name", "left")
    else:
        facts = facts.withColumn("target_correlation", F.lit(None).cast("double"))
    u = F.col("unique_ratio")
    score = (1 - F.col("missing_ratio")) * F.when(u < 0.01, 0.5).when(u > 0.99, 0.7).otherwise(1.0) * (1 + F.abs(F.coalesce("target_correlation", F.lit(0.0))))
    return facts.select("column_name", "missing_ratio", "unique_ratio", "target_correlation", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def feature_types(df: DataFrame, target: str | None = None) -> DataFrame:
    """``column_name, feature_type``: numeric, ordinal, binary, categorical, text, datetime or target."""
    texts, numbers, dates = string_columns(df), numeric_columns(df), datetime_columns(df)
    row = df.agg(*[e.alias(f"{i}_{n}") for i, c in enumerate(df.columns) for n, e in (("length", F.avg(F.char_length(f"`{c}`")) if c in texts else F.lit(None).cast("double")), ("whole", F.bool_and(F.col(f"`{c}`") == F.floor(f"`{c}`")) if c in numbers else F.lit(False)))])
    kind = lambda c: "target" if c == target else "datetime" if c in dates else "text" if c in texts else "number" if c in numbers else "other"
    facts = spread_rows(row, {c: [("kind", F.lit(kind(c))), ("length", F.col(f"{i}_length")), ("whole", F.col(f"{i}_whole"))] for i, c in enumerate(df.columns)}).join(distinct_counts(df), "column_name")
    u = F.col("unique_count")
    decided = (
        F.when(F.col("kind").isin("target", "datetime"), F.col("kind")).when(u == 2, "binary")
        .when(F.col("kind") == "number", F.when(F.col("whole") & (u < 20), "ordinal").otherwise("numeric"))
        .when((F.col("kind") == "text") & (F.col("length") > 20), "text").otherwise("categorical")
    )
    return facts.select("column_name", decided.alias("feature_type"))


def date_format(df: DataFrame, column: str, formats: tuple[str, ...] = DATE_FORMATS, accept: float = 0.8) -> DataFrame:
    """One row ``format, ratio``: the format that parses most values of a text column; null below ``accept``."""
    x = F.col(f"`{column}`")
    row = df.agg(F.count(x).alias("n"), *[F.count_if(parsed_datetime(x, f).isNotNull()).alias(f"f{i}") for i, f in enumerate(formats)])
    # the first of equally good formats wins
    best = F.reduce(F.array(*[F.struct((F.col(f"f{i}") / F.col("n")).alias("ratio"), F.lit(-i).alias("order"), F.lit(f).alias("format")) for i, f in enumerate(formats)]), F.struct(F.lit(-1.0).alias("ratio"), F.lit(0).alias("order"), F.lit("").alias("format")), lambda a, b: F.greatest(a, b))
    return row.where("n > 0").select(best.alias("b")).select(F.when(F.col("b.ratio") >= accept, F.col("b.format")).alias("format"), F.col("b.ratio").alias("ratio"))


def narrowest_types(df: DataFrame) -> DataFrame:
    """``column_name, narrow_type``: the smallest integer type that holds a column, or float where no value changes."""
    whole = [f for f, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    floats = [f for f, t in df.dtypes if t == "double"]
    close = lambda x: F.bool_and(F.abs(x - x.cast("float")) <= 1e-8 + 1e-5 * F.abs(x))
    row = df.agg(*[e for i, c in enumerate(whole) for e in (F.min(f"`{c}`").alias(f"w{i}_lo"), F.max(f"`{c}`").alias(f"w{i}_hi"))], *[close(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(floats)])
    fits = lambda i, bits: (F.col(f"w{i}_lo") >= -(1 << bits - 1)) & (F.col(f"w{i}_hi") < 1 << bits - 1)
    parts = {c: [("narrow_type", F.when(fits(i, 8), "tinyint").when(fits(i, 16), "smallint").when(fits(i, 32), "int").otherwise("bigint"))] for i, c in enumerate(whole)}
    parts |= {c: [("narrow_type", F.when(F.col(f"f{i}"), "float").otherwise("double"))] for i, c in enumerate(floats)}
    return spread_rows(row, parts)


def mixed_types(df: DataFrame) -> DataFrame:
    """``column_name, n_classes, mixed``: how many of integer, decimal, date, boolean and text occur in a text column."""
    columns = string_columns(df)
    aggs = []
    for i, c in enumerate(columns):
        x = F.trim(f"`{c}`")
        whole, number, boolean = x.try_cast("bigint").isNotNull(), x.try_cast("double").isNotNull(), F.lower(x).isin("true", "false", "yes", "no")
        date = _parses_as_datetime(x)
        kind = F.when(whole, 0).when(number, 1).when(date, 2).when(boolean, 3).otherwise(4)
        aggs += [F.coalesce(F.max(F.when(x.isNotNull() & (kind == k), 1)), F.lit(0)).alias(f"{i}_{k}") for k in range(5)]
    total = lambda i: sum((F.col(f"{i}_{k}") for k in range(1, 5)), F.col(f"{i}_0"))
    return spread_rows(df.agg(*aggs), {c: [("n_classes", total(i)), ("mixed", total(i) > 2)] for i, c in enumerate(columns)})


def task_type(df: DataFrame, target: str, policy: str = "ratio") -> DataFrame:
    """One row ``task``: regression or classification for ``target``, by one of four policies.

    ``ratio``: numeric with over 10 % distinct; ``count_and_ratio``: over 20 and over 10 %; ``small``: classification for
    at most 20 values that are under 5 %; ``bounded``: classification under min(20, 10 % of the rows).
    """
    numeric = target in numeric_columns(df)
    row = df.agg(F.count_distinct(f"`{target}`").alias("u"), F.count("*").alias("n"))
    u, n = F.col("u"), F.col("n")
    regression = {"ratio": u > 0.1 * n, "count_and_ratio": (u > 20) & (u > 0.1 * n), "small": ~((u <= 20) & (u < 0.05 * n)), "bounded": ~(u < F.least(F.lit(20.0), 0.1 * n))}[policy]
    return row.select(F.when(F.lit(numeric) & regression, "regression").otherwise("classification").alias("task"), u.alias("unique_count"))


def column_profile(df: DataFrame, *, exact: bool = True) -> DataFrame:
    """One row for each column with counts, moments, fences' outliers, text lengths and the column's quality score.

    Numeric facts come for numeric and id columns, lengths for text and categorical ones. The score is completeness less
    a fifth of the outlier ratio and a tenth for each issue (over half missing, over a tenth outliers).
    """
    df = null_out_nan(df)
    numbers, texts = numeric_columns(df), string_columns(df)
    base = missing_summary(df).select("column_name", "null_count").crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows"))))
    profile = base.join(column_types(df).select("column_name", "logical_type", "unique_count"), "column_name")
    if numbers:
        summary = numeric_summary(df, numbers, exact=exact)
        numeric = summary.select("column_name", "min_value", "max_value", "mean_value", F.when(F.col("n") == 1, 0.0).otherwise(F.col("std_value")).alias("std_value"), "q1", "median", "q3")
        profile = profile.join(numeric.join(outlier_counts(df, numbers, summary=summary).select("column_name", "outlier_count"), "column_name"), "column_name", "left")
    else:
        profile = profile.withColumns({c: F.lit(None).cast("double") for c in ("min_value", "max_value", "mean_value", "std_value", "q1", "median", "q3")} | {"outlier_count": F.lit(None).cast("long")})
    if texts:
        row = df.agg(*[e for i, c in enumerate(texts) for e in (F.min(F.char_length(f"`{c}`")).alias(f"{i}_lo"), F.max(F.char_length(f"`{c}`")).alias(f"{i}_hi"), F.avg(F.char_length(f"`{c}`")).alias(f"{i}_avg"))])
        lengths = spread_rows(row, {c: [("min_length", F.col(f"{i}_lo")), ("max_length", F.col(f"{i}_hi")), ("avg_length", F.col(f"{i}_avg"))] for i, c in enumerate(texts)})
        profile = profile.join(lengths, "column_name", "left")
    else:
        profile = profile.withColumns({"min_length": F.lit(None).cast("int"), "max_length": F.lit(None).cast("int"), "avg_length": F.lit(None).cast("double")})
    outliers = F.coalesce("outlier_count", F.lit(0))
    issues = (F.col("null_count") > 0.5 * F.col("n_rows")).cast("int") + (outliers > 0.1 * F.col("n_rows")).cast("int")
    score = 1 - F.coalesce(F.try_divide(F.col("null_count") + 0.2 * outliers, F.col("n_rows")), F.lit(0.0)) - 0.1 * issues
    return profile.withColumn("outlier_count", outliers).withColumn("column_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_a, column_b, correlation`` for each pair, in one aggregate (pairwise complete Pearson; null beside a constant).

    The number of pairs grows with the square of the columns, not of the rows; up to about sixty columns fit one plan.
    """
    df = null_out_nan(df)
    columns = columns or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[correlation(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def target_correlation(df: DataFrame, target: str) -> DataFrame:
    """``column_name, correlation, t, n`` of each numeric column with ``target``, strongest first by the caller's order."""
    df = null_out_nan(df)
    columns = [c for c in numeric_columns(df) if c != target]
    y = F.col(f"`{target}`").cast("double")
    both = lambda c: F.when(F.col(f"`{c}`").isNotNull() & y.isNotNull(), F.col(f"`{c}`").cast("double"))
    row = df.agg(*[e for i, c in enumerate(columns) for e in (correlation(both(c), y).alias(f"{i}_r"), F.count(both(c)).alias(f"{i}_n"))])
    r, n = (lambda i: F.col(f"{i}_r")), (lambda i: F.col(f"{i}_n"))
    return spread_rows(row, {c: [("correlation", r(i)), ("t", F.try_divide(r(i) * F.sqrt(n(i) - 2.0), F.sqrt(1 - r(i) * r(i)))), ("n", n(i))] for i, c in enumerate(columns)})


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """``label, n, share, imbalance_ratio``: classes with their share; the ratio is that of the largest to the smallest."""
    from pyspark.sql import Window

    counts = df.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{label}`").alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select("label", "n", (F.col("n") / F.sum("n").over(every)).alias("share"), (F.max("n").over(every) / F.min("n").over(every)).alias("imbalance_ratio"))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """``measure, value`` of a numeric target: rows, nulls, distinct values, moments, quartiles and the share outside fences.

    For a target of classes see :func:`class_distribution`. NaN counts as missing; a target without values has counts only.
    """
    x = F.col(f"`{target}`").cast("double")
    rows = df.select(F.when(~F.isnan(x), x).alias("x"))
    q = quantile_arrays(rows, [F.col("x")], [0.25, 0.5, 0.75])[0]
    low, high = fences(q[0], q[2], F.count("x"))
    facts = rows.agg(low.alias("low"), high.alias("high")).first()
    outside = (F.col("x") < F.lit(facts["low"]).cast("double")) | (F.col("x") > F.lit(facts["high"]).cast("double"))
    measures = {
        "rows": F.count("*"), "nulls": F.count_if(F.col("x").isNull()), "distinct": F.count_distinct("x"), "mean": F.avg("x"), "std": F.stddev_samp("x"), "skewness": sample_skewness(F.col("x")), "kurtosis": sample_kurtosis(F.col("x")),
        "least": F.min("x"), "q1": q[0], "median": q[1], "q3": q[2], "most": F.max("x"), "outlier_share": F.coalesce(F.try_divide(F.count_if(outside), F.count("x")), F.lit(0.0)),
    }
    row = rows.agg(*[e.cast("double").alias(n) for n, e in measures.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in measures])).alias("r")).select("r.*")


def group_categories(df: DataFrame, group: str, columns: list[str], k: int = 3) -> DataFrame:
    """``group, column_name, rank, value, n, share``: the ``k`` most frequent values of each column in each group, ties to the
    smaller value; shares are of the group's known values. Counted before the window, which ranks distinct values."""
    from pyspark.sql import Window

    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    counts = df.select(F.col(f"`{group}`").alias("group"), F.explode(pairs).alias("p")).select("group", "p.*").where("value IS NOT NULL").groupBy("group", "column_name", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("group", "column_name").agg(F.sum("n").alias("all_")).withColumnsRenamed({"group": "g_", "column_name": "c_"})
    w = Window.partitionBy("group", "column_name").orderBy(F.desc("n"), "value")
    best = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    joined = best.join(totals, F.col("group").eqNullSafe(F.col("g_")) & (F.col("column_name") == F.col("c_")))
    return joined.select("group", "column_name", "rank", "value", "n", (F.col("n") / F.col("all_")).alias("share"))


def group_profile(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """One row for each group and numeric column: size, share of all rows, mean, std, min, max, median."""
    total = F.broadcast(df.agg(F.count("*").alias("all_")))
    aggs = [F.count("*").alias("size")]
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        aggs += [F.avg(x).alias(f"{i}_mean"), F.stddev_samp(x).alias(f"{i}_std"), F.min(x).cast("double").alias(f"{i}_min"), F.max(x).cast("double").alias(f"{i}_max"), F.percentile(x, F.lit(0.5)).alias(f"{i}_median")]
    grouped = df.groupBy(F.col(f"`{group}`").alias("group")).agg(*aggs).crossJoin(total)
    structs = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{i}_{n}").alias(f"{n}_value") for n in ("mean", "std", "min", "max", "median")]) for i, c in enumerate(columns)]
    return grouped.select("group", "size", (F.col("size") / F.col("all_")).alias("share"), F.explode(F.array(*structs)).alias("r")).select("group", "size", "share", "r.*")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row ``n_rows, n_columns, content``: equal for equal rows in any order; repeated rows count as often as they occur."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.sum(F.xxhash64(*df.columns).cast("decimal(28,0)")).cast("string").alias("content"))


def concentration(df: DataFrame, value: str, least: float = 0.01) -> DataFrame:
    """One row ``gini, top_share, effective_count`` of non-negative importances, placed range by range."""
    from tabulon.operators.clean import positions

    known = df.where(F.col(f"`{value}`").isNotNull()).select(F.col(f"`{value}`").cast("double").alias("v"))
    ranked = positions(known, ["v"]).select("v", (F.col("position") + 1).alias("i"))
    row = ranked.agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("i") * F.col("v")).alias("iv"), F.max("v").alias("top"), F.count_if(F.col("v") > least).alias("effective_count"))
    return row.select(F.try_divide(2 * F.col("iv") - (F.col("n") + 1) * F.col("s"), F.col("n") * F.col("s")).alias("gini"), F.try_divide("top", "s").alias("top_share"), "effective_count")


def metric_window(df: DataFrame, since, *, name: str = "name", value: str = "value", ts: str = "ts") -> DataFrame:
    """Statistics of each metric from ``since`` on: count, sum, avg, min, max and the latest value."""
    x = F.col(value)
    return df.where(F.col(ts) >= F.lit(since)).groupBy(F.col(name).alias("name")).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.max_by(value, F.struct(ts, value)).alias("latest"))


def latency_profile(df: DataFrame, *, name: str = "name", value: str = "value") -> DataFrame:
    """Average, extremes and nearest-rank median, p95 and p99 (the value at index ``int(n * p)``) of each operation."""
    from tabulon.operators.clean import grouped_running_totals

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(name).alias("name"), F.col(value).alias("v")).agg(F.count("*").alias("k"))
    c = grouped_running_totals(counts, "name", ["v"], {"upto": "k"})  # by distinct values, in ranges of all operations
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("upto_all") * p), F.col("v")))
    total = F.sum("k")
    return c.groupBy("name").agg(total.alias("n"), (F.sum(F.col("v") * F.col("k")) / total).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def request_summary(df: DataFrame, *, value: str = "value", failed: Column, slow: float = 1.0, ts: str = "ts") -> DataFrame:
    """One row: totals, requests a second, error share and slow requests."""
    seconds = F.greatest((F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))).cast("double"), F.lit(1.0))
    row = df.agg(F.count("*").alias("total"), F.count_if(failed).alias("errors"), F.count_if(F.col(value) > slow).alias("slow_count"), F.avg(value).alias("mean"), seconds.alias("seconds"))
    return row.select("total", "errors", "slow_count", "mean", (F.col("total") / F.col("seconds")).alias("per_second"), F.coalesce(F.try_divide(100.0 * F.col("errors"), "total"), F.lit(0.0)).alias("error_percent"))


def dataset_kind_scores(df: DataFrame, *, target: str | None = None, date: str | None = None) -> DataFrame:
    """``kind, score, rank``: how well a table suits tabular, series, text, anomaly and clustering work, best is 1."""
    numbers, texts = numeric_columns(df), string_columns(df)
    row = df.agg(F.count("*").alias("n"), (sum((F.avg(F.char_length(f"`{c}`")) > 50).cast("int") for c in texts) if texts else F.lit(0)).alias("long_texts"))
    width = max(1, len(df.columns))
    dated = F.lit(float(date is not None or bool(datetime_columns(df))))
    scores = {
        "tabular": 0.3 * F.lit(float(target is not None)) + 0.4 * F.lit(len(numbers) / width) + 0.3 * (F.col("n") > 100).cast("double"),
        "time_series": 0.6 * dated + 0.2 * F.lit(float(bool(numbers))) + 0.2 * F.lit(float(date is not None)),
        "text": 0.8 * F.least(F.col("long_texts").cast("double"), F.lit(1.0)) + 0.2 * F.lit(len(texts) / width),
        "anomaly": 0.3 * F.lit(float(target is None)) + 0.4 * F.lit(len(numbers) / width),
        "clustering": 0.4 * F.lit(float(target is None)) + 0.4 * F.lit(len(numbers) / width),
    }
    structs = [F.struct(F.lit(k).alias("kind"), s.alias("raw")) for k, s in scores.items()]
    listed = F.array_sort(F.array(*structs), lambda a, b: F.when(a["raw"] != b["raw"], F.sign(b["raw"] - a["raw"])).otherwise(F.when(a["kind"] < b["kind"], -1.0).otherwise(1.0)).cast("int"))
    best = F.greatest(F.array_max(F.transform(listed, lambda s: s["raw"])), F.lit(1e-9))
    return row.select(best.alias("best"), F.posexplode(listed).alias("i", "s")).select(F.col("s.kind").alias("kind"), (F.col("s.raw") / F.col("best")).alias("score"), (F.col("i") + 1).alias("rank"))
