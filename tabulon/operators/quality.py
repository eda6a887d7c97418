"""Quality scores of tables, issue records and type conformance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.rules import Rule, apply_rules, banded
from tabulon.functions.stats import null_out_nan, numeric_columns, spread_rows
from tabulon.operators.profile import column_profile, distinct_counts, duplicate_summary, missing_summary, mixed_types, zscore_outliers

LEVELS = [(0.95, "excellent"), (0.80, "good"), (0.60, "fair"), (0.40, "poor")]


def table_facts(df: DataFrame) -> DataFrame:
    """One row of the shares that the scores are made of; missing and distinct counts, duplicates, constants."""
    n_columns = len(df.columns)
    missing = missing_summary(df).agg(F.sum("null_count").alias("missing_cells"), F.count_if(F.col("null_ratio") == 1).alias("empty_columns"), F.count_if(F.col("null_ratio") > 0.9).alias("sparse_columns"))
    constant = distinct_counts(df).agg(F.count_if(F.col("unique_count") <= 1).alias("constant_columns"))
    row = duplicate_summary(df).crossJoin(F.broadcast(missing)).crossJoin(F.broadcast(constant))
    cells = F.col("n_rows") * n_columns
    return row.select("n_rows", F.lit(n_columns).alias("n_columns"), F.coalesce(F.try_divide("missing_cells", cells), F.lit(0.0)).alias("missing_ratio"), "duplicate_count", "duplicate_ratio", "empty_columns", "sparse_columns", "constant_columns")


def quality_report(df: DataFrame, *, exact: bool = True) -> DataFrame:
    """The column profile with the table's missing and duplicate ratio, score and level on every row."""
    # the profile has a row for each column, so one window over all of them is small
    every = Window.partitionBy()
    n, cells = F.first("n_rows").over(every), F.sum("n_rows").over(every)
    columns = column_profile(df, exact=exact).crossJoin(F.broadcast(duplicate_summary(df).select(F.col("duplicate_ratio").alias("table_duplicate_ratio"))))
    columns = columns.withColumns({"table_missing_ratio": F.coalesce(F.try_divide(F.sum("null_count").over(every), cells), F.lit(0.0)), "mean_": F.avg("column_score").over(every), "n_": n})
    score = 0.4 * (1 - F.col("table_missing_ratio")) + 0.2 * (1 - F.least(2 * F.col("table_duplicate_ratio"), F.lit(1.0))) + 0.4 * F.col("mean_")
    columns = columns.withColumn("table_score", F.when(F.col("n_") > 0, score).otherwise(0.0)).drop("mean_", "n_")
    return columns.withColumn("quality_level", banded(F.col("table_score"), LEVELS, "critical"))


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def scores(df: DataFrame) -> DataFrame:
    """One row of the table scores: batch, preparation, pipeline and monitoring, each between 0 and 1.

    Batch: 1 less .3 missing, .2 duplicates, .1 mixed columns, .4 empty columns. Preparation: mean of completeness,
    uniqueness (both halved at once) and varied columns. Pipeline: completeness, uniqueness (thrice), share of numeric
    columns with spread, and size up to 1,000 rows. Monitoring: mean of completeness twice and uniqueness.
    """
    numbers = numeric_columns(df)
    spread = df.agg(*[F.coalesce((F.stddev_samp(f"`{c}`") > 0).cast("int"), F.lit(0)).alias(f"s{i}") for i, c in enumerate(numbers)]) if numbers else None
    mixed = mixed_types(df).agg(F.count_if("mixed").alias("mixed_columns")) if any(t == "string" for _, t in df.dtypes) else None
    facts = table_facts(df)
    facts = facts.crossJoin(F.broadcast(mixed)) if mixed is not None else facts.withColumn("mixed_columns", F.lit(0))
    if spread is not None:
        facts = facts.crossJoin(F.broadcast(spread.select((sum(F.col(f"s{i}") for i in range(len(numbers))) / len(numbers)).alias("varied"))))
    else:
        facts = facts.withColumn("varied", F.lit(0.0))
    m, d, c = F.col("missing_ratio"), F.col("duplicate_ratio"), F.col("n_columns")
    batch = _clamp(1 - 0.3 * m - 0.2 * d - 0.1 * F.col("mixed_columns") / c - 0.4 * F.col("empty_columns") / c)
    preparation = (_clamp(1 - 2 * m) + _clamp(1 - 2 * d) + _clamp(1 - F.col("constant_columns") / c)) / 3
    pipeline = (_clamp(1 - 2 * m) + _clamp(1 - 3 * d) + F.col("varied") + F.least(F.lit(1.0), F.col("n_rows") / 1000.0)) / 4
    monitoring = ((1 - m) + (1 - m) + (1 - d)) / 3
    return facts.select("n_rows", batch.alias("batch_score"), preparation.alias("preparation_score"), pipeline.alias("pipeline_score"), monitoring.alias("monitoring_score"))


def validation_score(df: DataFrame) -> DataFrame:
    """One row ``missing_score, duplicate_score, outlier_score, score, status``; below .5 is an error, below .8 a warning."""
    facts = table_facts(df).select("missing_ratio", "duplicate_ratio")
    outliers = zscore_outliers(df).agg(F.coalesce(F.avg("outlier_ratio"), F.lit(0.0)).alias("outliers"))
    row = facts.crossJoin(F.broadcast(outliers))
    parts = [(1 - F.col("missing_ratio")).alias("missing_score"), (1 - F.col("duplicate_ratio")).alias("duplicate_score"), _clamp(1 - 3 * F.col("outliers")).alias("outlier_score")]
    row = row.select(*parts).withColumn("score", (F.col("missing_score") + F.col("duplicate_score") + F.col("outlier_score")) / 3)
    return row.withColumn("status", banded(F.col("score"), [(0.8, "valid"), (0.5, "warning")], "error"))


def conformance(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """``column_name, expected, n, invalid``: values of each column that its expected type can't take.

    Types: integer, float, boolean, datetime, string, categorical (fewer than 80 % distinct values, else all invalid).
    """
    aggs, parts = [], {}
    for i, (c, kind) in enumerate(expected.items()):
        x = F.col(f"`{c}`").cast("string")
        number = x.try_cast("double")
        valid = {"integer": number.isNotNull() & (number == F.floor(number)), "float": number.isNotNull(), "boolean": F.lower(F.trim(x)).isin("true", "false", "1", "0", "yes", "no", "t", "f"), "datetime": F.try_to_timestamp(x).isNotNull(), "string": F.lit(True), "categorical": F.lit(True)}[kind]
        aggs += [F.count(x).alias(f"{i}_n"), F.count_if(x.isNotNull() & ~valid).alias(f"{i}_bad"), (F.count_distinct(x) if kind == "categorical" else F.lit(0)).alias(f"{i}_u")]
        bad = F.when((F.lit(kind) == "categorical") & (F.col(f"{i}_u") >= 0.8 * F.col(f"{i}_n")), F.col(f"{i}_n")).otherwise(F.col(f"{i}_bad"))
        parts[c] = [("expected", F.lit(kind)), ("n", F.col(f"{i}_n")), ("invalid", bad)]
    return spread_rows(df.agg(*aggs), parts)


_ISSUE = ["issue_type", "severity", "column_name", "value", "message"]


def issues(df: DataFrame, *, required: list[str] | None = None, expected: dict[str, str] | None = None, max_missing: float = 0.5, max_duplicates: float = 0.1, max_outliers: float = 0.05) -> DataFrame:
    """Issue records ``issue_type, severity, column_name, value, message`` of a table.

    Missing required columns and types that do not conform are errors; missing values above ``max_missing`` are warnings,
    above 0.8 errors; duplicate rows above ``max_duplicates`` warnings, above 0.3 errors; outliers warnings.
    """
    spark = df.sparkSession
    found = [spark.createDataFrame([("missing_column", "error", c, None, f"required column {c} is missing") for c in required or [] if c not in df.columns], "issue_type string, severity string, column_name string, value double, message string")]
    ratio = F.col("null_ratio")
    found.append(missing_summary(df).where(ratio > max_missing).select(F.lit("missing_values").alias("issue_type"), F.when(ratio > 0.8, "error").otherwise("warning").alias("severity"), "column_name", ratio.cast("double").alias("value"), F.lit("impute or drop the column").alias("message")))
    dup = F.col("duplicate_ratio")
    found.append(duplicate_summary(df).where(dup > max_duplicates).select(F.lit("duplicate_rows").alias("issue_type"), F.when(dup > 0.3, "error").otherwise("warning").alias("severity"), F.lit(None).cast("string").alias("column_name"), dup.cast("double").alias("value"), F.lit("remove duplicate rows").alias("message")))
    if numeric_columns(df):
        out = F.col("outlier_ratio")
        found.append(zscore_outliers(df).where(out > max_outliers).select(F.lit("outliers").alias("issue_type"), F.lit("warning").alias("severity"), "column_name", out.cast("double").alias("value"), F.lit("examine or clip outliers").alias("message")))
    if expected := {c: k for c, k in (expected or {}).items() if c in df.columns}:
        bad = F.try_divide("invalid", "n").cast("double")
        found.append(conformance(df, expected).where("invalid > 0").select(F.lit("type_mismatch").alias("issue_type"), F.lit("error").alias("severity"), "column_name", bad.alias("value"), F.concat(F.lit("expected "), "expected").alias("message")))
    return reduce(DataFrame.unionByName, [f.select(*_ISSUE) for f in found])


def combined_status(results: DataFrame) -> DataFrame:
    """One row ``status, score, n`` from rows ``(status, score)``: the worst status and the mean score."""
    order = F.when(F.col("status") == "error", 2).when(F.col("status") == "warning", 1).otherwise(0)
    row = results.agg(F.max(order).alias("worst"), F.avg("score").alias("score"), F.count("*").alias("n"))
    return row.select(F.when(F.col("worst") == 2, "error").when(F.col("worst") == 1, "warning").otherwise("valid").alias("status"), "score", "n")


#: Recommendations from the table's shares.
RECOMMENDATIONS = [
    Rule("impute_missing", "missing_ratio", ">", 0.2, "Impute missing values or collect more data", "warning"),
    Rule("drop_duplicates", "duplicate_ratio", ">", 0.1, "Remove duplicate rows", "warning"),
    Rule("drop_sparse_columns", "sparse_columns", ">", 0, "Drop columns with few values", "warning"),
    Rule("drop_constant_columns", "constant_columns", ">", 0, "Drop columns with one value", "info"),
    Rule("collect_rows", "n_rows", "<", 1000, "Collect more rows", "info"),
]


def recommendations(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``rule, severity, metric, value, message`` for each rule that the table's facts hold."""
    return apply_rules(table_facts(df), rules or RECOMMENDATIONS)


def dataset_check(df: DataFrame, *, least_rows: int = 10, least_columns: int = 2) -> DataFrame:
    """Issues that keep a table from being analysed (errors) or make it doubtful (warnings)."""
    facts = table_facts(null_out_nan(df))
    rules = [
        Rule("too_few_rows", "n_rows", "<", least_rows, "too few rows", "error", "rows"),
        Rule("few_rows", "n_rows", "<", 50, "few rows", "warning", "rows"),
        Rule("too_few_columns", "n_columns", "<", least_columns, "too few columns", "error"),
        Rule("all_missing", "missing_ratio", ">=", 1.0, "no values at all", "error", "missing"),
        Rule("much_missing", "missing_ratio", ">", 0.5, "over half the values are missing", "warning", "missing"),
        Rule("many_duplicates", "duplicate_ratio", ">", 0.1, "many duplicate rows", "warning"),
    ]
    return apply_rules(facts, rules)


def final_check(df: DataFrame) -> DataFrame:
    """What is left to complain of after cleaning: an empty table, columns over 90 % missing, mixed types."""
    empty = table_facts(df).where("n_rows = 0").select(F.lit("empty_table").alias("issue_type"), F.lit(None).cast("string").alias("column_name"))
    sparse = missing_summary(df).where("null_ratio > 0.9").select(F.lit("mostly_missing").alias("issue_type"), "column_name")
    mixed = mixed_types(df).where("mixed").select(F.lit("mixed_types").alias("issue_type"), "column_name")
    return empty.unionByName(sparse).unionByName(mixed)
