"""Column expressions for statistics whose conventions differ from Spark's built-ins, and p-values for few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns; booleans are a class of their own."""
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def null_out_nan(df: DataFrame) -> DataFrame:
    """``df`` with NaN replaced by null in its floating columns, as counts and means are meant to skip both."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def rounded(value: Column, digits: int = 6) -> Column:
    """``value`` as a double rounded for comparison, without negative zero; exact halves go up whatever the last bit."""
    return F.round(value.cast("double") + F.lit(1e-9), digits) + F.lit(0.0)


def correlation(a, b) -> Column:
    """Pearson correlation over the rows where both are known; null if either is constant (``corr`` fails there in ANSI mode)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r.between(-1, 1), r).otherwise(F.signum(r))


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(x)
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(x) + 6.0))


def quantiles(x: Column, at: list[float], *, exact: bool = True, accuracy: int = 10_000) -> Column:
    """Array of quantiles by linear interpolation; ``exact=False`` keeps a bounded sketch instead of all values."""
    points = F.array(*[F.lit(p) for p in at])
    return F.percentile(x, points) if exact else F.percentile_approx(x.cast("double"), points, accuracy)


def fences(q1: Column, q3: Column, n: Column, *, least: int = 10) -> tuple[Column, Column]:
    """Tukey fences; null with fewer than ``least`` values or without spread."""
    spread = q3 - q1
    usable = (n >= least) & (spread > 0)
    return F.when(usable, q1 - 1.5 * spread), F.when(usable, q3 + 1.5 * spread)


def spread_rows(row: DataFrame, parts: dict[str, list[tuple[str, Column]]], key: str = "column_name") -> DataFrame:
    """One row of aggregates as one row for each key of ``parts``; a part lists (name, expression) in the same order."""
    structs = [F.struct(F.lit(k).alias(key), *[e.alias(n) for n, e in fields]) for k, fields in parts.items()]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


# --- p-values, for results of a few rows -------------------------------------------------------------------------


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_p(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square distribution."""
    return gamma_upper(dof / 2, statistic / 2) if dof > 0 else 1.0


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_lower(dof / 2, 0.5, dof / (dof + t * t)) if dof > 0 else 1.0


def ks_p(d: float, n: int, m: int) -> float:
    """Two-sample Kolmogorov-Smirnov p-value by the asymptotic series."""
    root = math.sqrt(n * m / (n + m)) if n and m else 0.0
    z = d * root
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))


def signed_rank_p(w: float, n: int, z: float, ties: float) -> float:
    """Two-sided p-value of the signed-rank statistic ``w``, the smaller sum of ranks: exact for up to 25 differences without
    ties (the share of sign patterns with no larger sum), else the normal one of ``z``."""
    if n > 25 or ties or w != int(w):
        return normal_two_sided(z)
    ways = [1] + [0] * (n * (n + 1) // 2)  # sign patterns by their sum of ranks
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)


def with_p_value(df: DataFrame, name: str, formula, *inputs: str) -> DataFrame:
    """``df`` with a p-value column computed from ``inputs`` by a vectorised function; meant for results of few rows."""
    @F.pandas_udf("double")
    def p_value(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else float(formula(*row)) for row in rows.itertuples(index=False)], dtype="float64")

    return df.withColumn(name, p_value(F.struct(*inputs)))
