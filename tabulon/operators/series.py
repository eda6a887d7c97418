"""Time series, many at once: every operator works on (series, time, value) rows, partitioned by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.stats import correlation, fences, sample_kurtosis, sample_skewness, t_two_sided, with_p_value
from tabulon.operators.clean import interpolated, keep_first

#: Candidate seasons, in steps of the series.
PERIODS = (7, 12, 24, 30, 52, 365)


def _w(by: str, ts: str):
    return Window.partitionBy(by).orderBy(ts)


def clean(df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y", least: int = 10) -> DataFrame:
    """Rows with a time and a number, one for each time (the first by value), of series with at least ``least`` points."""
    rows = df.select(series, ts, F.col(y).try_cast("double").alias(y)).where(F.col(ts).isNotNull() & F.col(y).isNotNull())
    one = keep_first(rows, [series, ts], [y])
    return one.withColumn("n_", F.count("*").over(Window.partitionBy(series))).where(F.col("n_") >= least).drop("n_")


def frequency(df: DataFrame, series: str = "series", ts: str = "ts") -> DataFrame:
    """``series, gap_seconds, frequency``: the median gap as second, minute, hour, day, week, month, quarter or year."""
    gap = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(_w(series, ts)))
    median = df.withColumn("gap_", gap).groupBy(series).agg(F.percentile("gap_", F.lit(0.5)).alias("gap_seconds"))
    day = 86_400
    steps = [(60, "S"), (3600, "T"), (day, "H"), (5 * day, "D"), (25 * day, "W"), (80 * day, "M"), (300 * day, "Q")]
    name = F.lit("Y")
    for limit, code in reversed(steps):
        name = F.when(F.col("gap_seconds") < limit, code).otherwise(name)
    return median.withColumn("frequency", F.when(F.col("gap_seconds").isNotNull(), name))


def regularise(df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y", step: str = "1 day") -> DataFrame:
    """Each series on its full calendar of ``step``, gaps interpolated in time."""
    span = df.groupBy(series).agg(F.min(ts).alias("a_"), F.max(ts).alias("b_"))
    calendar = span.select(series, F.explode(F.sequence("a_", "b_", F.expr(f"INTERVAL {step}"))).alias(ts))
    return interpolated(calendar.join(df.select(series, ts, y), [series, ts], "left"), y, ts, [series], by="time")


def treat_outliers(df: DataFrame, series: str = "series", y: str = "y", method: str = "iqr") -> DataFrame:
    """``df`` with ``y`` clipped to each series' fences, or (``zscore``) with values over three deviations set to its median."""
    if method == "iqr":
        q = df.groupBy(series).agg(F.percentile(y, F.array(F.lit(0.25), F.lit(0.75))).alias("q_"), F.count(y).alias("n_"))
        low, high = fences(F.col("q_")[0], F.col("q_")[1], F.col("n_"), least=1)
        new = F.least(F.greatest(F.col(y), low), high)
        return df.join(q, series).withColumn(y, F.coalesce(new, F.col(y))).drop("q_", "n_")
    s = df.groupBy(series).agg(F.avg(y).alias("m_"), F.stddev_pop(y).alias("s_"), F.median(y).alias("med_"))
    return df.join(s, series).withColumn(y, F.when(F.abs(F.col(y) - F.col("m_")) > 3 * F.col("s_"), F.col("med_")).otherwise(F.col(y))).drop("m_", "s_", "med_")


def autocorrelation(df: DataFrame, lags: list[int] | range, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """``series, lag, acf, significant``: correlation of each series with itself some steps before, from one window pass."""
    w = _w(series, ts)
    shifted = df.select(series, F.col(y).cast("double").alias("y_"), *[F.lag(F.col(y).cast("double"), k).over(w).alias(f"l{k}") for k in lags])
    row = shifted.groupBy(series).agg(*[correlation(F.when(F.col(f"l{k}").isNotNull(), F.col("y_")), F.col(f"l{k}")).alias(f"r{k}") for k in lags])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("acf")) for k in lags])
    return row.select(series, F.explode(pairs).alias("p")).select(series, "p.*").withColumn("significant", F.abs("acf") > 0.1)


def seasonality(df: DataFrame, periods: tuple[int, ...] = PERIODS, series: str = "series", ts: str = "ts", y: str = "y", limit: float = 0.3) -> DataFrame:
    """``series, period, strength``: the period of largest autocorrelation above ``limit``; null where none is.

    A period needs more than twice as many points.
    """
    sizes = df.groupBy(series).agg(F.count("*").alias("n_"))
    found = autocorrelation(df, periods, series, ts, y).join(sizes, series).where(F.col("n_") > 2 * F.col("lag"))
    best = found.groupBy(series).agg(F.max(F.when(F.col("acf") > limit, F.struct("acf", -F.col("lag")))).alias("b"))
    return sizes.join(best, series, "left").select(series, (-F.col("b.col2")).cast("int").alias("period"), F.col("b.acf").alias("strength"))


def features(df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y", lags: tuple[int, ...] = (1, 7, 30), windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """``df`` with calendar parts, lags, the first difference, and rolling mean and deviation (null until full)."""
    w = _w(series, ts)
    out = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "weekday": F.weekday(ts), "quarter": F.quarter(ts), "diff": F.col(y) - F.lag(y).over(w)}
    out |= {f"lag_{k}": F.lag(y, k).over(w) for k in lags}
    for k in windows:
        frame = w.rowsBetween(-(k - 1), 0)
        full = F.count(y).over(frame) == k
        out |= {f"mean_{k}": F.when(full, F.avg(y).over(frame)), f"std_{k}": F.when(full, F.stddev_samp(y).over(frame))}
    return df.withColumns(out)


def windows(df: DataFrame, length: int, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """``series, ts, inputs, target``: the ``length`` values before each point, where there are as many."""
    frame = _w(series, ts).rowsBetween(-length, -1)
    return df.select(series, ts, F.collect_list(y).over(frame).alias("inputs"), F.col(y).alias("target")).where(F.size("inputs") == length)


def summary(df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """Count, span, moments and bias-corrected shape of each series."""
    x = F.col(y).cast("double")
    return df.groupBy(series).agg(F.count(x).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"), sample_skewness(x).alias("sample_skewness"), sample_kurtosis(x).alias("sample_kurtosis"))


def indexed(df: DataFrame, series: str = "series", ts: str = "ts") -> DataFrame:
    """``df`` with ``t``, 0 to n - 1 within each series."""
    return df.withColumn("t", F.row_number().over(_w(series, ts)) - 1)


def trend(df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """``series, slope, r2, n, direction`` of a line over the positions."""
    fit = indexed(df, series, ts).groupBy(series).agg(F.regr_slope(y, "t").alias("slope"), F.regr_r2(y, "t").alias("r2"), F.count(y).alias("n"))
    return fit.withColumn("direction", F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("flat"))


def decompose(df: DataFrame, period: int, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """``df`` with ``trend, seasonal, residual``: centred moving average, mean deviation by season, and the rest.

    An even period takes half of both ends. Seasonal parts are centred; ends without a full window have no trend.
    """
    w, half = _w(series, ts), period // 2
    frame = w.rowsBetween(-half, half)
    total, full = F.sum(y).over(frame), F.count(y).over(frame) == 2 * half + 1
    average = total / period if period % 2 else (total - 0.5 * (F.lag(y, half).over(w) + F.lead(y, half).over(w))) / period
    placed = indexed(df, series, ts).withColumn("trend", F.when(full, average)).withColumn("season_", F.pmod("t", F.lit(period)))
    placed = placed.withColumn("by_season_", F.avg(F.col(y) - F.col("trend")).over(Window.partitionBy(series, "season_")))
    centre = placed.groupBy(series, "season_").agg(F.first("by_season_").alias("s_")).groupBy(series).agg(F.avg("s_").alias("centre_"))
    out = placed.join(centre, series).withColumn("seasonal", F.col("by_season_") - F.col("centre_"))
    return out.withColumn("residual", F.col(y) - F.col("trend") - F.col("seasonal")).drop("season_", "by_season_", "centre_")


def decomposition_strength(parts: DataFrame, series: str = "series", y: str = "y") -> DataFrame:
    """``series, trend_strength, seasonal_strength, residual_strength``: deviations of the parts over that of the series."""
    share = lambda c: F.try_divide(F.stddev_pop(c), F.stddev_pop(y))
    return parts.groupBy(series).agg(share("trend").alias("trend_strength"), share("seasonal").alias("seasonal_strength"), share("residual").alias("residual_strength"))


def trend_test(df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """``series, slope, intercept, r2, n, t, p_value, trend``: the line over the positions, Student's t of its slope with its
    two-sided p-value, and ``increasing`` or ``decreasing`` only where that is below 0.05. Fewer than three values: null."""
    x = F.col(y).cast("double")
    fit = indexed(df, series, ts).groupBy(series).agg(F.regr_slope(x, "t").alias("slope"), F.regr_intercept(x, "t").alias("intercept"), F.regr_r2(x, "t").alias("r2"), F.regr_sxx(x, "t").alias("sxx"), F.regr_syy(x, "t").alias("syy"), F.count(x).alias("n"))
    rest = F.when(F.col("n") > 2, F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")) / (F.col("n") - 2))
    tested = with_p_value(fit.withColumns({"t": F.try_divide("slope", F.sqrt(rest / F.col("sxx"))), "dof_": F.col("n") - 2}), "p_value", t_two_sided, "t", "dof_")
    known = F.when(F.col("p_value").isNull() | (F.col("p_value") >= 0.05), "none").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return tested.select(series, "slope", "intercept", "r2", "n", "t", "p_value", known.alias("trend"))


#: MacKinnon's response surfaces for one series with a constant, by level (fixed values): limit = a + b/n + c/n^2 + d/n^3.
ADF_LIMITS = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}
#: Critical values of the KPSS statistic around a level, by level (fixed values).
KPSS_LIMITS = {0.10: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}


def _least_squares(gram, m: float, p: int):
    """t of the second regressor and the residual sum of squares, from products of (1, x, d1 .. dp, d) over ``m`` rows."""
    import numpy as np

    k = p + 2
    a, b = gram[:k, :k], gram[:k, -1]
    if m <= k or np.linalg.matrix_rank(a) < k:
        return None, None
    inverse = np.linalg.inv(a)
    beta = inverse @ b
    rss = max(0.0, float(gram[-1, -1] - beta @ b))
    error = (rss / (m - k) * inverse[1, 1]) ** 0.5
    return (float(beta[1] / error) if error > 0 else None), rss


def adf(df: DataFrame, lags: int | None = None, most: int = 12, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """``series, lags, n, adf, limit_1, limit_5, limit_10, p_value, stationary``: the augmented Dickey-Fuller test with a
    constant; ``lags=None`` takes the number up to ``most`` with the least Akaike criterion, all on the same rows.

    The products of the level, the lagged differences and the difference are summed in one aggregate for each series; only
    those small matrices meet Python. ``p_value`` lies between 0.01 and 0.1 by interpolation of the critical values and is
    cut there. Too few rows or a constant series: null.
    """
    import numpy as np
    import pandas as pd

    p = most if lags is None else lags
    w = _w(series, ts)
    centred = F.col(y).cast("double") - F.avg(F.col(y).cast("double")).over(Window.partitionBy(series))
    rows = df.select(series, ts, centred.alias("y_")).withColumn("x_", F.lag("y_").over(w)).withColumn("d_", F.col("y_") - F.col("x_"))
    rows = rows.withColumns({f"d{i}_": F.lag("d_", i).over(w) for i in range(1, p + 1)})
    names = ["one_", "x_", *[f"d{i}_" for i in range(1, p + 1)], "d_"]
    rows = rows.withColumn("one_", F.lit(1.0))
    # with lags to choose from, all fits use the rows that have all lags; the chosen one then uses every row that it can
    uses = sorted({p} if lags is not None else {p, *range(p + 1)})
    sums = []
    for q in uses:
        known = F.col(f"d{q}_").isNotNull() if q else F.col("x_").isNotNull()
        mine = [*names[: q + 2], "d_"]
        sums += [F.array(*[F.coalesce(F.sum(F.when(known, F.col(a) * F.col(b))), F.lit(0.0)) for i, a in enumerate(mine) for b in mine[i:]]).alias(f"g{q}")]
    grams = rows.groupBy(series).agg(*sums, F.count("d_").alias("m_"))

    def matrix(flat, k: int):
        out = np.zeros((k, k))
        out[np.triu_indices(k)] = flat
        return out + np.triu(out, 1).T

    def solve(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                held = {q: matrix(getattr(r, f"g{q}"), q + 3) for q in uses}
                best = p
                if lags is None:
                    full, m = held[p], held[p][0, 0]
                    found = []
                    for q in range(p + 1):
                        keep = [*range(q + 2), p + 2]
                        rss = _least_squares(full[np.ix_(keep, keep)], m, q)[1]
                        if rss:
                            found.append((m * np.log(rss / m) + 2 * (q + 2), q))
                    best = min(found)[1] if found else 0
                t, _ = _least_squares(held[best], held[best][0, 0], best)
                out.append((r[0], best, int(held[best][0, 0]), t))
            yield pd.DataFrame(out, columns=[series, "lags", "n", "adf"]).astype({"adf": "float64"})

    kind = dict(df.dtypes)[series]
    found = grams.mapInPandas(solve, f"`{series}` {kind}, lags int, n long, adf double").withColumn("adf", F.when(~F.isnan("adf"), F.col("adf")))
    limit = lambda a: sum((F.lit(c) / F.pow(F.col("n").cast("double"), F.lit(float(i))) for i, c in enumerate(ADF_LIMITS[a])), F.lit(0.0))
    limits = {f"limit_{int(a * 100)}": F.when(F.col("n") > 0, limit(a)) for a in sorted(ADF_LIMITS)}
    return found.withColumns(limits).withColumns({"p_value": _between("adf", [("limit_1", 0.01), ("limit_5", 0.05), ("limit_10", 0.10)]), "stationary": F.col("adf") < F.col("limit_5")})


def _between(statistic: str, points: list[tuple]) -> Column:
    """A p-value by linear interpolation among (critical value, level) in rising order of the value, cut at both ends."""
    at = [(F.col(v) if isinstance(v, str) else F.lit(v), p) for v, p in points]
    x = F.col(statistic)
    out = F.lit(at[-1][1])
    for (a, p), (b, q) in reversed(list(zip(at, at[1:], strict=False))):
        out = F.when(x <= b, p + (q - p) * (x - a) / (b - a)).otherwise(out)
    return F.when(x.isNotNull(), F.when(x <= at[0][0], at[0][1]).otherwise(out))


def kpss(df: DataFrame, lags: int | None = None, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """``series, lags, n, kpss, p_value, stationary``: the test around a level with Bartlett's weights over ``lags``, by default
    the next whole number of 12 (n / 100)^(1/4) for each series. ``p_value`` is interpolated and cut at 0.01 and 0.1.

    Products with each lag are counted in one aggregate; the largest default of all series bounds the lags looked at.
    """
    w = _w(series, ts)
    value = F.col(y).cast("double")
    rows = df.select(series, ts, value.alias("y_")).where("y_ IS NOT NULL").withColumn("e_", F.col("y_") - F.avg("y_").over(Window.partitionBy(series)))
    rows = rows.withColumn("s_", F.sum("e_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    auto = F.ceil(12 * F.pow(F.col("n") / 100.0, F.lit(0.25))).cast("int")
    if lags is None:
        most = df.where(value.isNotNull()).groupBy(series).agg(F.count("*").alias("n")).agg(F.max(F.least(auto, F.greatest(F.col("n") - 1, F.lit(0)))).alias("m")).first()["m"] or 0
    else:
        most = lags
    rows = rows.withColumns({f"e{k}_": F.lag("e_", k).over(w) for k in range(1, most + 1)})
    sums = rows.groupBy(series).agg(F.count("*").alias("n"), F.sum(F.col("s_") * F.col("s_")).alias("ss_"), F.sum(F.col("e_") * F.col("e_")).alias("g0"), *[F.coalesce(F.sum(F.col("e_") * F.col(f"e{k}_")), F.lit(0.0)).alias(f"g{k}") for k in range(1, most + 1)])
    own = F.least(auto, F.greatest(F.col("n") - 1, F.lit(0))).cast("int") if lags is None else F.lit(lags)
    weighted = sum((F.when(F.lit(k) <= F.col("lags"), 2 * (1 - k / (F.col("lags") + 1.0)) * F.col(f"g{k}")).otherwise(0.0) for k in range(1, most + 1)), F.col("g0"))
    found = sums.withColumn("lags", own).withColumn("kpss", F.try_divide("ss_", F.col("n") * weighted))
    points = sorted((v, p) for p, v in KPSS_LIMITS.items())
    return found.select(series, "lags", "n", "kpss").withColumns({"p_value": _between("kpss", points), "stationary": F.col("kpss") < KPSS_LIMITS[0.05]})


def stationarity(df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """``series, adf, kpss, stationary``: Dickey-Fuller t (constant, no lags) and KPSS (level, no lags) statistics.

    Stationary if both agree at 5 %: adf below -2.86 and kpss below 0.463.
    """
    w = _w(series, ts)
    x = F.lag(F.col(y).cast("double")).over(w)
    rows = df.withColumns({"x_": x, "d_": F.col(y) - x, "e_": F.col(y) - F.avg(y).over(Window.partitionBy(series))}).withColumn("s_", F.sum("e_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = F.when(F.col("x_").isNotNull(), F.col("d_"))
    agg = rows.groupBy(series).agg(F.regr_slope(both, "x_").alias("b"), F.regr_sxx(both, "x_").alias("sxx"), F.regr_syy(both, "x_").alias("syy"), F.count(both).alias("m"), F.count(y).alias("n"), F.sum(F.col("s_") * F.col("s_")).alias("ss"), F.sum(F.col("e_") * F.col("e_")).alias("ee"))
    error = F.sqrt((F.col("syy") - F.col("b") * F.col("b") * F.col("sxx")) / (F.col("m") - 2) / F.col("sxx"))
    stats = agg.select(series, F.try_divide("b", error).alias("adf"), F.try_divide("ss", F.col("n") * F.col("ee")).alias("kpss"))
    return stats.withColumn("stationary", (F.col("adf") < -2.86) & (F.col("kpss") < 0.463))


def forecast(df: DataFrame, horizon: int = 30, *, method: str = "naive", period: int = 7, step: str = "1 day", series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """``series, h, ts, forecast, lower, upper`` after each series' last time.

    ``naive`` repeats the last season, ``drift`` goes on along first to last, ``trend`` adds mean deviations by season to
    a fitted line. Bands are 1.96 deviations of the one-step errors times the root of the steps.
    """
    rows = indexed(df.select(series, ts, F.col(y).cast("double").alias(y)), series, ts)
    w = _w(series, ts)
    if method == "trend":
        line = rows.groupBy(series).agg(F.regr_slope(y, "t").alias("b_"), F.regr_intercept(y, "t").alias("a_"))
        rest = rows.join(line, series).withColumn("e_", F.col(y) - F.col("a_") - F.col("b_") * F.col("t"))
        seasons = rest.groupBy(series, F.pmod("t", F.lit(period)).alias("k")).agg(F.avg("e_").alias("v"))
        sigma = rest.groupBy(series).agg(F.first("a_").alias("a_"), F.first("b_").alias("b_"), F.stddev_samp("e_").alias("sigma_"), F.max("t").alias("t_"), F.max(ts).alias("last_"))
    else:
        gap = period if method == "naive" else 1
        sigma = rows.withColumn("e_", F.col(y) - F.lag(y, gap).over(w)).groupBy(series).agg(F.stddev_samp("e_").alias("sigma_"), F.max("t").alias("t_"), F.max(ts).alias("last_"), F.max_by(y, "t").alias("y_"), F.min_by(y, "t").alias("y0_"))
        seasons = rows.withColumn("n_", F.max("t").over(Window.partitionBy(series))).where(F.col("t") > F.col("n_") - period).select(series, F.pmod("t", F.lit(period)).alias("k"), F.col(y).alias("v"))
    future = sigma.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("k", F.pmod(F.col("t_") + F.col("h"), F.lit(period)))
    at = F.col("last_") + F.col("h") * F.expr(f"INTERVAL {step}")
    if method == "drift":
        value = F.col("y_") + F.col("h") * F.try_divide(F.col("y_") - F.col("y0_"), F.col("t_"))
        out = future.withColumn("forecast", value)
    else:
        out = future.join(seasons, [series, "k"], "left")
        out = out.withColumn("forecast", F.col("v") if method == "naive" else F.col("a_") + F.col("b_") * (F.col("t_") + F.col("h")) + F.coalesce("v", F.lit(0.0)))
    reach = F.sqrt(F.ceil(F.col("h") / period) if method == "naive" else F.col("h").cast("double")) if method != "trend" else F.lit(1.0)
    band = 1.96 * F.coalesce("sigma_", F.lit(0.0)) * reach
    return out.select(series, "h", at.alias(ts), "forecast", (F.col("forecast") - band).alias("lower"), (F.col("forecast") + band).alias("upper"))


def accuracy(df: DataFrame, actual: str = "actual", predicted: str = "forecast", by: list[str] | None = None, scale: str | None = None) -> DataFrame:
    """``rmse, mae, mape, smape, r2`` (and ``mase`` over the column ``scale``) of forecasts, by group."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = a - p
    out = [F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (100 * F.avg(F.when(a != 0, F.abs(e / a)))).alias("mape"), (100 * F.avg(F.try_divide(2 * F.abs(e), F.abs(a) + F.abs(p)))).alias("smape"), (1 - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count(e))).alias("r2")]
    if scale:
        out.append(F.try_divide(F.avg(F.abs(e)), F.first(scale)).alias("mase"))
    return df.where(a.isNotNull() & p.isNotNull()).groupBy(*(by or [])).agg(*out)


def backtest(df: DataFrame, *, folds: int = 3, horizon: int = 7, methods: tuple[str, ...] = ("naive", "drift", "trend"), period: int = 7, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """``series, method, folds, rmse, spread, best``: rolling-origin errors of each method; the least mean error is best."""
    rows = indexed(df.select(series, ts, F.col(y).cast("double").alias(y)), series, ts).withColumn("n_", F.count("*").over(Window.partitionBy(series)))
    parts = []
    for f in range(folds):
        end = F.col("n_") - horizon * (folds - f)
        train, test = rows.where(F.col("t") < end), rows.where((F.col("t") >= end) & (F.col("t") < end + horizon)).withColumn("h", (F.col("t") - end + 1).cast("int"))
        for m in methods:
            guess = forecast(train, horizon, method=m, period=period, series=series, ts=ts, y=y).select(series, "h", "forecast")
            parts.append(accuracy(test.join(guess, [series, "h"]), y, "forecast", [series]).select(series, F.lit(m).alias("method"), "rmse"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out = every.groupBy(series, "method").agg(F.count("*").alias("folds"), F.avg("rmse").alias("rmse"), F.stddev_samp("rmse").alias("spread"))
    return out.withColumn("best", F.row_number().over(Window.partitionBy(series).orderBy("rmse", "method")) == 1)


def checks(df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y", least: int = 10) -> DataFrame:
    """``series, n, missing_share, duplicate_times, usable`` of each series."""
    row = df.groupBy(series).agg(F.count("*").alias("n"), (F.count_if(F.col(y).isNull()) / F.count("*")).alias("missing_share"), (F.count("*") - F.count_distinct(ts)).alias("duplicate_times"))
    return row.withColumn("usable", (F.col("n") >= least) & (F.col("missing_share") <= 0.2))


def share_of_total(df: DataFrame, value: str, by: Column | None = None) -> DataFrame:
    """``df`` with ``share`` of ``value`` in its total (of the group ``by``)."""
    w = Window.partitionBy(*([by] if by is not None else []))
    return df.withColumn("share", F.try_divide(F.col(value), F.sum(value).over(w)))


def scale_factors(df: DataFrame, method: str = "standard", series: str = "series", y: str = "y") -> DataFrame:
    """``series, centre, spread`` to scale by: mean and deviation, least and range, or median and quartile range."""
    v = F.col(y).cast("double")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a, b = {"standard": (F.avg(v), F.stddev_pop(v)), "minmax": (F.min(v), F.max(v) - F.min(v)), "robust": (q[1], q[2] - q[0])}[method]
    return df.groupBy(series).agg(a.alias("centre"), F.when(b > 0, b).otherwise(1.0).alias("spread"))


def scaled(df: DataFrame, factors: DataFrame, columns: list[str], *, back: bool = False, series: str = "series") -> DataFrame:
    """``df`` with columns scaled by the factors of their series, or ``back`` in the units of the series."""
    new = lambda c: F.col(c) * F.col("spread") + F.col("centre") if back else (F.col(c) - F.col("centre")) / F.col("spread")
    return df.join(factors, series).withColumns({c: new(c) for c in columns}).select(*df.columns)


def with_external(df: DataFrame, external: DataFrame, columns: list[str], *, lags: tuple[int, ...] = (0, 1), series: str = "series", ts: str = "ts") -> DataFrame:
    """``df`` with columns of another table at the same time, and some steps before; without ``series`` there they serve all."""
    by = [series, ts] if series in external.columns else [ts]
    joined = df.join(external.select(*by, *columns), by, "left")
    w = _w(series, ts)
    return joined.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags if k}).drop(*([] if 0 in lags else columns))


def autoregression(df: DataFrame, lags: int = 2, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """``series, n, coefficients, sigma, last``: least squares of each value on a constant and its ``lags`` predecessors.

    The normal equations are aggregated over each series less its mean, in units of its deviation, so that a high level or a
    large unit costs no digits; each series' small matrix is solved in a vectorised step over one row for each series.
    Series with too few rows have no coefficients.
    """
    w, whole = _w(series, ts), Window.partitionBy(series)
    level = df.select(series, ts, F.col(y).cast("double").alias("y_")).withColumns({"mean_": F.avg("y_").over(whole), "unit_": F.stddev_pop("y_").over(whole)})
    level = level.withColumn("unit_", F.when(F.col("unit_") > 0, F.col("unit_")).otherwise(1.0)).withColumn("y_", (F.col("y_") - F.col("mean_")) / F.col("unit_"))
    xs = [F.lit(1.0), *[F.lag("y_", k).over(w) for k in range(1, lags + 1)]]
    rows = level.select(series, "mean_", "unit_", "y_", F.row_number().over(w).alias("t_"), *[x.alias(f"x{i}") for i, x in enumerate(xs)])
    full = F.col(f"x{lags}").isNotNull() & F.col("y_").isNotNull()
    width = lags + 1
    sums = [F.sum(F.when(full, F.col(f"x{i}") * F.col(f"x{j}"))).alias(f"m{i}_{j}") for i in range(width) for j in range(width)]
    sums += [F.sum(F.when(full, F.col(f"x{i}") * F.col("y_"))).alias(f"v{i}") for i in range(width)]
    back = lambda z: F.col("mean_") + F.col("unit_") * z
    last = F.array(*[F.max_by(back(F.col("y_") if k == 0 else F.col(f"x{k}")), "t_") for k in range(lags)])
    grouped = rows.groupBy(series, F.col("mean_").alias("mean"), F.col("unit_").alias("unit")).agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("y_") * F.col("y_"))).alias("yy"), *sums, last.alias("last"))

    def solve(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.n <= width:
                    out.append((None, None))
                    continue
                m = np.array([[getattr(row, f"m{i}_{j}") for j in range(width)] for i in range(width)])
                v = np.array([getattr(row, f"v{i}") for i in range(width)])
                beta = np.linalg.lstsq(m, v, rcond=None)[0]
                sigma = row.unit * float(np.sqrt(max(row.yy - 2 * beta @ v + beta @ m @ beta, 0.0) / (row.n - width)))
                out.append(([float(row.mean * (1 - beta[1:].sum()) + row.unit * beta[0]), *beta[1:].tolist()], sigma))
            yield pdf[[series, "n", "last"]].assign(coefficients=[b for b, _ in out], sigma=[s for _, s in out])[[series, "n", "coefficients", "sigma", "last"]]

    kind = dict(df.dtypes)[series]
    return grouped.mapInPandas(solve, f"`{series}` {kind}, n long, coefficients array<double>, sigma double, last array<double>")


def autoregressive_forecast(model: DataFrame, horizon: int, series: str = "series") -> DataFrame:
    """``series, h, forecast`` of :func:`autoregression`: each step from the ones before."""
    step = lambda a, h: F.struct((lambda value: F.concat(F.array(value), F.slice(a["recent"], F.lit(1), F.size("last") - 1)))(_next(a["recent"])).alias("recent"), F.concat(a["out"], F.array(_next(a["recent"]))).alias("out"))
    start = F.struct(F.col("last").alias("recent"), F.array().cast("array<double>").alias("out"))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda a: a["out"])
    return model.where("coefficients IS NOT NULL").select(series, F.posexplode(made).alias("h", "forecast")).withColumn("h", F.col("h") + 1)


def _next(recent: Column) -> Column:
    terms = F.zip_with(F.slice("coefficients", F.lit(2), F.size("coefficients") - 1), recent, lambda b, x: b * x)
    return F.element_at("coefficients", 1) + F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
