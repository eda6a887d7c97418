"""The user's own metrics and row-expanding functions, by name.

A metric is a function of two columns that returns an aggregate column, so that any number of metrics and groups is one
pass in the JVM. An expander is a table function in Python that makes any number of rows of one row; Spark runs it beside
the rows, in Arrow batches where it can.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- metrics -----------------------------------------------------------------------------------------------------

METRICS: dict[str, tuple[Callable[..., Column], bool]] = {}


def metric(name: str, *, higher_is_better: bool = True):
    """Register a function of (actual, predicted, **options) that returns an aggregate column."""

    def register(function):
        if name in METRICS and METRICS[name][0] is not function:
            raise ValueError(f"metric {name} is registered twice")
        METRICS[name] = (function, higher_is_better)
        return function

    return register


@metric("mae", higher_is_better=False)
def mean_absolute_error(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


@metric("rmse", higher_is_better=False)
def root_mean_square_error(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


@metric("r2")
def coefficient_of_determination(y: Column, p: Column) -> Column:
    return 1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))


@metric("accuracy")
def share_right(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


@metric("pinball", higher_is_better=False)
def pinball_loss(y: Column, p: Column, quantile: float = 0.5) -> Column:
    return F.avg(F.when(y >= p, quantile * (y - p)).otherwise((1 - quantile) * (p - y)))


@metric("within")
def share_within(y: Column, p: Column, share: float = 0.1) -> Column:
    return F.avg((F.abs(y - p) <= share * F.abs(y)).cast("double"))


def evaluate(df: DataFrame, actual: str, predicted: str, metrics: list[str | tuple[str, dict]], by: list[str] | None = None) -> DataFrame:
    """``by, n, metric, value, higher_is_better`` of registered metrics over the rows where both columns are known.

    A metric is a name or a pair of name and options, which then stand in the name of the result. One aggregate, whatever
    the number of metrics; no rows without groups give one row for each metric with n = 0 and no value.
    """
    y, p = F.col(f"`{actual}`").cast("double"), F.col(f"`{predicted}`").cast("double")
    wanted = [(m, {}) if isinstance(m, str) else m for m in metrics]
    if missing := [m for m, _ in wanted if m not in METRICS]:
        raise ValueError(f"metrics {missing} aren't registered")
    keys = by or []
    names = [m + (f"({', '.join(f'{k}={v}' for k, v in sorted(o.items()))})" if o else "") for m, o in wanted]
    row = df.where(y.isNotNull() & p.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), *[METRICS[m][0](y, p, **o).cast("double").alias(f"v{i}") for i, (m, o) in enumerate(wanted)])
    structs = [F.struct(F.lit(name).alias("metric"), F.col(f"v{i}").alias("value"), F.lit(METRICS[m][1]).alias("higher_is_better")) for i, (name, (m, _)) in enumerate(zip(names, wanted, strict=True))]
    return row.select(*keys, "n", F.explode(F.array(*structs)).alias("r")).select(*keys, "n", "r.*")


# --- rows of rows ------------------------------------------------------------------------------------------------

EXPANDERS: dict[str, tuple[type, str]] = {}


def expander(name: str, returns: str):
    """Register a class whose ``eval`` yields tuples of the schema ``returns`` as a row-expanding function."""

    def register(cls):
        if name in EXPANDERS and EXPANDERS[name][0] is not cls:
            raise ValueError(f"expander {name} is registered twice")
        EXPANDERS[name] = (cls, returns)
        return cls

    return register


@expander("sentences", "position int, sentence string")
class Sentences:
    """The sentences of a text: what stands between runs of ``.!?``, trimmed, blank ones left out."""

    def eval(self, text: str):
        import re

        k = 0
        for part in re.split(r"[.!?]+", text or ""):
            if part := part.strip(" \t\n\r"):
                yield k, part
                k += 1


@expander("json_items", "key string, value string")
class JsonItems:
    """The members of a JSON object, values as JSON (texts as they are); nothing for other or broken JSON."""

    def eval(self, text: str):
        try:
            found = json.loads(text) if text else None
        except ValueError:
            found = None
        for k, v in found.items() if isinstance(found, dict) else ():
            yield k, v if isinstance(v, str) else json.dumps(v)


def expand(df: DataFrame, name: str, *columns: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) of each row beside each row that the expander makes of its ``columns``.

    Rows of which it makes none are dropped. The result's names must not clash with ``keep``.
    """
    if name not in EXPANDERS:
        raise ValueError(f"expander {name} isn't registered")
    cls, returns = EXPANDERS[name]
    spark = df.sparkSession
    spark.udtf.register(f"expand_{name}", F.udtf(cls, returnType=returns))
    keep = df.columns if keep is None else keep
    mine = ", ".join(f"t.`{c}`" for c in keep)
    return spark.sql(f"SELECT {mine}{', ' if keep else ''}e.* FROM {{rows}} t, LATERAL expand_{name}({', '.join(f't.`{c}`' for c in columns)}) e", rows=df)
