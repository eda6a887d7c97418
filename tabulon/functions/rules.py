"""Rule tables: declarative conditions over metric rows that give messages."""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TESTS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


@dataclass(frozen=True)
class Rule:
    """``message`` holds when ``metric test value`` does; several rules of one ``group`` are tried in order."""

    name: str
    metric: str
    test: str
    value: float
    message: str
    severity: str = "info"
    group: str | None = None

    def holds(self) -> Column:
        return F.coalesce(_TESTS[self.test](F.col(self.metric), F.lit(self.value)), F.lit(False))


def apply_rules(metrics: DataFrame, rules: list[Rule], keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row ``(keys, rule, severity, metric, value, message)`` for each row of ``metrics`` and rule that holds.

    Of the rules of one group only the first that holds counts. A null metric holds no rule. No shuffle.
    """
    before: dict[str, Column] = {}
    found = []
    for r in rules:
        holds = r.holds()
        if r.group:
            taken = before.get(r.group, F.lit(False))
            before[r.group] = taken | holds
            holds = holds & ~taken
        row = F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.metric).alias("metric"), F.col(r.metric).cast("double").alias("value"), F.lit(r.message).alias("message"))
        found.append(F.when(holds, row))
    return metrics.select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r")).select(*keys, "r.*")


def banded(value: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first band whose lower limit ``value`` reaches, bands given from high to low."""
    out = F.lit(otherwise)
    for limit, name in reversed(bands):
        out = F.when(value >= limit, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)
