"""Own stages of ``pyspark.ml`` pipelines: fitted once, saved, loaded and applied to other tables and to streams.

Numbers that a stage learns are parameters, a pair for each column; what grows with the values of a column is a table that
is written beside them. Stages overwrite their columns unless ``outputCols`` names others. A function or a rule of the
user's own is a stage too.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.selection import quantile_arrays
from tabulon.functions.storage import cut
from tabulon.operators import features, fitted


def _number(name: str) -> Column:
    """A column as a double, NaN as null."""
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x), x)


class _Columns(Params):
    """Columns that a stage reads and those that it writes."""

    inputCols: Param = Param(Params._dummy(), "inputCols", "columns to read", TypeConverters.toListString)
    outputCols: Param = Param(Params._dummy(), "outputCols", "columns to write, the ones read if empty", TypeConverters.toListString)

    def _pairs(self) -> list[tuple[str, str]]:
        names = self.getOrDefault(self.inputCols)
        out = self.getOrDefault(self.outputCols) if self.isDefined(self.outputCols) else []
        if out and len(out) != len(names):
            raise ValueError("outputCols has one name for each of inputCols")
        return list(zip(names, out or names, strict=True))

    def _pass_on(self, model):
        for p in (self.inputCols, self.outputCols):
            if self.isDefined(p):
                model._set(**{p.name: self.getOrDefault(p)})
        return model


class _Saved(DefaultParamsReadable, DefaultParamsWritable):
    """Persistence of stages whose state is all parameters."""


# --- numbers -----------------------------------------------------------------------------------------------------


class _NumberModel(Model, _Columns, _Saved):
    """Two learned numbers for each column; NaN where there was nothing to learn from."""

    a: Param = Param(Params._dummy(), "a", "first number of each column", TypeConverters.toListFloat)
    b: Param = Param(Params._dummy(), "b", "second number of each column", TypeConverters.toListFloat)

    def _step(self, x: Column, a: float | None, b: float | None) -> Column:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = lambda v: None if math.isnan(v) else v
        values = zip(self._pairs(), self.getOrDefault(self.a), self.getOrDefault(self.b), strict=True)
        return dataset.withColumns({out: self._step(_number(c), known(a), known(b)) for (c, out), a, b in values})


class _NumberEstimator(Estimator, _Columns, _Saved):
    """Learns two aggregates of each column in one pass."""

    _model: type = _NumberModel

    def _points(self) -> list[float]:
        """Quantiles that are needed, which are found beforehand."""
        return []

    def _learned(self, x: Column, q: Column | None) -> tuple[Column, Column]:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> Model:
        names, at = self.getOrDefault(self.inputCols), self._points()
        found = quantile_arrays(dataset, [_number(c) for c in names], at) if at else [None] * len(names)
        parts = [e.cast("double").alias(f"{k}{i}") for i, c in enumerate(names) for k, e in zip("ab", self._learned(_number(c), found[i]), strict=True)]
        row = dataset.agg(*parts).first()
        of = lambda k: [math.nan if row[f"{k}{i}"] is None else row[f"{k}{i}"] for i in range(len(names))]
        return self._pass_on(self._model()._set(a=of("a"), b=of("b")))


class FillModel(_NumberModel):
    """Nulls and NaN replaced by what was learned; a column that had no value stays null."""

    def _step(self, x, a, b):
        return F.coalesce(x, F.lit(a).cast("double"))


class Fill(_NumberEstimator):
    """``strategy``: the ``mean``, ``median``, ``min`` or ``max`` of the fitted rows, or ``constant`` with ``value``."""

    strategy: Param = Param(Params._dummy(), "strategy", "mean, median, min, max or constant", TypeConverters.toString)
    value: Param = Param(Params._dummy(), "value", "the constant", TypeConverters.toFloat)
    _model = FillModel

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, strategy="mean", value=0.0):
        super().__init__()
        self._setDefault(strategy="mean", value=0.0)
        self._set(**self._input_kwargs)

    def _points(self):
        return [0.5] if self.getOrDefault(self.strategy) == "median" else []

    def _learned(self, x, q):
        name = self.getOrDefault(self.strategy)
        value = {"mean": F.avg, "median": lambda v: q[0], "min": F.min, "max": F.max, "constant": lambda v: F.lit(self.getOrDefault(self.value))}
        if name not in value:
            raise ValueError(f"no strategy {name}")
        return value[name](x), F.lit(None)


class ClipModel(_NumberModel):
    """Values outside the learned limits moved to them; nulls stay."""

    def _step(self, x, a, b):
        low, high = (F.lit(v).cast("double") for v in (a, b))
        return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


class Clip(_NumberEstimator):
    """Limits are the quantiles ``lower`` and ``upper`` of the fitted rows, or Tukey's fences with ``fences=True``."""

    lower: Param = Param(Params._dummy(), "lower", "lower quantile", TypeConverters.toFloat)
    upper: Param = Param(Params._dummy(), "upper", "upper quantile", TypeConverters.toFloat)
    fences: Param = Param(Params._dummy(), "fences", "whether limits are Tukey's fences", TypeConverters.toBoolean)
    _model = ClipModel

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, lower=0.05, upper=0.95, fences=False):
        super().__init__()
        self._setDefault(lower=0.05, upper=0.95, fences=False)
        self._set(**self._input_kwargs)

    def _points(self):
        return [0.25, 0.75] if self.getOrDefault(self.fences) else [self.getOrDefault(self.lower), self.getOrDefault(self.upper)]

    def _learned(self, x, q):
        wide = 1.5 * (q[1] - q[0]) if self.getOrDefault(self.fences) else F.lit(0.0)
        return q[0] - wide, q[1] + wide


class ScaleModel(_NumberModel):
    """Values less the learned centre, over the learned width; 0 where the width is 0."""

    def _step(self, x, a, b):
        return F.when(x.isNotNull(), F.coalesce((x - F.lit(a).cast("double")) / F.lit(b if b else None).cast("double"), F.lit(0.0)))


class Scale(_NumberEstimator):
    """``method``: ``standard`` (mean, deviation), ``minmax`` (least, range) or ``robust`` (median, quartile range)."""

    method: Param = Param(Params._dummy(), "method", "standard, minmax or robust", TypeConverters.toString)
    _model = ScaleModel

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, method="standard"):
        super().__init__()
        self._setDefault(method="standard")
        self._set(**self._input_kwargs)

    def _points(self):
        return [0.25, 0.5, 0.75] if self.getOrDefault(self.method) == "robust" else []

    def _learned(self, x, q):
        name = self.getOrDefault(self.method)
        if name == "standard":
            return F.avg(x), F.stddev_pop(x)
        if name == "minmax":
            return F.min(x), F.max(x) - F.min(x)
        if name != "robust":
            raise ValueError(f"no method {name}")
        return q[1], q[2] - q[0]


# --- values ------------------------------------------------------------------------------------------------------


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.cls()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        instance.table = self.sparkSession.read.parquet(f"{path}/table")
        return instance


class _TableModel(Model, _Columns, MLReadable, MLWritable):
    """What was learned is a table ``column_name, value, ...``, joined to the rows; Spark picks the join by its size."""

    table: DataFrame | None = None

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class GroupRareModel(_TableModel):
    """Values that were rare become ``other``; others, also those not seen when fitting, and nulls stay."""

    other: Param = Param(Params._dummy(), "other", "what rare values become", TypeConverters.toString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for i, (c, out) in enumerate(self._pairs()):
            rare = self.table.where(F.col("column_name") == c).select(F.col("value").alias(f"rare_{i}"))
            value = F.when(F.col(f"rare_{i}").isNotNull(), F.lit(self.getOrDefault(self.other))).otherwise(F.col(f"`{c}`").cast("string"))
            dataset = dataset.join(rare, F.col(f"`{c}`").cast("string") == F.col(f"rare_{i}"), "left").withColumn(out, value).drop(f"rare_{i}")
        return dataset


class GroupRare(Estimator, _Columns, _Saved):
    """Learns the values whose share of a column's known values is below ``threshold``."""

    threshold: Param = Param(Params._dummy(), "threshold", "least share of a value that stays", TypeConverters.toFloat)
    other: Param = Param(Params._dummy(), "other", "what rare values become", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, threshold=0.01, other="Other"):
        super().__init__()
        self._setDefault(threshold=0.01, other="Other")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> GroupRareModel:
        names = self.getOrDefault(self.inputCols)
        cells = dataset.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in names])).alias("c")).select("c.*").where("value IS NOT NULL")
        counted = cells.groupBy("column_name", "value").agg(F.count("*").alias("n_"))
        total = F.broadcast(counted.groupBy("column_name").agg(F.sum("n_").alias("all_")))  # a row for each column
        model = self._pass_on(GroupRareModel()._set(other=self.getOrDefault(self.other)))
        model.table = cut(counted.join(total, "column_name").where(F.col("n_") < self.getOrDefault(self.threshold) * F.col("all_")).select("column_name", "value"))
        return model


class EncodeModel(_TableModel):
    """A code for each value; nulls stay null, values not seen when fitting get the code learned for them."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for c, out in self._pairs():
            held = f"{c}__code"
            coded = fitted.apply_codes(dataset, self.table, [c], "__code")
            dataset = coded.withColumn(out, F.col(f"`{held}`")).drop(held)
        return dataset


class Encode(Estimator, _Columns, _Saved):
    """``method``: ``frequency`` (share of rows), ``order`` (place among the sorted values) or ``target`` (smoothed mean of
    ``target``)."""

    method: Param = Param(Params._dummy(), "method", "frequency, order or target", TypeConverters.toString)
    target: Param = Param(Params._dummy(), "target", "column whose mean is the code", TypeConverters.toString)
    smoothing: Param = Param(Params._dummy(), "smoothing", "weight of the overall mean, in rows", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, method="frequency", target=None, smoothing=10.0):
        super().__init__()
        self._setDefault(method="frequency", smoothing=10.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> EncodeModel:
        method = self.getOrDefault(self.method)
        if method not in ("frequency", "order", "target"):
            raise ValueError(f"no method {method}")
        target = self.getOrDefault(self.target) if self.isDefined(self.target) else None
        model = self._pass_on(EncodeModel())
        model.table = cut(fitted.fit_codes(dataset, self.getOrDefault(self.inputCols), method, target, self.getOrDefault(self.smoothing)))
        return model


# --- rules and own functions -------------------------------------------------------------------------------------


class Rules(Transformer, _Saved):
    """Columns from declarative rules, as :func:`tabulon.operators.features.business_rules` takes them."""

    rules: Param = Param(Params._dummy(), "rules", "list of rule dictionaries")

    @keyword_only
    def __init__(self, *, rules=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return features.business_rules(dataset, self.getOrDefault(self.rules))


FUNCTIONS: dict[str, Callable[..., DataFrame]] = {}


def transformer(name: str):
    """Register a function of (DataFrame, **options) as what :class:`Apply` does under ``name``."""

    def register(function):
        if FUNCTIONS.get(name, function) is not function:
            raise ValueError(f"transformer {name} is registered twice")
        FUNCTIONS[name] = function
        return function

    return register


class Apply(Transformer, _Saved):
    """A registered function as a stage. It is saved by name and options; the loading program registers it again."""

    function: Param = Param(Params._dummy(), "function", "name of a registered function", TypeConverters.toString)
    options: Param = Param(Params._dummy(), "options", "its options, a dictionary of plain values")

    @keyword_only
    def __init__(self, *, function=None, options=None):
        super().__init__()
        self._setDefault(options={})
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name = self.getOrDefault(self.function)
        if name not in FUNCTIONS:
            raise ValueError(f"transformer {name} isn't registered")
        return FUNCTIONS[name](dataset, **self.getOrDefault(self.options))
