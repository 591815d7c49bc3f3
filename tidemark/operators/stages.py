"""Pipeline stages of our own: imputer, scaler and column selector as Spark ML
estimators that save and load (UD4, S9, M5, L1, L5).

What a stage learns (a number or name per column) is kept in params, so the
fitted pipeline is written with ``pipeline.write().save(path)`` like any other
and scores alike in another session.  Any ``pyspark.ml`` estimator can follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import null_if_nonfinite
from tidemark.operators.missing import MedianImputer
from tidemark.operators.select import feature_scores


class _Learned(Params):
    """Names and numbers that a stage has learned, one per column."""

    names = Param(Params._dummy(), "names", "columns", TypeConverters.toListString)
    centers = Param(Params._dummy(), "centers", "a value per column", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "a divisor per column", TypeConverters.toListFloat)


class _Stage(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    def _checked(self, df: DataFrame) -> list[str]:
        cols = list(self.getInputCols())
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"no columns {missing}")
        return cols


def _replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


class FillMedian(Estimator, _Stage):
    """Nulls, NaN and infinities become the median of the training rows; a
    column without any value becomes 0."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "FillMedianModel":
        cols = self._checked(df)
        fitted = MedianImputer(max_null=1.0).fit(df, cols)
        return FillMedianModel()._set(inputCols=cols, names=cols, centers=[fitted.medians.get(c) or 0.0 for c in cols])


class FillMedianModel(Model, _Stage, _Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        self._checked(df)
        return _replaced(df, {c: F.coalesce(null_if_nonfinite(F.col(c).cast("double")), F.lit(m)) for c, m in zip(self.getOrDefault("names"), self.getOrDefault("centers"), strict=True)})


class ScaleColumns(Estimator, _Stage):
    """Columns minus the mean of the training rows, over their population
    standard deviation (1 where that is 0); nulls stay null."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ScaleColumnsModel":
        cols = self._checked(df)
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()  # one row
        return ScaleColumnsModel()._set(inputCols=cols, names=cols, centers=[row[f"m{i}"] or 0.0 for i in range(len(cols))], scales=[row[f"s{i}"] or 1.0 for i in range(len(cols))])


class ScaleColumnsModel(Model, _Stage, _Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        self._checked(df)
        parts = zip(*(self.getOrDefault(p) for p in ("names", "centers", "scales")), strict=True)
        return _replaced(df, {c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in parts})


class SelectColumns(Estimator, _Stage, HasLabelCol):
    """Keeps the ``most`` input columns with the best score against the label
    (``method`` of ``select.feature_scores``) and drops the other input columns;
    columns that are no input stay."""

    most = Param(Params._dummy(), "most", "how many input columns to keep", TypeConverters.toInt)
    method = Param(Params._dummy(), "method", "score", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, labelCol: str = "label", most: int = 10, method: str = "correlation"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(most=10, method="correlation")

    def _fit(self, df: DataFrame) -> "SelectColumnsModel":
        cols, k = self._checked(df), self.getOrDefault("most")
        ranked = feature_scores(df, cols, self.getLabelCol(), self.getOrDefault("method")).where(F.col("rank") <= k).orderBy("rank")
        return SelectColumnsModel()._set(inputCols=cols, names=[r["column"] for r in ranked.collect()])  # at most ``most`` rows


class SelectColumnsModel(Model, _Stage, _Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        kept = set(self.getOrDefault("names"))
        return df.drop(*[c for c in self._checked(df) if c not in kept])


class AssembleDoubles(Model, _Stage):
    """The input columns that are there as one vector ``features``; follows a
    selector, whose choice is not known when the pipeline is put together."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        there = [c for c in self.getInputCols() if c in df.columns]
        return VectorAssembler(inputCols=there, outputCol="features", handleInvalid="keep").transform(df)


def numeric_inputs(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def prepared(cols: Sequence[str], label: str, estimator, most: int | None = None, method: str = "correlation") -> Pipeline:
    """UD4: a pipeline that fills, selects (``most`` columns) and scales, then
    fits ``estimator``, any estimator that reads ``features``."""
    stages = [FillMedian(inputCols=list(cols))]
    if most is not None:
        stages.append(SelectColumns(inputCols=list(cols), labelCol=label, most=most, method=method))
    else:
        stages.append(ScaleColumns(inputCols=list(cols)))
    return Pipeline(stages=[*stages, AssembleDoubles(inputCols=list(cols)), estimator])
