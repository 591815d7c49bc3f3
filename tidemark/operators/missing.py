"""Missing-data handling (M1-M8) as fitted estimators.

``fit`` runs one aggregate (null share and median of every column, long form)
and keeps that small table on the driver (one row per column); ``transform``
is a pure projection, so the fitted medians of the training frame can be
applied to any later frame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import null_if_nonfinite
from tidemark.operators.profile import _long, null_profile, quantiles


def fit_stats(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """M1: per column median, mean, null count and null percent (one
    aggregate, long form).  ``approx`` uses ``percentile_approx``."""
    med = (lambda c: F.percentile_approx(c, 0.5, 10000)) if approx else (lambda c: F.median(c))
    stats = {
        "median": lambda c: med(null_if_nonfinite(c.cast("double"))),
        "mean": lambda c: F.avg(null_if_nonfinite(c.cast("double"))),
        "null_count": lambda c: F.sum(c.isNull().cast("long")),
        "n": lambda c: F.count(F.lit(1)),
    }
    out = _long(df, cols, stats)
    return out.select("column", "median", "mean", "null_count",
                      (F.col("null_count") * 100.0 / F.col("n")).alias("null_pct"))


@dataclass
class MedianImputerModel:
    drop: list[str]
    medians: dict[str, float]
    keep: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """M3-M5: drop the sparse columns, turn +-Inf/NaN into NULL, fill
        with the fitted medians."""
        out = []
        for c in df.columns:
            if c in self.drop:
                continue
            if c in self.medians:
                v = self.medians[c]
                e = null_if_nonfinite(F.col(c).cast("double"))
                out.append((F.coalesce(e, F.lit(v).cast("double")) if v is not None else e).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)


@dataclass
class MedianImputer:
    """Drop columns whose null share is strictly above ``max_null`` (measured
    before Inf -> NULL), then fill the rest with their median (M1-M5)."""

    max_null: float = 0.3
    approx: bool = False
    exclude: Sequence[str] = ()
    by_rank: bool = False  # medians from numbered ranges (``profile.quantiles``): the same values, no column in one buffer

    def fit(self, df: DataFrame, cols: Sequence[str] | None = None) -> MedianImputerModel:
        from pyspark.sql import types as T

        num = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.DecimalType)
        cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, num)
                             and f.name not in self.exclude])
        if self.by_rank:
            clean = df.select(*[null_if_nonfinite(F.col(c).cast("double")).alias(c) for c in cols])
            mid = {r["column"]: r["value"] for r in quantiles(clean, cols, [0.5]).collect()}  # one row per column
            rows = [{"column": r["column"], "null_pct": r["null_pct"], "median": mid.get(r["column"])} for r in null_profile(df, cols).collect()]
        else:
            rows = fit_stats(df, cols, self.approx).collect()  # one row per column
        drop = [r["column"] for r in rows if r["null_pct"] > self.max_null * 100.0]
        med = {r["column"]: r["median"] for r in rows if r["column"] not in drop}
        return MedianImputerModel(drop=drop, medians=med, keep=[c for c in cols if c not in drop])


def sparse_columns(stats: DataFrame, max_null: float = 0.3) -> DataFrame:
    """M2: columns whose null share is above the limit."""
    return stats.filter(F.col("null_pct") > max_null * 100.0)


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M6: NULL -> 0 before training or scaling."""
    return df.fillna(0.0, subset=list(cols))


def missing_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M8: 0/1 missingness indicators for the columns that have nulls."""
    return df.select(*[c for c in df.columns if c not in cols],
                     *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in cols])
