"""Time-ordered splits and validation folds.

Folds are a small table (k rows) joined to the data with a range condition
on the series position; the data is never copied per fold on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import SeriesSpec, attach_length, ensure_index


def ordered_split(df: DataFrame, spec: SeriesSpec, frac: float = 0.8, name: str = "split") -> DataFrame:
    """V2: rows before ``floor(n * frac)`` (per series) are 'train', the rest
    'test'."""
    d, ri, added = ensure_index(df, spec)
    d = attach_length(d, spec, ri)
    cut = F.floor(F.col("_n") * F.lit(frac))
    d = d.withColumn(name, F.when(F.col(ri) < cut, F.lit("train")).otherwise(F.lit("test"))).drop("_n")
    return d.drop(ri) if added else d


def fold_table(spark, k: int) -> DataFrame:
    return spark.range(k).select(F.col("id").alias("fold"))


def walk_forward(df: DataFrame, spec: SeriesSpec, k: int = 5, name: str = "role") -> DataFrame:
    """V3: expanding walk-forward.  ``test = n // (k+1)``;
    ``train_end = (fold+1) * test + n - (k+1) * test``; train rows are
    ``[0, train_end)``, test rows ``[train_end, train_end + test)``.  Each
    row appears once per fold it belongs to, tagged with its role."""
    d, ri, added = ensure_index(df, spec)
    d = attach_length(d, spec, ri)
    folds = F.broadcast(fold_table(df.sparkSession, k))  # k rows
    t = F.floor(F.col("_n") / (k + 1))
    train_end = (F.col("fold") + 1) * t + F.col("_n") - (k + 1) * t
    test_end = F.least(train_end + t, F.col("_n"))
    j = d.join(folds, F.col(ri) < test_end)
    j = j.withColumn(name, F.when(F.col(ri) < train_end, F.lit("train")).otherwise(F.lit("test"))).drop("_n")
    return j.drop(ri) if added else j


def walk_lookback(df: DataFrame, spec: SeriesSpec, lookback: int, start: int, step: int = 1,
                  name: str = "role") -> DataFrame:
    """V4: rolling-lookback walk-forward: for each scored position
    ``i = start, start+step, ...`` the train window is ``[i - lookback, i)``
    and the test row is ``i``.  Expressed as a range join of each row to the
    folds whose window covers it (a row belongs to at most
    ``ceil((lookback+1)/step)`` folds)."""
    d, ri, added = ensure_index(df, spec)
    # fold index f scores position start + f*step; row r is in fold f when
    # start + f*step - lookback <= r <= start + f*step
    lo_f = F.greatest(F.ceil((F.col(ri) - start) / step), F.lit(0))
    hi_f = F.floor((F.col(ri) - start + lookback) / step)
    d = d.filter(hi_f >= lo_f).withColumn("fold", F.explode(F.sequence(lo_f.cast("long"), hi_f.cast("long"))))
    d = d.filter(F.col("fold") >= 0)
    test_pos = F.lit(start) + F.col("fold") * step
    d = d.withColumn(name, F.when(F.col(ri) == test_pos, F.lit("test")).otherwise(F.lit("train")))
    # drop folds whose test row does not exist (past the end of the series)
    last = d.groupBy(*spec.keys).agg(F.max(ri).alias("__last"))
    d = (d.join(last, spec.keys) if spec.keys else d.crossJoin(F.broadcast(last)))
    d = d.filter(test_pos <= F.col("__last")).drop("__last")
    return d.drop(ri) if added else d
