"""Sinks and batch helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_batches(frames: Sequence[DataFrame], strict: bool = True) -> DataFrame:
    """Vertical concat by column name.  ``strict`` requires the same
    column set (a column-count error); otherwise missing columns become NULL
    and types are widened by Spark's union coercion."""
    first = frames[0]
    out = first
    for f in frames[1:]:
        if strict and set(f.columns) != set(first.columns):
            raise ValueError(f"column mismatch: {sorted(set(f.columns) ^ set(first.columns))}")
        out = out.unionByName(f, allowMissingColumns=not strict)
    return out


def attach_ids(pred: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Put predictions next to their row ids by joining on the id carried
    through scoring (never by position)."""
    return ids.join(pred, key, "inner")


def write_predictions(df: DataFrame, path: str, id_cols: Sequence[str], mode: str = "overwrite") -> None:
    """Parquet with the id columns first."""
    rest = [c for c in df.columns if c not in id_cols]
    df.select(*id_cols, *rest).write.mode(mode).parquet(path)


def write_report(spark, path: str, succeeded: bool, error_type: int | None = None, name: str | None = None,
                 details: str | None = None) -> None:
    """One-row JSON run report; details are cut at 8,000 characters."""
    df = spark.createDataFrame([(succeeded, error_type, name, details)],
                               "Succeeded boolean, ErrorType int, ErrorName string, ErrorDetails string")
    df.withColumn("ErrorDetails", F.substring("ErrorDetails", 1, 8000)).coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Result tables as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_names(spark, names: Sequence[str], path: str) -> None:
    """A list of selected column names as JSON lines."""
    spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, position int") \
        .coalesce(1).write.mode("overwrite").json(path)


def read_names(spark, path: str) -> list[str]:
    return [r["name"] for r in spark.read.json(path).orderBy("position").collect()]


def summarize_sink(spark, path: str, col: str = "prediction") -> DataFrame:
    """Read the prediction sink back and summarise it (mean, std, min,
    max, median and four half-open bins)."""
    d = spark.read.parquet(path)
    x = F.col(col)
    return d.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                 F.max(x).alias("max"), F.median(x).alias("median"),
                 *[F.count(F.when((x >= lo) & (x < hi), 1)).alias(f"bin_{i}") for i, (lo, hi) in
                   enumerate(((0.0, 0.5), (0.5, 1.0), (1.0, 1.5), (1.5, 2.0)))])
