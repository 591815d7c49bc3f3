"""Feature selection and scaling.

Scores for all columns come from one aggregate in long form; the ranking is
a ``row_number`` over that small table (one row per column).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import lit_d
from tidemark.operators.profile import _long, corr_with

METHODS = ("correlation", "variance", "mutual_info")


def _position(cols: Sequence[str]):
    return F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])


def rank_scores(scores: DataFrame, cols: Sequence[str], score: str, absolute: bool = False) -> DataFrame:
    """Rank columns by score (descending, |score| when ``absolute``), ties in
    column order, like a stable sort; NULL scores last."""
    key = F.abs(F.col(score)) if absolute else F.col(score)
    w = Window.orderBy(key.desc_nulls_last(), _position(cols)[F.col("column")])  # one row per column
    return scores.withColumn("rank", F.row_number().over(w).cast("long"))


def variance_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """L2: sample variance of every column."""
    return _long(df, cols, {"variance": lambda c: F.var_samp(c.cast("double"))})


def mutual_info_scores(df: DataFrame, cols: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """L3 (re-aimed): mutual information between quantile-binned column and
    target, nulls -> 0 first.  Cut points are exact deciles from one
    aggregate; bin = number of cut points below the value.  Counts per
    (column, bx, by) come from one group-by over the unpivoted table."""
    probs = [i / bins for i in range(1, bins)]
    z = lambda c: F.coalesce(F.col(c).cast("double"), lit_d(0.0))
    d = df.select(*[z(c).alias(c) for c in cols], z(target).alias("__y"))
    cuts = d.agg(*[F.percentile(c, probs).alias(f"q_{c}") for c in cols], F.percentile("__y", probs).alias("q__y"))
    d = d.crossJoin(F.broadcast(cuts))  # one row
    rows = ", ".join(f"'{c}', `{c}`, `q_{c}`" for c in cols)
    long = d.selectExpr("__y", "q__y", f"stack({len(cols)}, {rows}) as (column, x, qx)")
    long = long.select("column", F.size(F.filter("qx", lambda q: q < F.col("x"))).alias("bx"),
                       F.size(F.filter("q__y", lambda q: q < F.col("__y"))).alias("by"))
    joint = long.groupBy("column", "bx", "by").agg(F.count(F.lit(1)).alias("nxy"))
    wc = Window.partitionBy("column")
    joint = joint.select("column", "nxy", F.sum("nxy").over(wc).alias("n"),
                         F.sum("nxy").over(wc.partitionBy("column", "bx")).alias("nx"),
                         F.sum("nxy").over(wc.partitionBy("column", "by")).alias("ny"))
    nxy, n, nx, ny = (F.col(c).cast("double") for c in ("nxy", "n", "nx", "ny"))  # products of counts pass the BIGINT range
    term = nxy / n * F.log(nxy * n / (nx * ny))
    return joint.groupBy("column").agg(F.sum(term).alias("mutual_info"))


def feature_scores(df: DataFrame, cols: Sequence[str], target: str, method: str = "correlation",
                   min_pairs: int = 100) -> DataFrame:
    """Scores for ``method`` with rank (L1-L3).  Unknown methods raise before
    any job runs (L4)."""
    if method not in METHODS:
        raise ValueError(f"unknown selection method {method!r}")
    if method == "correlation":
        s = corr_with(df, cols, target, min_pairs).select("column", F.col("corr").alias("score"))
        return rank_scores(s, cols, "score", absolute=True)
    if method == "variance":
        return rank_scores(variance_scores(df, cols).withColumnRenamed("variance", "score"), cols, "score")
    s = mutual_info_scores(df, cols, target).withColumnRenamed("mutual_info", "score")
    return rank_scores(s, cols, "score")


def select_features(df: DataFrame, target: str, method: str = "correlation", n: int | None = None,
                    prefix: str = "feat_", min_pairs: int = 100) -> list[str]:
    """L1: the names of the top ``n`` columns starting with ``prefix``
    (default n = min(150, rows)); returns a driver-side list (one row per
    selected column)."""
    if method not in METHODS:
        raise ValueError(f"unknown selection method {method!r}")
    cols = [c for c in df.columns if c.startswith(prefix) and c != target]
    if n is None:
        n = min(150, df.count())
    ranked = feature_scores(df, cols, target, method, min_pairs)
    return [r["column"] for r in ranked.filter(F.col("rank") <= n).orderBy("rank").collect()]


def union_selected(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Columns in the top ``n`` of either ranking (distinct)."""
    return (a.filter(F.col("rank") <= n).select("column")
            .union(b.filter(F.col("rank") <= n).select("column")).distinct())


@dataclass
class ScalerModel:
    means: dict[str, float]
    stds: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.means:
                s = self.stds[c] if self.stds[c] not in (None, 0.0) else 1.0
                x = F.coalesce(F.col(c).cast("double"), lit_d(0.0))
                out.append(((x - lit_d(self.means[c] or 0.0)) / lit_d(s)).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)


@dataclass
class Scaler:
    """Standardise with the train frame's mean and *population* std after
    NULL -> 0; zero std divides by 1."""

    def fit(self, df: DataFrame, cols: Sequence[str]) -> ScalerModel:
        z = lambda c: F.coalesce(F.col(c).cast("double"), lit_d(0.0))
        row = df.agg(*[e for c in cols for e in (F.avg(z(c)).alias(f"m_{c}"), F.stddev_pop(z(c)).alias(f"s_{c}"))]).first()
        return ScalerModel({c: row[f"m_{c}"] for c in cols}, {c: row[f"s_{c}"] for c in cols})
