"""Reports put together from profiles and run logs (E3, E4, E9, E10, A11, A17,
K5, P5, P10, R9b, R13, R15).

A *run log* holds one row per model and scored row: ``model, y, yhat, ret, rf``
and, per model, its type and seconds.  Every table here is one aggregate of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import bias_corrected_skew, lit_d, safe_corr, safe_div
from tidemark.operators.profile import corr_matrix, describe_long, family_of, null_profile
from tidemark.operators.series import SeriesSpec, windowed
from tidemark.operators.strategy import MAX_VOL_RATIO, regression_metrics, sharpe

# --- fixed values: limits of the insight flags and levels of the two-level rule ------------
SKEWED, MANY_PAIRS, DEPENDENT, CLUSTERED = 0.5, 10, 0.1, 0.3
ALIKE, OUTLYING = 0.8, 3.0
TWO_LEVELS = (0.5, 1.5)  # above the threshold, otherwise
# ------------------------------------------------------------------------------------------------


def schema_profile(df: DataFrame, id_col: str) -> DataFrame:
    """One row: columns in all and of each kind, rows, least and greatest
    id, and how many ids a dense range would hold.  A null id counts as a row."""
    kinds = [f.dataType.typeName() for f in df.schema.fields]
    whole = sum(k in ("byte", "short", "integer", "long") for k in kinds)
    real = sum(k in ("float", "double") or k.startswith("decimal") for k in kinds)
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(id_col).alias("id_min"), F.max(id_col).alias("id_max"))
    return agg.select(F.lit(len(kinds)).cast("long").alias("n_columns"), F.lit(whole).cast("long").alias("n_integer"), F.lit(real).cast("long").alias("n_real"),
                      F.lit(len(kinds) - whole - real).cast("long").alias("n_other"), "n_rows", "id_min", "id_max", (F.col("id_max") - F.col("id_min") + 1).alias("id_range"))


def preview(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """P10: the first and last ``n`` rows, marked ``first`` and ``last`` in
    column ``part``; each partition keeps ``n`` rows, there is no full sort.
    Rows of a short table are in both parts."""
    up, down = [F.col(c).asc_nulls_first() for c in order], [F.col(c).desc_nulls_last() for c in order]
    return df.orderBy(*up).limit(n).withColumn("part", F.lit("first")).union(df.orderBy(*down).limit(n).withColumn("part", F.lit("last")))


def batch_rows(df: DataFrame, batch: str, value) -> DataFrame:
    """P5: the rows of one batch id (null: those without); the filter reaches
    the scan."""
    return df.where(F.col(batch).isNull() if value is None else F.col(batch) == F.lit(value))


def family_describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column family (the letters before the number) how many columns
    it has and the range of their means, deviations, minima and maxima."""
    stats = describe_long(df, cols, approx=True).withColumn("family", family_of(F.col("column")))
    return stats.groupBy("family").agg(F.count(F.lit(1)).alias("n_columns"), *[f(c).alias(f"{n}_{c}") for c in ("mean", "std") for n, f in (("min", F.min), ("max", F.max))],
                                       F.min("min").alias("least"), F.max("max").alias("greatest"))


def complete_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per family its columns, those without a null, and the mean
    percent of nulls."""
    nulls = null_profile(df, cols).withColumn("family", family_of(F.col("column")))
    return nulls.groupBy("family").agg(F.count(F.lit(1)).alias("n_columns"), F.sum((F.col("null_count") == 0).cast("long")).alias("n_complete"), F.avg("null_pct").alias("null_pct"))


def component_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per component of the target: count, mean, std, min, max and the
    share of positive values."""
    aggs = [x for i, c in enumerate(cols) for x in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"),
                                                     F.sum((F.col(c) > 0).cast("long")).alias(f"p{i}"))]
    rows = ", ".join(f"'{c}', n{i}, m{i}, s{i}, l{i}, h{i}, p{i}" for i, c in enumerate(cols))
    long = df.agg(*aggs).selectExpr(f"stack({len(cols)}, {rows}) AS (component, count, mean, std, min, max, n_positive)")
    return long.withColumn("positive_share", safe_div(F.col("n_positive").cast("double"), F.col("count").cast("double")))


def insight_flags(df: DataFrame, spec: SeriesSpec, target: str, features: Sequence[str]) -> DataFrame:
    """One row of what stands out in a table: percent of null cells; skew,
    outliers and positive share of the target; the feature most correlated with
    it; pairs of features alike; dependence on the day before, of values and of
    their size; and the flags that follow."""
    x = F.col(target)
    lagged = windowed(df, spec, lambda w: [F.lag(target, 1).over(w).alias("__prev")], before=1)
    mid = df.agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s"))
    cells = [F.sum(F.col(c).isNull().cast("long")) for c in [target, *features]]
    nulls = cells[0]
    for c in cells[1:]:
        nulls = nulls + c
    one = lagged.crossJoin(F.broadcast(mid)).agg(  # one row
        F.count(x).alias("n"), (nulls * lit_d(100.0) / (F.count(F.lit(1)) * len(cells))).alias("null_pct"), F.skewness(x).alias("__g1"),
        F.sum((F.abs(F.try_divide(x - F.col("__m"), F.col("__s"))) > lit_d(OUTLYING)).cast("long")).alias("n_outliers"),
        (F.sum((x > 0).cast("long")) * lit_d(100.0) / F.count(x)).alias("positive_pct"),
        safe_corr(target, "__prev").alias("autocorr"), safe_corr(F.abs(x), F.abs("__prev")).alias("vol_autocorr"),
        *[safe_corr(F.col(c).cast("double"), x).alias(f"__c{i}") for i, c in enumerate(features)])
    best = F.array_max(F.array(*[F.struct(F.coalesce(F.abs(f"__c{i}"), lit_d(-1.0)).alias("r"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(features)]))
    alike = corr_matrix(df, features).agg(F.sum((F.abs("corr") > lit_d(ALIKE)).cast("long")).alias("n_alike"))
    skew = bias_corrected_skew(F.col("__g1"), F.col("n"))
    return one.crossJoin(F.broadcast(alike)).select(  # one row each
        "n", "null_pct", skew.alias("skew"), "n_outliers", "positive_pct", best["c"].alias("best_feature"), best["r"].alias("best_corr"), "n_alike", "autocorr", "vol_autocorr",
        (F.abs(skew) > lit_d(SKEWED)).alias("skewed"), (F.col("n_alike") > MANY_PAIRS).alias("collinear"),
        (F.abs("autocorr") > lit_d(DEPENDENT)).alias("dependent"), (F.col("vol_autocorr") > lit_d(CLUSTERED)).alias("clustered"))


# --- model comparison (R15, A11, K5) -----------------------------------------------------------------
def model_table(log: DataFrame, runs: DataFrame, allocation: Column) -> DataFrame:
    """Per model of the run log its type, rows, rmse, mae, r2, Sharpe ratio
    of ``allocation`` (an expression over ``yhat``), annual return and volatility
    in percent, volatility ratio, constraint and seconds, ranked by Sharpe ratio
    (ties by name).  ``runs``: ``model, type, seconds``, one row a model."""
    fit = regression_metrics(log, "y", "yhat", by=["model"]).drop("mape")
    risk = sharpe(log.withColumn("__a", allocation), "__a", "ret", "rf", by=["model"])
    risk = risk.select("model", "sharpe_ratio", (F.col("annualized_return") * 100).alias("return_pct"), (F.col("annualized_volatility") * 100).alias("volatility_pct"),
                       "volatility_ratio", "exceeds_constraint")
    table = runs.join(fit, "model", "left").join(risk, "model", "left")
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("sharpe_ratio"), F.col("model"))))  # a row a model


def top_per_type(table: DataFrame) -> DataFrame:
    """K5: the best model of each type by Sharpe ratio (ties by name)."""
    best = table.groupBy("type").agg(F.min_by(F.struct("model", "sharpe_ratio", "r2", "seconds"), "rank").alias("b"))
    return best.select("type", "b.model", "b.sharpe_ratio", "b.r2", "b.seconds")


def type_stats(table: DataFrame) -> DataFrame:
    """Per type its models, mean and deviation of the Sharpe ratio, mean r2
    and mean seconds."""
    return table.groupBy("type").agg(F.count(F.lit(1)).alias("n_models"), F.avg("sharpe_ratio").alias("mean_sharpe"), F.stddev_samp("sharpe_ratio").alias("std_sharpe"),
                                     F.avg("r2").alias("mean_r2"), F.avg("seconds").alias("mean_seconds"))


def by_model(df: DataFrame, predictions: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """A run log from a table with one prediction column per model: ``model,
    yhat`` and the columns ``keep``."""
    pairs = ", ".join(f"'{m}', `{c}`" for m, c in predictions.items())
    return df.selectExpr(*keep, f"stack({len(predictions)}, {pairs}) AS (model, yhat)")


# --- rules and scores -----------------------------------------------------------------------------------
def alloc_two_level(volatility, threshold: float) -> Column:
    """0.5 above the volatility threshold, else 1.5; null is not above."""
    v = F.col(volatility) if isinstance(volatility, str) else volatility
    return F.when(v > lit_d(threshold), lit_d(TWO_LEVELS[0])).otherwise(lit_d(TWO_LEVELS[1]))


def penalised_score(df: DataFrame, alloc: str, ret: str, by: Sequence[str] = (), max_ratio: float = MAX_VOL_RATIO) -> DataFrame:
    """(mean strategy return - mean market return) / strategy deviation,
    annualised, with the two conditions that are penalised: more volatility than
    ``max_ratio`` times the market's and less return than the market.  A penalty
    takes the excess over the limit off the score: the ratio's, and the shortfall
    in strategy deviations (the published formula names no amount)."""
    d = df.where(F.col(alloc).isNotNull() & F.col(ret).isNotNull()).select(*by, (F.col(alloc) * F.col(ret)).alias("__s"), F.col(ret).alias("__r"))
    g = d.groupBy(*by).agg(F.avg("__s").alias("ms"), F.avg("__r").alias("mr"), F.stddev_pop("__s").alias("ss"), F.stddev_pop("__r").alias("sr"), F.count(F.lit(1)).alias("n"))
    raw = safe_div((F.col("ms") - F.col("mr")) * lit_d(252.0 ** 0.5), F.col("ss"))
    ratio = safe_div(F.col("ss"), F.col("sr"))
    over, under = F.coalesce(ratio > lit_d(max_ratio), F.lit(False)), F.col("ms") < F.col("mr")
    score = raw - F.when(over, ratio - lit_d(max_ratio)).otherwise(lit_d(0.0)) - F.when(under, F.abs(raw)).otherwise(lit_d(0.0))
    return g.select(*by, "n", raw.alias("raw_score"), ratio.alias("volatility_ratio"), over.alias("too_volatile"), under.alias("underperforms"), score.alias("score"))
