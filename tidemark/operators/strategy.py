"""Allocations, risk metrics and strategy tables.

Every metric is one aggregate (per model / strategy / fold key when ``by`` is
given): partial aggregation runs map-side, so only one row per key and task
crosses the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import DAYS_PER_YEAR, clip, lit_d, safe_div
from tidemark.operators.series import SeriesSpec, windowed
from tidemark.operators.windows import strict

# --- fixed values that must equal the reference ---------------------------------
# allocation bounds and the levels of the allocation rules
ALLOC_MIN, ALLOC_MAX = 0.0, 2.0
SIMPLE_UP, SIMPLE_DOWN = 1.5, 0.5
THRESHOLD = 0.003
THRESHOLD_LEVELS = (1.8, 1.3, 0.7, 0.2)   # > t, (0, t], [-t, 0), < -t ; 0 or null -> 1.0
PROPORTIONAL_LO, PROPORTIONAL_SPAN = 0.2, 1.6
SERVING_BOUNDS = (-0.02, 0.02)
README_THRESHOLD = 0.005
README_LEVELS = (1.5, 0.3, 1.0)           # > t, < -t, otherwise
ENSEMBLE_WEIGHTS = (0.4, 0.3, 0.3)
MAX_VOL_RATIO = 1.2                       # constraint of the problem statement
MAX_VOL_RATIO_EXCESS = 1.5                # constraint used by the excess-return Sharpe
# -----------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def alloc_simple(pred) -> Column:
    """> 0 -> 1.5 else 0.5; NULL -> 0.5."""
    return F.when(_c(pred) > 0, lit_d(SIMPLE_UP)).otherwise(lit_d(SIMPLE_DOWN))


def alloc_threshold(pred, t: float = THRESHOLD) -> Column:
    """Threshold rule (R6): > t 1.8; (0, t] 1.3; [-t, 0) 0.7; < -t 0.2;
    exactly 0 or NULL -> 1.0."""
    p = _c(pred)
    hi, mid_hi, mid_lo, lo = THRESHOLD_LEVELS
    return (F.when(p > lit_d(t), lit_d(hi)).when(p > 0, lit_d(mid_hi)).when(p < lit_d(-t), lit_d(lo))
            .when(p < 0, lit_d(mid_lo)).otherwise(lit_d(1.0)))


def alloc_threshold_serving(pred, t: float = THRESHOLD) -> Column:
    """Serving variant (R6b): 0 falls in 0.7 and NULL in 0.2."""
    p = _c(pred)
    hi, mid_hi, mid_lo, lo = THRESHOLD_LEVELS
    return (F.when(p > lit_d(t), lit_d(hi)).when(p > 0, lit_d(mid_hi)).when(p > lit_d(-t), lit_d(mid_lo))
            .otherwise(lit_d(lo)))


def alloc_readme(pred, t: float = README_THRESHOLD) -> Column:
    """Three-level variant (R6c): > t 1.5, < -t 0.3, else 1.0."""
    p = _c(pred)
    up, down, mid = README_LEVELS
    return F.when(p > lit_d(t), lit_d(up)).when(p < lit_d(-t), lit_d(down)).otherwise(lit_d(mid))


def alloc_fixed_bounds(pred, lo: float = SERVING_BOUNDS[0], hi: float = SERVING_BOUNDS[1]) -> Column:
    """Proportional with fixed bounds, clipped to [0, 2]."""
    v = lit_d(PROPORTIONAL_LO) + lit_d(PROPORTIONAL_SPAN) * (_c(pred) - lit_d(lo)) / lit_d(hi - lo)
    return clip(v, ALLOC_MIN, ALLOC_MAX)


def alloc_proportional(df: DataFrame, pred: str, out: str = "allocation", by: Sequence[str] = ()) -> DataFrame:
    """``0.2 + 1.6 (p - min) / (max - min)`` with min/max over the prediction
    set (per ``by`` group); a constant set gives 1.0 (R5).  The bounds are a
    one-row (per group) aggregate joined back."""
    by = list(by)
    bounds = df.groupBy(*by).agg(F.min(pred).alias("__lo"), F.max(pred).alias("__hi"))
    d = df.join(F.broadcast(bounds), by) if by else df.crossJoin(F.broadcast(bounds))
    v = F.when(F.col("__hi") > F.col("__lo"),
               lit_d(PROPORTIONAL_LO) + lit_d(PROPORTIONAL_SPAN) * (F.col(pred) - F.col("__lo"))
               / (F.col("__hi") - F.col("__lo"))).otherwise(lit_d(1.0))
    return d.withColumn(out, clip(v, ALLOC_MIN, ALLOC_MAX)).drop("__lo", "__hi")


def allocate(pred, method: str = "threshold", **kw) -> Column:
    """Dispatch for the column-level allocation rules."""
    rules = {"simple": alloc_simple, "threshold": alloc_threshold, "serving": alloc_threshold_serving,
             "readme": alloc_readme, "fixed": alloc_fixed_bounds}
    if method not in rules:
        raise ValueError(f"unknown allocation method {method!r}")
    return rules[method](pred, **kw)


def _std(c: Column, ddof: int) -> Column:
    return F.stddev_pop(c) if ddof == 0 else F.stddev_samp(c)


def sharpe(df: DataFrame, alloc, ret, rf=None, by: Sequence[str] = (), max_ratio: float = MAX_VOL_RATIO,
           periods: int = DAYS_PER_YEAR, ddof: int = 0) -> DataFrame:
    """Sharpe-type metrics (R2, R3, R3b): excess = alloc*ret - rf (rf
    optional); sharpe = mean/std*sqrt(periods) (0 when std is 0); annualised
    return and volatility; volatility ratio against ``std(ret)``; constraint
    flag ``ratio > max_ratio``; mean/std of the allocation.  Rows with a NULL
    input are left out.  One aggregate per ``by`` key."""
    a, r = _c(alloc), _c(ret)
    keep = a.isNotNull() & r.isNotNull()
    ex = a * r
    if rf is not None:
        keep = keep & _c(rf).isNotNull()
        ex = ex - _c(rf)
    d = df.filter(keep).select(*by, ex.alias("__ex"), r.alias("__r"), a.alias("__a"))
    sq = math.sqrt(periods)
    g = d.groupBy(*by).agg(
        F.avg("__ex").alias("__m"), _std(F.col("__ex"), ddof).alias("__s"),
        _std(F.col("__r"), ddof).alias("__ms"), F.avg("__a").alias("mean_allocation"),
        _std(F.col("__a"), ddof).alias("std_allocation"), F.count(F.lit(1)).alias("n_days"))
    ratio = F.when(F.col("__ms") > 0, F.col("__s") / F.col("__ms")).otherwise(lit_d(0.0))
    return g.select(
        *by,
        F.when(F.col("__s") > 0, F.col("__m") / F.col("__s") * lit_d(sq)).otherwise(lit_d(0.0)).alias("sharpe_ratio"),
        (F.col("__m") * lit_d(periods)).alias("annualized_return"),
        (F.col("__s") * lit_d(sq)).alias("annualized_volatility"),
        ratio.alias("volatility_ratio"),
        (ratio > lit_d(max_ratio)).alias("exceeds_constraint"),
        "mean_allocation", "std_allocation", "n_days")


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """rmse, mae, r2, mape (%) with rows missing truth or prediction removed;
    mape skips zero truth (R1).  One aggregate; r2 = 1 - SSE/SST."""
    d = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull() & ~F.isnan(y) & ~F.isnan(yhat))
    e = F.col(y) - F.col(yhat)
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("__sse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("__vy"),
        F.avg(F.when(F.col(y) != 0, F.abs(safe_div(e, F.col(y))))).alias("__mape"))
    return g.select(
        *by, "n", F.sqrt(F.col("__sse") / F.col("n")).alias("rmse"), "mae",
        F.when(F.col("__vy") > 0, lit_d(1.0) - F.col("__sse") / (F.col("__vy") * F.col("n"))).alias("r2"),
        (F.col("__mape") * lit_d(100.0)).alias("mape"))


def momentum_allocation(df: DataFrame, spec: SeriesSpec, col: str, n: int, lag_input: int = 1,
                        out: str = "allocation", warmup: float = 1.0) -> DataFrame:
    """Serving momentum (R8b/T1): mean of the last ``n`` values of ``col``
    seen *before* today (``lag_input=1``) -> 1.5 if > 0 else 0.5; 1.0 until
    ``n`` values exist.  ``lag_input=0`` uses today's value (the reference's
    look-ahead parity mode)."""
    def build(w):
        f = w.rowsBetween(-(n - 1) - lag_input, -lag_input)
        cnt = F.count(F.col(col)).over(f)
        m = F.avg(F.col(col)).over(f)
        return [F.when(cnt >= n, alloc_simple(m)).otherwise(lit_d(warmup)).alias(out)]

    return windowed(df, spec, build, before=n - 1 + lag_input)


def buy_hold(df: DataFrame, ret, rf, grid: Sequence[float] = (0.5, 1.0, 1.5, 2.0), **kw) -> DataFrame:
    """Constant allocations (R7): the data is joined with a small literal
    grid (one row per constant) and one Sharpe row per constant comes out."""
    spark = df.sparkSession
    g = spark.createDataFrame([(float(a),) for a in grid], "allocation double")
    return sharpe(df.crossJoin(F.broadcast(g)), "allocation", ret, rf, by=["allocation"], **kw)


def vol_strategy(df: DataFrame, spec: SeriesSpec, ret: str, n: int = 20, lag_input: int = 1,
                 out: str = "allocation") -> DataFrame:
    """Volatility strategy (R9): strict rolling std (ddof 1) of ``ret`` over
    ``n`` rows, z-scored with the mean and sample std of that column over
    the whole set, allocation ``clip(1.5 - 0.5 z, 0.2, 2)``; rows without a
    rolling value are dropped.  The rolling std ends at the row before
    (``lag_input=1``) or, with 0, at the row itself, whose return is not known
    yet where ``ret`` looks forward."""
    src = F.col(ret)
    d = windowed(df, spec, lambda w: [
        (F.lag(F.col(ret), lag_input).over(w) if lag_input else src).alias("__src")], before=lag_input) \
        if lag_input else df.withColumn("__src", src)
    d = windowed(d, spec, lambda w: [strict("std", "__src", w, n).alias("rolling_vol")], before=n - 1)
    d = d.filter(F.col("rolling_vol").isNotNull())
    st = d.agg(F.avg("rolling_vol").alias("__vm"), F.stddev_samp("rolling_vol").alias("__vs"))
    d = d.crossJoin(F.broadcast(st))  # one row
    z = F.try_divide(F.col("rolling_vol") - F.col("__vm"), F.col("__vs"))
    return d.withColumn(out, clip(lit_d(1.5) - lit_d(0.5) * z, 0.2, 2.0)).drop("__src", "__vm", "__vs")


def vol_cap(alloc, est_vol, market_vol, max_ratio: float = MAX_VOL_RATIO) -> Column:
    """Scale the allocation down when ``alloc * est / market`` exceeds the
    cap, then clip to [0, 2] (R10)."""
    a, e, m = _c(alloc), _c(est_vol), _c(market_vol)
    implied = safe_div(a * e, m)
    scaled = F.when(implied > lit_d(max_ratio), a * lit_d(max_ratio) * safe_div(m, a * e)).otherwise(a)
    return clip(scaled, ALLOC_MIN, ALLOC_MAX)


def leaderboard(frames: dict[str, DataFrame], metric: str = "sharpe_ratio", base: str | None = None) -> DataFrame:
    """Union the one-row metric frames under a ``strategy`` name, rank them by
    ``metric`` (descending) and add the improvement in percent over ``base``
    (R11, K4)."""
    parts = [f.select(F.lit(name).alias("strategy"), *f.columns) for name, f in frames.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    w = Window.orderBy(F.col(metric).desc(), F.col("strategy"))  # tiny table: one row per strategy
    u = u.withColumn("rank", F.row_number().over(w))
    if base is not None:
        b = u.filter(F.col("strategy") == base).select(F.col(metric).alias("__b"))
        u = u.crossJoin(F.broadcast(b)).withColumn(
            "improvement_pct", safe_div((F.col(metric) - F.col("__b")) * lit_d(100.0), F.abs(F.col("__b")))).drop("__b")
    return u


def ensemble(cols: Sequence[str], weights: Sequence[float] = ENSEMBLE_WEIGHTS) -> Column:
    """Weighted sum of prediction columns (ML8)."""
    e = None
    for c, w in zip(cols, weights):
        t = lit_d(w) * F.col(c)
        e = t if e is None else e + t
    return e
