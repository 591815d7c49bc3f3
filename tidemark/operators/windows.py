"""Window operators over ordered series.

Expression builders take a ``WindowSpec`` ordered by series position (from
``series.windowed``) and return Columns, so many features share one Window
node, one shuffle and one sort.  DataFrame-level wrappers pick the halo.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import safe_corr, EPS, bias_corrected_kurt, bias_corrected_skew, flag, lit_d, safe_div
from tidemark.operators.series import SeriesSpec, ensure_index, ffill, prefix_sum, windowed, with_row_index

STATS = ("mean", "std", "max", "min", "skew", "kurt")


def frame(w: WindowSpec, n: int) -> WindowSpec:
    """``ROWS n-1 PRECEDING .. CURRENT ROW``."""
    return w.rowsBetween(-(n - 1), 0)


def roll(stat: str, x, w: WindowSpec, n: int, min_periods: int = 1) -> Column:
    """Rolling statistic over the last ``n`` rows with at least
    ``min_periods`` non-null values (pandas ``rolling(n, min_periods)``).

    skew/kurt are bias-corrected (need 3/4 values) and give 0 / -3 on a
    constant window, like pandas.
    """
    c = F.col(x) if isinstance(x, str) else x
    f = frame(w, n)
    cnt = F.count(c).over(f)
    if stat == "mean":
        e = F.avg(c).over(f)
    elif stat == "std":
        e = F.stddev_samp(c).over(f)
    elif stat == "var":
        e = F.var_samp(c).over(f)
    elif stat == "max":
        e = F.max(c).over(f)
    elif stat == "min":
        e = F.min(c).over(f)
    elif stat == "sum":
        e = F.sum(c).over(f)
    elif stat == "skew":
        const = F.max(c).over(f) == F.min(c).over(f)
        e = F.when(cnt < 3, None).when(const, lit_d(0.0)).otherwise(bias_corrected_skew(F.skewness(c).over(f), cnt))
    elif stat == "kurt":
        const = F.max(c).over(f) == F.min(c).over(f)
        e = F.when(cnt < 4, None).when(const, lit_d(-3.0)).otherwise(bias_corrected_kurt(F.kurtosis(c).over(f), cnt))
    else:
        raise ValueError(f"unknown rolling statistic {stat!r}")
    return F.when(cnt >= F.lit(min_periods), e)


def strict(stat: str, x, w: WindowSpec, n: int) -> Column:
    """Rolling statistic that needs a full window (``min_periods = n``)."""
    return roll(stat, x, w, n, min_periods=n)


def rolling(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], windows: Sequence[int],
            stats: Sequence[str] = STATS, min_periods: int | None = 1,
            name: str = "{col}_rolling_{stat}_{n}") -> DataFrame:
    """Rolling statistics for every (column, window, stat) in one pass
    (W5-W10).  ``min_periods=None`` means strict (full window)."""

    def build(w):
        out = []
        for c in cols:
            for n in windows:
                for s in stats:
                    mp = n if min_periods is None else min_periods
                    out.append(roll(s, c, w, n, mp).alias(name.format(col=c, stat=s, n=n)))
        return out

    return windowed(df, spec, build, before=max(windows) - 1)


def lag_features(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], lags: Sequence[int],
                 name: str = "{col}_lag{k}") -> DataFrame:
    """``lag(c, k)`` for each column and lag."""
    return windowed(df, spec, lambda w: [F.lag(c, k).over(w).alias(name.format(col=c, k=k))
                                         for c in cols for k in lags], before=max(lags))


def diff(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], k: int = 1, name: str = "{col}_diff") -> DataFrame:
    """``c - lag(c, k)``."""
    return windowed(df, spec, lambda w: [(F.col(c) - F.lag(c, k).over(w)).alias(name.format(col=c))
                                         for c in cols], before=k)


def pct_change(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], k: int = 1, fill: bool = True,
               name: str = "{col}_pct{k}") -> DataFrame:
    """``x / lag(x, k) - 1`` (W4).  With ``fill`` nulls are forward-filled
    first (pandas' default); a zero base gives NULL instead of +-Inf."""
    src = df
    use = {c: c for c in cols}
    if fill:
        src = ffill(df, spec, cols, suffix="__ff")
        use = {c: c + "__ff" for c in cols}
    out = windowed(src, spec, lambda w: [(safe_div(F.col(use[c]), F.lag(use[c], k).over(w)) - 1)
                                         .alias(name.format(col=c, k=k)) for c in cols], before=k)
    return out.drop(*[v for v in use.values() if v not in cols])


def pct_rank_expr(x, w: WindowSpec, n: int, min_periods: int) -> Column:
    """Percentile rank of the current value among the last ``n`` values,
    average ties (``rolling(n, min_periods).rank(pct=True)``) (W11).
    Only the value column enters the frame list, so memory is O(n) per row."""
    c = F.col(x) if isinstance(x, str) else x
    lst = F.collect_list(c).over(frame(w, n))
    lt = F.size(F.filter(lst, lambda v: v < c))
    eq = F.size(F.filter(lst, lambda v: v == c))
    k = F.size(lst)
    return F.when(c.isNotNull() & (k >= F.lit(min_periods)), (lt + (eq + 1) / 2.0) / k)


def rsi_expr(delta: Column, w: WindowSpec, n: int) -> Column:
    """RSI from a first difference: plain (not Wilder) rolling means of
    gains and losses over a full window (W13).  Null deltas count as zero
    gain and zero loss; loss 0 with gain > 0 gives 100; gain 0 with loss > 0
    gives 0; both 0 gives NULL."""
    gain = F.coalesce(F.greatest(delta, lit_d(0.0)), lit_d(0.0))
    loss = F.coalesce(F.greatest(-delta, lit_d(0.0)), lit_d(0.0))
    f = frame(w, n)
    full = F.count(F.lit(1)).over(f) >= F.lit(n)
    g = F.avg(gain).over(f)
    lo = F.avg(loss).over(f)
    val = (F.when(lo > 0, lit_d(100.0) - lit_d(100.0) / (lit_d(1.0) + g / lo))
           .when(g > 0, lit_d(100.0)))
    return F.when(full, val)


def rsi(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], windows: Sequence[int] = (7, 14, 21),
        name: str = "{col}_rsi_{n}") -> DataFrame:
    """RSI for several columns and windows (W13); needs the diff first."""
    d = diff(df, spec, cols, 1, name="{col}__d")
    out = windowed(d, spec, lambda w: [rsi_expr(F.col(f"{c}__d"), w, n).alias(name.format(col=c, n=n))
                                       for c in cols for n in windows], before=max(windows) - 1)
    return out.drop(*[f"{c}__d" for c in cols])


def zscore_expr(x, w: WindowSpec, n: int = 20, eps: float = EPS) -> Column:
    """``(x - mean_n) / (std_n + eps)`` with ``min_periods=1``."""
    c = F.col(x) if isinstance(x, str) else x
    return (c - roll("mean", c, w, n)) / (roll("std", c, w, n) + lit_d(eps))


def reversion_expr(x, w: WindowSpec, n: int = 20) -> Column:
    """``x - mean_n``."""
    c = F.col(x) if isinstance(x, str) else x
    return c - roll("mean", c, w, n)


def acf(df: DataFrame, spec: SeriesSpec, col: str, lags: Iterable[int], of: str = "x") -> DataFrame:
    """Autocorrelation ``corr(x, lag(x, k))`` for each lag (pairwise
    complete), plus the +-1.96/sqrt(n) band (W18-W20).  ``of='abs'`` uses
    ``|x|``.  All lags share one Window node and one aggregate; the result is
    unpivoted to ``(lag, acf, bound)``, for each key of a keyed spec with the
    band of its own length."""
    lags = list(lags)
    base = F.abs(F.col(col)) if of == "abs" else F.col(col)
    d = df.withColumn("__x", base)
    d = windowed(d, spec, lambda w: [F.lag("__x", k).over(w).alias(f"__l{k}") for k in lags], before=max(lags))
    aggs = [safe_corr("__x", f"__l{k}").alias(f"c{k}") for k in lags]
    wide = d.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("__n"), *aggs)
    stack = ", ".join(f"{k}, c{k}" for k in lags)
    return wide.selectExpr(*spec.key, "__n", f"stack({len(lags)}, {stack}) as (lag, acf)").select(
        *spec.key, F.col("lag").cast("long").alias("lag"), F.col("acf"),
        (lit_d(1.96) / F.sqrt(F.col("__n").cast("double"))).alias("bound"))


def sign_runs(df: DataFrame, spec: SeriesSpec, col: str, include_open: bool = False) -> DataFrame:
    """Runs of consecutive signs after dropping nulls (W22).  ``x > 0`` is
    positive, everything else negative.  One row per run:
    ``(key..., run, sign, length)``; the last (open) run of each series is
    left out unless ``include_open``.

    Gaps-and-islands: re-index the non-null rows, flag sign changes with a
    lag, number runs with a block-carry prefix sum, then group."""
    keys = spec.keys
    d, ri, _ = ensure_index(df, spec)
    d = d.filter(F.col(col).isNotNull()).select(*keys, F.col(ri).alias("__o"), (F.col(col) > 0).alias("__pos"))
    sub = SeriesSpec(order="__o", key=spec.key, block_rows=spec.block_rows, width=float(spec.block_rows))
    d = with_row_index(d, sub, "__i")
    sub = sub.with_index("__i")
    d = windowed(d, sub, lambda w: [flag(F.lag("__pos", 1).over(w) != F.col("__pos")).alias("__chg")], before=1)
    d = prefix_sum(d, sub, {"run": F.col("__chg").cast("long")})
    runs = d.groupBy(*keys, "run").agg(F.first("__pos").alias("positive"), F.count(F.lit(1)).alias("length"))
    if include_open:
        return runs
    last = runs.groupBy(*keys).agg(F.max("run").alias("__last"))
    if keys:
        runs = runs.join(last, keys)
    else:
        runs = runs.crossJoin(F.broadcast(last))  # one row
    return runs.filter(F.col("run") < F.col("__last")).drop("__last")


def run_histogram(runs: DataFrame, lo: int = 1, hi: int = 14) -> DataFrame:
    """Counts of run lengths in bins ``[lo, lo+1), ..., [hi-1, hi]`` (W23):
    the last bin is closed, so lengths hi-1 and hi share it; longer runs
    fall outside."""
    b = F.when(F.col("length") == hi, F.lit(hi - 1)).otherwise(F.col("length"))
    return (runs.filter((F.col("length") >= lo) & (F.col("length") <= hi))
            .groupBy("positive", b.alias("bin")).agg(F.count(F.lit(1)).alias("runs")))


def sequences(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], length: int, include_current: bool = False,
              name: str = "seq") -> DataFrame:
    """Sliding windows of the previous ``length`` rows as
    ``ARRAY<ARRAY<DOUBLE>>`` (W27).  Training form excludes the current row,
    scoring form includes it; only full windows are kept."""
    hi = 0 if include_current else -1
    lo = hi - (length - 1)

    def build(w):
        f = w.rowsBetween(lo, hi)
        row = F.array(*[F.col(c).cast("double") for c in cols])
        return [F.collect_list(row).over(f).alias(name)]

    out = windowed(df, spec, build, before=-lo)
    return out.filter(F.size(name) == length)


def padded_sequences(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], length: int,
                     name: str = "seq") -> DataFrame:
    """Scoring sequences including the current row, left-padded with zero
    rows when fewer than ``length`` rows exist (W28)."""

    def build(w):
        f = w.rowsBetween(-(length - 1), 0)
        row = F.array(*[F.col(c).cast("double") for c in cols])
        lst = F.collect_list(row).over(f)
        zero = F.array(*[lit_d(0.0) for _ in cols])
        pad = F.array_repeat(zero, F.lit(length) - F.size(lst))
        return [F.concat(pad, lst).alias(name)]

    return windowed(df, spec, build, before=length - 1)
