"""Derived feature sets (X0-X14) as declarative expressions.

Row-wise family statistics are plain projections; everything that looks at
neighbouring rows goes through ``series.windowed`` so a whole level of
features shares one Window node.  Global quantile flags (X4/X6) compare with
the quantiles of a whole series; ``regime='expanding'`` compares each row with
those of the rows up to it (``expanding.expanding_rank``), so none sees the future.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import (DAYS_PER_MONTH, DAYS_PER_WEEK, DAYS_PER_YEAR, EPS, cyclic, family, flag,
                                        lit_d, row_stats, safe_div, sign_differs, sign_match)
from tidemark.operators.expanding import above_quantile, below_quantile, expanding_rank
from tidemark.operators.series import SeriesSpec, ensure_index, ffill, null_safe_join, windowed
from tidemark.operators.windows import STATS, pct_rank_expr, roll, rsi_expr, zscore_expr

TARGET = "market_forward_excess_returns"
LAGGED = {"market_forward_excess_returns": "lagged_market_forward_excess_returns",
          "forward_returns": "lagged_forward_returns", "risk_free_rate": "lagged_risk_free_rate"}
LT = "lagged_market_forward_excess_returns"
KEY_COLS = ("lagged_forward_returns", "lagged_risk_free_rate", LT)
ROLL_WINDOWS = (5, 10, 20, 60)
RSI_WINDOWS = (7, 14, 21)


def lagged_targets(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``lagged_*`` = the targets shifted by one row, only when the
    input does not already carry them (serving form)."""
    if LT in df.columns:
        return df
    todo = [c for c in LAGGED if c in df.columns]
    if not todo:
        return df
    return windowed(df, spec, lambda w: [F.lag(c, 1).over(w).alias(LAGGED[c]) for c in todo], before=1)


def lagged_target_block(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """X1 + X2: lagged-target features (needs ``lagged_*`` columns)."""

    def build(w):
        x = F.col(LT)
        out = [x.alias("feat_lagged_target"), flag(x > 0).alias("feat_lagged_target_sign"),
               F.abs(x).alias("feat_lagged_target_abs"), F.lag(LT, 1).over(w).alias("feat_lagged_target_2"),
               F.lag(LT, 2).over(w).alias("feat_lagged_target_3")]
        for n in (5, 20):
            out += [roll("mean", LT, w, n).alias(f"feat_target_rolling_mean_{n}"),
                    roll("std", LT, w, n).alias(f"feat_target_rolling_std_{n}")]
        out += [roll("std", LT, w, n).alias(f"feat_target_volatility_{n}") for n in (5, 20)]
        prod = x * F.lag(LT, 1).over(w)
        out += [(x - roll("mean", LT, w, 20)).alias("feat_mean_reversion"), prod.alias("feat_autocorr"),
                prod.alias("feat_momentum_2days"), zscore_expr(LT, w, 20, EPS).alias("feat_target_zscore")]
        if "lagged_forward_returns" in df.columns:
            out.append(F.col("lagged_forward_returns").alias("feat_lagged_returns"))
        if "lagged_risk_free_rate" in df.columns:
            out.append(F.col("lagged_risk_free_rate").alias("feat_lagged_rfr"))
        return out

    return windowed(df, spec, build, before=19)


def rolling_block(df: DataFrame, spec: SeriesSpec, cols: Sequence[str] = KEY_COLS,
                  windows: Sequence[int] = ROLL_WINDOWS) -> DataFrame:
    """Rolling mean/std/max/min/skew/kurtosis of the lagged columns over
    5/10/20/60 rows (min_periods 1): 72 columns in one Window node."""
    names = {"kurt": "kurtosis"}
    cols = [c for c in cols if c in df.columns]

    def build(w):
        return [roll(s, c, w, n).alias(f"feat_{c}_rolling_{names.get(s, s)}_{n}d")
                for c in cols for n in windows for s in STATS]

    return windowed(df, spec, build, before=max(windows) - 1)


def vol_of_vol(df: DataFrame, spec: SeriesSpec, col: str = "lagged_forward_returns", inner=(20, 60),
               outer: int = 20) -> DataFrame:
    """W15 (opt-in): strict rolling std over ``outer`` rows of the rolling
    std (min_periods 1) over each ``inner`` window."""
    d = windowed(df, spec, lambda w: [roll("std", col, w, n).alias(f"__vol{n}") for n in inner],
                 before=max(inner) - 1)
    d = windowed(d, spec, lambda w: [roll("std", f"__vol{n}", w, outer, outer).alias(f"vol_of_vol_{n}")
                                     for n in inner], before=outer - 1)
    return d.drop(*[f"__vol{n}" for n in inner])


def family_row_features(df: DataFrame) -> DataFrame:
    """X4-X9 row-wise part: statistics across the columns of each family
    (strict ``^[A-Z]+\\d+$`` names, in table column order)."""
    cols = df.columns
    fam = {p: family(cols, p) for p in ("V", "M", "S", "P", "I", "E")}
    out = []
    if fam["V"]:
        s = row_stats(fam["V"])
        out += [s["mean"].alias("feat_v_mean"), s["std"].alias("feat_v_std"), s["max"].alias("feat_v_max"),
                s["min"].alias("feat_v_min"), (s["max"] - s["min"]).alias("feat_v_range"),
                s["median"].alias("feat_v_median")]
    if fam["M"]:
        s = row_stats(fam["M"])
        bal = s["n_pos"] - s["n_neg"]
        out += [s["mean"].alias("feat_m_mean"), s["sum"].alias("feat_m_sum"), s["max"].alias("feat_m_max"),
                s["min"].alias("feat_m_min"), s["std"].alias("feat_m_std"),
                s["abs_sum"].alias("feat_momentum_strength"), s["n_pos"].alias("feat_positive_momentum"),
                s["n_neg"].alias("feat_negative_momentum"), bal.alias("feat_momentum_balance"),
                (bal / lit_d(len(fam["M"]) + EPS)).alias("feat_momentum_consistency")]
    if fam["S"]:
        s = row_stats(fam["S"])
        out += [s["mean"].alias("feat_s_mean"), s["std"].alias("feat_s_std"), s["max"].alias("feat_s_max"),
                s["min"].alias("feat_s_min"), flag(s["mean"] > 0).alias("feat_positive_sentiment")]
    if fam["P"]:
        s = row_stats(fam["P"])
        out += [s["mean"].alias("feat_p_mean"), s["std"].alias("feat_p_std"), s["max"].alias("feat_p_max"),
                s["min"].alias("feat_p_min")]
    if fam["I"]:
        s = row_stats(fam["I"])
        out += [s["mean"].alias("feat_i_mean"), (s["max"] - s["min"]).alias("feat_i_spread"),
                s["std"].alias("feat_i_std")]
        if len(fam["I"]) >= 3:
            out.append((F.col(fam["I"][-1]) - F.col(fam["I"][0])).alias("feat_i_slope"))
    if fam["E"]:
        s = row_stats(fam["E"])
        out += [s["mean"].alias("feat_e_mean"), s["std"].alias("feat_e_std")]
    return df.select("*", *out)


_CHANGES = (("feat_v_mean", "feat_v_change", 5), ("feat_m_mean", "feat_m_change", 5),
            ("feat_s_mean", "feat_s_change", 5), ("feat_p_mean", "feat_p_change", 5),
            ("feat_i_mean", "feat_i_change", 20), ("feat_e_mean", "feat_e_change", 20))


def family_window_features(df: DataFrame, spec: SeriesSpec, regime: str = "global") -> DataFrame:
    """X4-X9 window part: changes over 5/20 rows, filled percent changes,
    rolling percentile of the volatility mean, and the regime flags."""
    have = set(df.columns)
    pct = [c for c in ("feat_v_mean", "feat_s_mean") if c in have]
    d = ffill(df, spec, pct, suffix="__ff") if pct else df

    def build(w):
        out = [(F.col(src) - F.lag(src, k).over(w)).alias(dst) for src, dst, k in _CHANGES if src in have]
        for c in pct:
            short = c.split("_")[1]
            out.append((safe_div(F.col(c + "__ff"), F.lag(c + "__ff", 5).over(w)) - 1).alias(f"feat_{short}_pct_change"))
        if "feat_v_mean" in have:
            out.append(pct_rank_expr("feat_v_mean", w, DAYS_PER_YEAR, 20).alias("feat_v_percentile"))
        return out

    d = windowed(d, spec, build, before=DAYS_PER_YEAR - 1).drop(*[c + "__ff" for c in pct])
    return regime_flags(d, spec, regime)


#: quantiles of the regime flags (fixed values): high and low volatility, extreme sentiment
HIGH_VOL, LOW_VOL, EXTREME_SENTIMENT = 0.75, 0.25, 0.9


def regime_flags(df: DataFrame, spec: SeriesSpec, regime: str = "global") -> DataFrame:
    """feat_high_vol / low_vol / extreme_vol and feat_extreme_sentiment.
    ``global`` compares with quantiles of the whole series (the reference's
    choice: early rows see the future); ``expanding`` with those of the rows up
    to the current one.  A null or NaN value raises no flag; rows of a null key
    are a series of their own."""
    have = set(df.columns)
    if not have & {"feat_v_mean", "feat_s_mean"}:
        return df
    vol, sent = F.col("feat_v_mean") if "feat_v_mean" in have else None, F.abs("feat_s_mean") if "feat_s_mean" in have else None
    if regime == "global":
        aggs = []
        if vol is not None:
            aggs += [F.percentile("feat_v_mean", HIGH_VOL).alias("__q75"), F.percentile("feat_v_mean", LOW_VOL).alias("__q25")]
        if sent is not None:
            aggs.append(F.percentile(sent, EXTREME_SENTIMENT).alias("__q90"))
        q = df.groupBy(*spec.keys).agg(*aggs)
        d = null_safe_join(df, q, spec.keys) if spec.keys else df.crossJoin(F.broadcast(q))  # one row without keys
        high, low, far = vol is not None and vol > F.col("__q75"), vol is not None and vol < F.col("__q25"), sent is not None and sent > F.col("__q90")
    elif regime == "expanding":
        base, ri, added = ensure_index(df, spec)
        cols = [c for c, v in (("__vol", vol), ("__sent", sent)) if v is not None]
        d = base.select("*", *[v.alias(c) for c, v in (("__vol", vol), ("__sent", sent)) if v is not None])
        d = expanding_rank(d, spec.with_index(ri), cols)
        high = vol is not None and above_quantile(F.col("__vol_less"), F.col("__vol_seen"), HIGH_VOL)
        low = vol is not None and below_quantile(F.col("__vol_most"), F.col("__vol_seen"), LOW_VOL)
        far = sent is not None and above_quantile(F.col("__sent_less"), F.col("__sent_seen"), EXTREME_SENTIMENT)
    else:
        raise ValueError(f"unknown regime {regime!r}")
    out = []
    if vol is not None:
        out += [flag(high).alias("feat_high_vol"), flag(low).alias("feat_low_vol"), F.greatest(flag(high), flag(low)).alias("feat_extreme_vol")]
    if sent is not None:
        out.append(flag(far).alias("feat_extreme_sentiment"))
    return d.select(*df.columns, *out)


def interactions(df: DataFrame) -> DataFrame:
    """Cross-family interactions (F6 sign rules, F13 safe ratios)."""
    have = set(df.columns)
    out = []
    if {"feat_v_mean", "feat_m_mean"} <= have:
        out += [(F.col("feat_v_mean") * F.col("feat_m_mean")).alias("feat_vol_momentum_interaction"),
                (F.col("feat_v_mean") / (F.abs("feat_m_mean") + lit_d(EPS))).alias("feat_vol_momentum_ratio")]
    if {"feat_s_mean", "feat_v_mean"} <= have:
        out.append((F.col("feat_s_mean") * F.col("feat_v_mean")).alias("feat_sentiment_vol_interaction"))
    if {"feat_m_mean", "feat_lagged_target"} <= have:
        out += [sign_match("feat_m_mean", "feat_lagged_target").alias("feat_momentum_target_alignment"),
                sign_differs("feat_m_mean", "feat_lagged_target").alias("feat_momentum_divergence")]
    if {"feat_p_mean", "feat_v_mean"} <= have:
        out.append(safe_div(F.col("feat_p_mean"), F.col("feat_v_mean") + lit_d(EPS)).alias("feat_price_vol_ratio"))
    return df.select("*", *out)


def calendar(df: DataFrame, col: str = "date_id", year: int = DAYS_PER_YEAR, week: int = DAYS_PER_WEEK,
             month: int = DAYS_PER_MONTH) -> DataFrame:
    """Position in a 252-day year, weeks of 5, months of 21, and
    sin/cos cycles."""
    day = F.pmod(F.col(col), F.lit(year))
    mon = F.floor(day / month)
    ds, dc = cyclic(day, year)
    ms, mc = cyclic(mon, 12)
    return df.select("*", day.alias("feat_day_of_year"), F.floor(day / week).alias("feat_week_of_year"),
                     mon.alias("feat_month_of_year"), ds.alias("feat_day_sin"), dc.alias("feat_day_cos"),
                     ms.alias("feat_month_sin"), mc.alias("feat_month_cos"))


def technical_block(df: DataFrame, spec: SeriesSpec, cols: Sequence[str] = ("lagged_forward_returns", LT),
                    macd: bool = True) -> DataFrame:
    """X10 + X11: RSI over 7/14/21 rows and MACD (12/26/9) for each column."""
    from tidemark.operators.ewm import macds

    cols = [c for c in cols if c in df.columns]
    d = windowed(df, spec, lambda w: [(F.col(c) - F.lag(c, 1).over(w)).alias(f"__d_{c}") for c in cols], before=1)
    d = windowed(d, spec, lambda w: [rsi_expr(F.col(f"__d_{c}"), w, n).alias(f"feat_{c}_rsi_{n}")
                                     for c in cols for n in RSI_WINDOWS], before=max(RSI_WINDOWS) - 1)
    d = d.drop(*[f"__d_{c}" for c in cols])
    return macds(d, spec, cols, [f"feat_{c}_" for c in cols]) if macd and cols else d


def build_features(df: DataFrame, spec: SeriesSpec, regime: str = "global", with_vol_of_vol: bool = False, impute: bool = True,
                   max_null: float = 0.3) -> DataFrame:
    """Lag -> features -> median imputation of every feature column, without
    those of which more than ``max_null`` is null (``impute=False`` leaves the
    nulls, for an imputer fitted on training rows only).  Rows are numbered once;
    the input, what the EWMs read and what the imputer is fitted on are cut."""
    from tidemark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    df, ri, added = ensure_index(df, spec)
    df, spec = df.checkpoint(eager=True), spec.with_index(ri)
    d = lagged_targets(df, spec)
    if LT in d.columns:
        d = lagged_target_block(d, spec)
    d = rolling_block(d, spec)
    if with_vol_of_vol and "lagged_forward_returns" in d.columns:
        d = vol_of_vol(d, spec)
    d = family_row_features(d)
    d = family_window_features(d, spec, regime)
    d = technical_block(d, spec)
    d = interactions(d)
    if "date_id" in d.columns:
        d = calendar(d, "date_id")
    if impute:
        from tidemark.operators.missing import MedianImputer

        feats = [f.name for f in d.schema.fields if f.name.startswith("feat_") and f.dataType.typeName() == "double"]
        d = d.checkpoint(eager=True)
        d = MedianImputer(max_null, by_rank=True).fit(d, feats).transform(d)
    return d.drop(ri) if added else d
