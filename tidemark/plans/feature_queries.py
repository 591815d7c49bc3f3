"""Feature-set queries."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from tidemark.functions.columns import EPS, lit_d
from tidemark.operators import features as X
from tidemark.operators.ewm import ewm, macd
from tidemark.operators.series import SeriesSpec, windowed, with_row_index
from tidemark.plans.fixtures_sql import DAILY_MARKET, WIDE_DAILY, WIDE_DAILY_NULLS, with_
from tidemark.plans.registry import query, round_sig, rounded, sig_sql, unrounded
from tidemark.plans.window_queries import frames_sql, roll_sql, rsi_sql
from tidemark.sources.tables import DAILY, daily_market, wide_daily, wide_daily_nulls

FAMS = {"v": ["V1", "V2", "V3", "V4"], "m": ["M1", "M2", "M3"], "s": ["S1", "S2"], "p": ["P1", "P2"],
        "i": ["I1", "I2", "I3"], "e": ["E1", "E2"]}


def row_sql(cols):
    """Oracle text of ``columns.row_stats`` (same evaluation order)."""
    n = "(0 + " + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in cols) + ")"
    s = "(0.0 + " + " + ".join(f"COALESCE({c}, 0.0)" for c in cols) + ")"
    mean = f"({s} / NULLIF({n}, 0))"
    ss = "(0.0 + " + " + ".join(f"COALESCE(({c} - {mean}) * ({c} - {mean}), 0.0)" for c in cols) + ")"
    lst = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in cols) + "]"
    return {
        "n": n, "sum": s, "mean": mean,
        "std": f"CASE WHEN {n} >= 2 THEN SQRT({ss} / ({n} - 1)) END",
        "max": f"GREATEST({', '.join(cols)})", "min": f"LEAST({', '.join(cols)})",
        "median": f"LIST_AGGREGATE(LIST_FILTER({lst}, lambda v: v IS NOT NULL), 'median')",
        "abs_sum": "(0.0 + " + " + ".join(f"COALESCE(ABS({c}), 0.0)" for c in cols) + ")",
        "n_pos": "(0 + " + " + ".join(f"COALESCE(CAST({c} > 0 AS INTEGER), 0)" for c in cols) + ")",
        "n_neg": "(0 + " + " + ".join(f"COALESCE(CAST({c} < 0 AS INTEGER), 0)" for c in cols) + ")",
    }


def _family_sql_cols():
    v, m, s, p, i, e = (row_sql(FAMS[k]) for k in ("v", "m", "s", "p", "i", "e"))
    bal = f"({m['n_pos']} - {m['n_neg']})"
    return [
        (v["mean"], "feat_v_mean"), (v["std"], "feat_v_std"), (v["max"], "feat_v_max"), (v["min"], "feat_v_min"),
        (f"{v['max']} - {v['min']}", "feat_v_range"), (v["median"], "feat_v_median"),
        (m["mean"], "feat_m_mean"), (m["sum"], "feat_m_sum"), (m["max"], "feat_m_max"), (m["min"], "feat_m_min"),
        (m["std"], "feat_m_std"), (m["abs_sum"], "feat_momentum_strength"), (m["n_pos"], "feat_positive_momentum"),
        (m["n_neg"], "feat_negative_momentum"), (bal, "feat_momentum_balance"),
        (f"{bal} / CAST({len(FAMS['m']) + EPS!r} AS DOUBLE)", "feat_momentum_consistency"),
        (s["mean"], "feat_s_mean"), (s["std"], "feat_s_std"), (s["max"], "feat_s_max"), (s["min"], "feat_s_min"),
        (f"COALESCE(CAST({s['mean']} > 0 AS INTEGER), 0)", "feat_positive_sentiment"),
        (p["mean"], "feat_p_mean"), (p["std"], "feat_p_std"), (p["max"], "feat_p_max"), (p["min"], "feat_p_min"),
        (i["mean"], "feat_i_mean"), (f"{i['max']} - {i['min']}", "feat_i_spread"), (i["std"], "feat_i_std"),
        ("I3 - I1", "feat_i_slope"), (e["mean"], "feat_e_mean"), (e["std"], "feat_e_std"),
    ]


_INT_FEATS = {"feat_positive_momentum", "feat_negative_momentum", "feat_momentum_balance", "feat_positive_sentiment"}


def _fam_select(rounding: bool = True):
    return ", ".join((f"CAST({e} AS INTEGER) AS {n}" if n in _INT_FEATS else
                      (f"ROUND({e}, 6) AS {n}" if rounding else f"{e} AS {n}")) for e, n in _family_sql_cols())


_FS_SQL = with_(WIDE_DAILY) + f"\nSELECT date_id, {_fam_select()} FROM wide_daily"


@query("family_stats", _FS_SQL)
def family_stats(spark, sf_dir):
    """Row-wise statistics over the V/M/S/P/I/E column families."""
    wd = wide_daily(spark, sf_dir)
    out = X.family_row_features(wd)
    feats = [c for c in out.columns if c.startswith("feat_")]
    return rounded(out.select("date_id", *feats))


# window part of the families: changes, filled pct changes, percentile, regime flags
_FW_SQL = with_(WIDE_DAILY, f"""
f AS (SELECT date_id, {_fam_select(False)} FROM wide_daily),
g AS (SELECT *, LAST_VALUE(feat_v_mean IGNORE NULLS) OVER (ORDER BY date_id ROWS UNBOUNDED PRECEDING) AS vff,
             LAST_VALUE(feat_s_mean IGNORE NULLS) OVER (ORDER BY date_id ROWS UNBOUNDED PRECEDING) AS sff FROM f),
pr AS (SELECT a.date_id,
         CASE WHEN a.feat_v_mean IS NOT NULL AND COUNT(b.feat_v_mean) >= 20 THEN
           (SUM(CASE WHEN b.feat_v_mean < a.feat_v_mean THEN 1 ELSE 0 END)
            + (SUM(CASE WHEN b.feat_v_mean = a.feat_v_mean THEN 1 ELSE 0 END) + 1) / 2.0) / COUNT(b.feat_v_mean) END
           AS feat_v_percentile
       FROM f a JOIN f b ON b.date_id BETWEEN a.date_id - 251 AND a.date_id GROUP BY a.date_id, a.feat_v_mean),
q AS (SELECT QUANTILE_CONT(feat_v_mean, 0.75) AS q75, QUANTILE_CONT(feat_v_mean, 0.25) AS q25,
             QUANTILE_CONT(ABS(feat_s_mean), 0.9) AS q90 FROM f)""") + """
SELECT g.date_id,
  ROUND(feat_v_mean - LAG(feat_v_mean, 5) OVER w, 4) AS feat_v_change,
  ROUND(feat_m_mean - LAG(feat_m_mean, 5) OVER w, 4) AS feat_m_change,
  ROUND(feat_s_mean - LAG(feat_s_mean, 5) OVER w, 4) AS feat_s_change,
  ROUND(feat_p_mean - LAG(feat_p_mean, 5) OVER w, 4) AS feat_p_change,
  ROUND(feat_i_mean - LAG(feat_i_mean, 20) OVER w, 4) AS feat_i_change,
  ROUND(feat_e_mean - LAG(feat_e_mean, 20) OVER w, 4) AS feat_e_change,
  ROUND(vff / NULLIF(LAG(vff, 5) OVER w, 0) - 1, 6) AS feat_v_pct_change,
  ROUND(sff / NULLIF(LAG(sff, 5) OVER w, 0) - 1, 6) AS feat_s_pct_change,
  ROUND(pr.feat_v_percentile, 6) AS feat_v_percentile,
  COALESCE(CAST(feat_v_mean > q75 AS INTEGER), 0) AS feat_high_vol,
  COALESCE(CAST(feat_v_mean < q25 AS INTEGER), 0) AS feat_low_vol,
  GREATEST(COALESCE(CAST(feat_v_mean > q75 AS INTEGER), 0), COALESCE(CAST(feat_v_mean < q25 AS INTEGER), 0))
    AS feat_extreme_vol,
  COALESCE(CAST(ABS(feat_s_mean) > q90 AS INTEGER), 0) AS feat_extreme_sentiment
FROM g JOIN pr USING (date_id), q WINDOW w AS (ORDER BY g.date_id)"""


@query("family_window_features", _FW_SQL)
def family_window_features(spark, sf_dir):
    """Changes over 5/20 days, filled percent changes, 252-day percentile of
    the volatility mean and the quantile regime flags (X4-X9)."""
    out = X.family_window_features(X.family_row_features(wide_daily(spark, sf_dir)), DAILY)
    keep = ["feat_v_change", "feat_m_change", "feat_s_change", "feat_p_change", "feat_i_change", "feat_e_change",
            "feat_v_pct_change", "feat_s_pct_change", "feat_v_percentile", "feat_high_vol", "feat_low_vol",
            "feat_extreme_vol", "feat_extreme_sentiment"]
    # changes of large-magnitude means are compared at 4 decimals: the std
    # columns inside feat_v_mean differ by ~1e-12 relative between engines
    return rounded(out.select("date_id", *keep), 6, **{c: 4 for c in keep if c.endswith("_change") and "_pct_" not in c})


# --- calendar (X13) ----------------------------------------------------------------------------
_CAL_SQL = with_(DAILY_MARKET) + """
SELECT date_id, date_id % 252 AS feat_day_of_year, (date_id % 252) // 5 AS feat_week_of_year,
  (date_id % 252) // 21 AS feat_month_of_year,
  ROUND(SIN(2 * PI() * (date_id % 252) / 252.0), 6) AS feat_day_sin,
  ROUND(COS(2 * PI() * (date_id % 252) / 252.0), 6) AS feat_day_cos,
  ROUND(SIN(2 * PI() * ((date_id % 252) // 21) / 12.0), 6) AS feat_month_sin,
  ROUND(COS(2 * PI() * ((date_id % 252) // 21) / 12.0), 6) AS feat_month_cos
FROM daily_market"""


@query("calendar_features", _CAL_SQL)
def calendar_features(spark, sf_dir):
    """Trading-calendar position and cycles."""
    dm = daily_market(spark, sf_dir).select("date_id")
    return rounded(X.calendar(dm, "date_id"))


# --- interactions (X12, F6, F13) ------------------------------------------------------------------
_IA_SQL = with_(WIDE_DAILY, f"""
f AS (SELECT date_id, {_fam_select(False)}, LAG(target) OVER (ORDER BY date_id) AS feat_lagged_target FROM wide_daily)""") + \
    f"""
SELECT date_id,
  ROUND(feat_v_mean * feat_m_mean, 6) AS feat_vol_momentum_interaction,
  ROUND(feat_v_mean / (ABS(feat_m_mean) + {EPS}), 6) AS feat_vol_momentum_ratio,
  ROUND(feat_s_mean * feat_v_mean, 6) AS feat_sentiment_vol_interaction,
  COALESCE(CAST(SIGN(feat_m_mean) = SIGN(feat_lagged_target) AS INTEGER), 0) AS feat_momentum_target_alignment,
  1 - COALESCE(CAST(SIGN(feat_m_mean) = SIGN(feat_lagged_target) AS INTEGER), 0) AS feat_momentum_divergence,
  ROUND(feat_p_mean / NULLIF(feat_v_mean + {EPS}, 0), 6) AS feat_price_vol_ratio
FROM f"""


@query("interactions", _IA_SQL)
def interactions(spark, sf_dir):
    """Cross-family interactions with sign alignment."""
    wd = wide_daily(spark, sf_dir)
    wd = windowed(wd, DAILY, lambda w: [F.lag("target", 1).over(w).alias("feat_lagged_target")], before=1)
    out = X.interactions(X.family_row_features(wd))
    keep = ["feat_vol_momentum_interaction", "feat_vol_momentum_ratio", "feat_sentiment_vol_interaction",
            "feat_momentum_target_alignment", "feat_momentum_divergence", "feat_price_vol_ratio"]
    return rounded(out.select("date_id", *keep))


# --- lagged-target block (X0-X2) ---------------------------------------------------------------------
def market_targets(spark, sf_dir):
    dm = daily_market(spark, sf_dir)
    return dm.withColumn("market_forward_excess_returns", F.col("forward_returns") - F.col("risk_free_rate"))


_LTB_SQL = with_(DAILY_MARKET, """
m AS (SELECT date_id, forward_returns, risk_free_rate, forward_returns - risk_free_rate AS mfer FROM daily_market),
l AS (SELECT date_id, LAG(mfer) OVER (ORDER BY date_id) AS lt, LAG(forward_returns) OVER (ORDER BY date_id) AS lfr,
             LAG(risk_free_rate) OVER (ORDER BY date_id) AS lrf FROM m)""") + f"""
SELECT date_id, ROUND(lt, 8) AS lagged_market_forward_excess_returns, ROUND(lfr, 8) AS lagged_forward_returns,
  ROUND(lrf, 8) AS lagged_risk_free_rate, ROUND(lt, 8) AS feat_lagged_target,
  COALESCE(CAST(lt > 0 AS INTEGER), 0) AS feat_lagged_target_sign, ROUND(ABS(lt), 8) AS feat_lagged_target_abs,
  ROUND(LAG(lt, 1) OVER w, 8) AS feat_lagged_target_2, ROUND(LAG(lt, 2) OVER w, 8) AS feat_lagged_target_3,
  ROUND({roll_sql('mean', 'lt', 'w5', 1)}, 8) AS feat_target_rolling_mean_5,
  ROUND({roll_sql('std', 'lt', 'w5', 1)}, 8) AS feat_target_rolling_std_5,
  ROUND({roll_sql('mean', 'lt', 'w20', 1)}, 8) AS feat_target_rolling_mean_20,
  ROUND({roll_sql('std', 'lt', 'w20', 1)}, 8) AS feat_target_rolling_std_20,
  ROUND({roll_sql('std', 'lt', 'w5', 1)}, 8) AS feat_target_volatility_5,
  ROUND({roll_sql('std', 'lt', 'w20', 1)}, 8) AS feat_target_volatility_20,
  ROUND(lt - ({roll_sql('mean', 'lt', 'w20', 1)}), 8) AS feat_mean_reversion,
  ROUND(lt * LAG(lt, 1) OVER w, 10) AS feat_autocorr, ROUND(lt * LAG(lt, 1) OVER w, 10) AS feat_momentum_2days,
  ROUND((lt - ({roll_sql('mean', 'lt', 'w20', 1)})) / (({roll_sql('std', 'lt', 'w20', 1)}) + {EPS}), 6)
    AS feat_target_zscore,
  ROUND(lfr, 8) AS feat_lagged_returns, ROUND(lrf, 8) AS feat_lagged_rfr
FROM l WINDOW w AS (ORDER BY date_id), {frames_sql('', 'date_id', (5, 20))}"""


@query("lagged_target_block", _LTB_SQL)
def lagged_target_block(spark, sf_dir):
    """Lagged targets (X0) and the lagged-target feature block."""
    m = market_targets(spark, sf_dir).select("date_id", "forward_returns", "risk_free_rate",
                                             "market_forward_excess_returns")
    d = X.lagged_target_block(X.lagged_targets(m, DAILY), DAILY)
    d = d.drop("forward_returns", "risk_free_rate", "market_forward_excess_returns")
    return rounded(d, 8, feat_autocorr=10, feat_momentum_2days=10, feat_target_zscore=6)


_RB_COLS = {"lagged_forward_returns": "lfr", "lagged_risk_free_rate": "lrf", "lagged_market_forward_excess_returns": "lt"}
_RB_NAMES = {"kurt": "kurtosis"}


def _rb_digits(stat):
    return 6 if stat in ("skew", "kurt") else 8


_RB_SQL = _LTB_SQL.split("\nSELECT date_id, ROUND(lt, 8)")[0] + "\nSELECT date_id, " + ", ".join(
    f"ROUND({roll_sql(s, a, f'w{n}', 1)}, {_rb_digits(s)}) AS feat_{c}_rolling_{_RB_NAMES.get(s, s)}_{n}d"
    for c, a in _RB_COLS.items() for n in X.ROLL_WINDOWS for s in ("mean", "std", "max", "min", "skew", "kurt")) + \
    f"\nFROM l WINDOW {frames_sql('', 'date_id', X.ROLL_WINDOWS)}"


@query("rolling_block", _RB_SQL)
def rolling_block(spark, sf_dir):
    """72 rolling moments of the three lagged columns over 5/10/20/60 rows."""
    m = market_targets(spark, sf_dir).select("date_id", "forward_returns", "risk_free_rate",
                                             "market_forward_excess_returns")
    d = X.rolling_block(X.lagged_targets(m, DAILY), DAILY)
    feats = [c for c in d.columns if c.startswith("feat_")]
    digits = {c: (6 if ("_skew_" in c or "_kurtosis_" in c) else 8) for c in feats}
    return rounded(d.select("date_id", *feats), 8, **digits)


# --- EWM and MACD (W12, W14) via recursive CTE oracles ---------------------------------------------
def _ewm_rec_sql(src: str, cols: dict[str, float], order: str = "date_id") -> str:
    """Recursive CTE text: for each (name -> span) an EWM of ``x`` with
    gap-length weighting; ``src`` must yield (order, x) with dense order."""
    names = list(cols)
    a = {n: 2.0 / (s + 1.0) for n, s in cols.items()}
    init = ", ".join(f"x AS {n}, CASE WHEN x IS NULL THEN NULL ELSE 0 END AS k_{n}" for n in names)
    step = []
    for n in names:
        w = f"POW({1.0 - a[n]!r}, r.k_{n} + 1)"
        step.append(f"CASE WHEN s.x IS NULL THEN r.{n} WHEN r.{n} IS NULL THEN s.x "
                    f"ELSE ({w} * r.{n} + {a[n]!r} * s.x) / ({w} + {a[n]!r}) END")
        step.append(f"CASE WHEN r.{n} IS NULL AND s.x IS NULL THEN NULL WHEN s.x IS NULL THEN r.k_{n} + 1 ELSE 0 END")
    cols_decl = ", ".join(f"{n}, k_{n}" for n in names)
    return (f"rec({order}, {cols_decl}) AS (SELECT {order}, {init} FROM {src} WHERE {order} = 0 "
            f"UNION ALL SELECT s.{order}, {', '.join(step)} FROM rec r JOIN {src} s ON s.{order} = r.{order} + 1)")


_MACD_SQL = "WITH RECURSIVE " + DAILY_MARKET.strip() + """,
src AS (SELECT date_id, LAG(forward_returns) OVER (ORDER BY date_id) AS x FROM daily_market),
""" + _ewm_rec_sql("src", {"e12": 12, "e26": 26}) + """,
m AS (SELECT date_id, e12 - e26 AS x FROM rec),
""" + _ewm_rec_sql("m", {"sig": 9}).replace("rec(", "rec2(").replace("FROM rec r", "FROM rec2 r") + """
SELECT r.date_id, ROUND(e12, 9) AS ewm_12, ROUND(e26, 9) AS ewm_26, ROUND(m.x, 9) AS macd,
  ROUND(r2.sig, 9) AS macd_signal, ROUND(m.x - r2.sig, 9) AS macd_hist
FROM rec r JOIN m USING (date_id) JOIN rec2 r2 USING (date_id)"""


@query("ewm_macd", _MACD_SQL)
def ewm_macd(spark, sf_dir):
    """EWM 12/26 of the lagged return, MACD, signal and histogram."""
    dm = daily_market(spark, sf_dir).select("date_id", "forward_returns")
    d = windowed(dm, DAILY, lambda w: [F.lag("forward_returns", 1).over(w).alias("x")], before=1).drop("forward_returns")
    d = ewm(d, DAILY, "x", [12, 26], ["ewm_12", "ewm_26"])
    d = macd(d, DAILY, "x", prefix="")
    return rounded(d.select("date_id", "ewm_12", "ewm_26", "macd", "macd_signal", "macd_hist"), 9)


_EG_SQL = "WITH RECURSIVE " + WIDE_DAILY_NULLS.strip() + """,
src AS (SELECT date_id, E2 AS x FROM wide_daily_nulls),
src2 AS (SELECT date_id, M1 AS x FROM wide_daily_nulls),
""" + _ewm_rec_sql("src", {"e2_26": 26}) + ",\n" + _ewm_rec_sql("src2", {"m1_12": 12, "m1_2": 2}).replace(
    "rec(", "recm(").replace("FROM rec r", "FROM recm r") + """
SELECT date_id, ROUND(e2_26, 6) AS e2_ewm_26, ROUND(m1_12, 9) AS m1_ewm_12, ROUND(m1_2, 9) AS m1_ewm_2
FROM rec JOIN recm USING (date_id)"""


@query("ewm_gaps", _EG_SQL)
def ewm_gaps(spark, sf_dir):
    """EWM over series with a 61-row gap and every-4th-row nulls: gaps
    weight by their length, null rows repeat the last value (W12)."""
    wd = wide_daily_nulls(spark, sf_dir).select("date_id", "E2", "M1")
    d = ewm(wd, DAILY, "E2", [26], ["e2_ewm_26"])
    d = ewm(d, DAILY, "M1", [12, 2], ["m1_ewm_12", "m1_ewm_2"])
    return rounded(d.select("date_id", "e2_ewm_26", "m1_ewm_12", "m1_ewm_2"), 9, e2_ewm_26=6)


_TB_COLS = {"lfr": "lagged_forward_returns", "lt": "lagged_market_forward_excess_returns"}
_TB_SQL = "WITH RECURSIVE " + _LTB_SQL[len("WITH "):].split("\nSELECT date_id, ROUND(lt, 8)")[0]
for _a, _c in _TB_COLS.items():
    _TB_SQL += f""",
gl_{_a} AS (SELECT date_id, COALESCE(GREATEST(x, 0.0), 0.0) AS gain, COALESCE(GREATEST(-x, 0.0), 0.0) AS loss
  FROM (SELECT date_id, {_a} - LAG({_a}) OVER (ORDER BY date_id) AS x FROM l)),
rsi_{_a} AS (SELECT date_id, """ + ", ".join(f"{rsi_sql(n)} AS feat_{_c}_rsi_{n}" for n in X.RSI_WINDOWS) + f"""
  FROM gl_{_a} WINDOW {frames_sql('', 'date_id', X.RSI_WINDOWS)}),
src_{_a} AS (SELECT date_id, {_a} AS x FROM l),
""" + _ewm_rec_sql(f"src_{_a}", {"e12": 12, "e26": 26}).replace("rec(", f"rec_{_a}(").replace("FROM rec r", f"FROM rec_{_a} r") + f""",
line_{_a} AS (SELECT date_id, e12 - e26 AS x FROM rec_{_a}),
""" + _ewm_rec_sql(f"line_{_a}", {"sig": 9}).replace("rec(", f"rec2_{_a}(").replace("FROM rec r", f"FROM rec2_{_a} r")
_TB_SQL += "\nSELECT rsi_lfr.date_id, " + ", ".join(
    [f"ROUND(feat_{c}_rsi_{n}, 6) AS feat_{c}_rsi_{n}" for c in _TB_COLS.values() for n in X.RSI_WINDOWS]
    + [f"ROUND({e}, 6) AS feat_{c}_{n}" for a, c in _TB_COLS.items()
       for e, n in ((f"line_{a}.x", "macd"), (f"rec2_{a}.sig", "macd_signal"), (f"line_{a}.x - rec2_{a}.sig", "macd_hist"))]) + \
    "\nFROM rsi_lfr" + "".join(f" JOIN {t}_{a} USING (date_id)" for a in _TB_COLS for t in ("rsi", "line", "rec2") if (t, a) != ("rsi", "lfr"))


@query("technical_block", _TB_SQL)
def technical_block(spark, sf_dir):
    """RSI 7/14/21 and MACD of both lagged columns."""
    m = market_targets(spark, sf_dir).select("date_id", "forward_returns", "risk_free_rate",
                                             "market_forward_excess_returns")
    d = X.technical_block(X.lagged_targets(m, DAILY), DAILY)
    return rounded(d.select("date_id", *[c for c in d.columns if c.startswith("feat_")]))


def market_table(spark, sf_dir):
    """Wide market table: the family columns of ``wide_daily`` joined on the
    calendar day with the targets of the daily price series."""
    wd = wide_daily(spark, sf_dir).drop("target", "date_id")
    m = market_targets(spark, sf_dir).select("d", "forward_returns", "risk_free_rate", "market_forward_excess_returns")
    # the day sets differ, so positions are re-numbered densely after the join
    return with_row_index(wd.join(m, "d", "inner"), SeriesSpec(order="d"), "date_id")


_MT_COLS = ["D1", *[c for cols in FAMS.values() for c in cols]]
# both fixtures of the joined table under the names that the parts above use
_MARKET_TABLE = WIDE_DAILY.replace("wide_daily AS", "wide0 AS") + "," + DAILY_MARKET.replace("daily_market AS", "market0 AS") + f""",
mt AS (SELECT ROW_NUMBER() OVER (ORDER BY d) - 1 AS date_id, {', '.join(_MT_COLS)}, forward_returns, risk_free_rate,
  forward_returns - risk_free_rate AS market_forward_excess_returns FROM wide0 JOIN market0 USING (d)),
daily_market AS (SELECT date_id, forward_returns, risk_free_rate FROM mt),
wide_daily AS (SELECT date_id, {', '.join(_MT_COLS)}, market_forward_excess_returns AS target FROM mt)"""


def _part(sql: str, fixture: str) -> str:
    """A query of this module as a subquery over the fixtures in scope, its
    values not rounded."""
    head = "WITH RECURSIVE " if sql.startswith("WITH RECURSIVE ") else "WITH "
    rest = sql[len(head) + len(fixture):]
    return unrounded((head + rest[1:]) if rest.startswith(",") else rest)


_FULL = {"ltb": (_LTB_SQL, DAILY_MARKET), "rb": (_RB_SQL, DAILY_MARKET), "fs": (_FS_SQL, WIDE_DAILY), "fw": (_FW_SQL, WIDE_DAILY),
         "tb": (_TB_SQL, DAILY_MARKET), "ia": (_IA_SQL, WIDE_DAILY), "cal": (_CAL_SQL, DAILY_MARKET)}
_WHOLE = {"feat_lagged_target_sign", "feat_high_vol", "feat_low_vol", "feat_extreme_vol", "feat_extreme_sentiment", "feat_momentum_target_alignment", "feat_momentum_divergence",
          "feat_day_of_year", "feat_week_of_year", "feat_month_of_year", *_INT_FEATS}
_FEATURES = sorted({m for sql, _ in _FULL.values() for m in re.findall(r"AS (feat_\w+)", sql.split("\nFROM ")[-2].split("\nSELECT")[-1] if "\nFROM " in sql else sql)})
_FEAT_SQL = "WITH " + _MARKET_TABLE + "".join(f",\n{n} AS ({_part(sql, fixture)})" for n, (sql, fixture) in _FULL.items()) + """,
every AS (SELECT * FROM mt JOIN ltb USING (date_id)""" + "".join(f" JOIN {n} USING (date_id)" for n in list(_FULL)[1:]) + ")"


_RATIO = "feat_vol_momentum_ratio"


def _feature_set_sql(features) -> str:
    def value(c):
        if c == _RATIO:  # beyond 1e12 where the momentum is near 0
            return f"ROUND({sig_sql(f'COALESCE({c}, med_{c})')}, 0) AS {c}"
        return c if c in _WHOLE else f"ROUND(COALESCE({c}, med_{c}), 4) AS {c}"

    own = ["lagged_market_forward_excess_returns", "lagged_forward_returns", "lagged_risk_free_rate", *[c for c in _MT_COLS if c not in ("D1", "E1")],
           "forward_returns", "risk_free_rate", "market_forward_excess_returns"]
    return _FEAT_SQL + ",\nmeds AS (SELECT " + ", ".join(f"MEDIAN({c}) AS med_{c}" for c in features if c not in _WHOLE) + " FROM every)\nSELECT date_id, D1, E1, " + ", ".join(
        [f"ROUND({c}, 4) AS {c}" for c in own] + [value(c) for c in features]) + " FROM every, meds"


@query("feature_set", _feature_set_sql(_FEATURES))
def feature_set(spark, sf_dir):
    """The full derived feature set on the wide market table, missing values
    filled (X0-X14, M5)."""
    d = X.build_features(market_table(spark, sf_dir), DAILY, max_null=1.0).drop("d")
    return rounded(d.withColumn(_RATIO, round_sig(F.col(_RATIO))), 4, **{_RATIO: 0})
