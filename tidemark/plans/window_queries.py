"""Window-operator queries (W1-W30) on the panel and the long daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import EPS, flag, lit_d
from tidemark.operators import windows as W
from tidemark.operators.series import windowed
from tidemark.plans.fixtures_sql import DAILY_MARKET, USER_SERIES, with_
from tidemark.plans.registry import query, rounded
from tidemark.sources.tables import DAILY, USERS, daily_market, user_series


def roll_sql(stat: str, col: str, win: str, mp: int) -> str:
    """Oracle text of ``windows.roll`` over the named window ``win``."""
    cnt = f"COUNT({col}) OVER {win}"
    body = {
        "mean": f"AVG({col}) OVER {win}",
        "std": f"STDDEV_SAMP({col}) OVER {win}",
        "max": f"MAX({col}) OVER {win}",
        "min": f"MIN({col}) OVER {win}",
        "sum": f"SUM({col}) OVER {win}",
        "skew": f"CASE WHEN {cnt} < 3 THEN NULL WHEN MAX({col}) OVER {win} = MIN({col}) OVER {win} THEN 0.0 "
                f"ELSE SKEWNESS({col}) OVER {win} END",
        "kurt": f"CASE WHEN {cnt} < 4 THEN NULL WHEN MAX({col}) OVER {win} = MIN({col}) OVER {win} THEN -3.0 "
                f"ELSE KURTOSIS({col}) OVER {win} END",
    }[stat]
    return f"CASE WHEN {cnt} >= {mp} THEN {body} END"


def frames_sql(part: str, order: str, ns) -> str:
    p = f"PARTITION BY {part} " if part else ""
    return ", ".join(f"w{n} AS ({p}ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ns)


# --- rolling moments on the panel (W5-W9) -----------------------------------------
_MOM_N = (5, 10)
_MOM_SQL = with_(USER_SERIES) + "\nSELECT user_id, pos, " + ", ".join(
    f"ROUND({roll_sql(s, 'value', f'w{n}', 1)}, 6) AS value_rolling_{s}_{n}"
    for n in _MOM_N for s in W.STATS) + f"\nFROM user_series WINDOW {frames_sql('user_id', 'pos', _MOM_N)}"


@query("rolling_moments_panel", _MOM_SQL)
def rolling_moments_panel(spark, sf_dir):
    """Rolling mean/std/max/min/skew/kurt (min_periods 1) per user."""
    us = user_series(spark, sf_dir).select("user_id", "pos", "value")
    out = W.rolling(us, USERS, ["value"], _MOM_N, W.STATS, 1)
    return rounded(out.drop("value"))


# --- strict windows (W10, W30) -----------------------------------------------------
_STRICT_SQL = with_(USER_SERIES) + f"""
SELECT user_id, pos,
  ROUND({roll_sql('mean', 'value', 'w5', 5)}, 6) AS mean_5,
  ROUND({roll_sql('std', 'value', 'w5', 5)}, 6) AS std_5,
  ROUND({roll_sql('mean', 'value', 'w20', 20)}, 6) AS mean_20,
  ROUND({roll_sql('std', 'value', 'w20', 20)}, 6) AS std_20,
  ROUND({roll_sql('mean', 'value', 'w5', 5)} - {roll_sql('mean', 'value', 'w20', 20)}, 6) AS momentum_diff
FROM user_series WINDOW {frames_sql('user_id', 'pos', (5, 20))}"""


@query("rolling_strict", _STRICT_SQL)
def rolling_strict(spark, sf_dir):
    """Full-window rolling mean/std and the 5-20 momentum difference."""
    us = user_series(spark, sf_dir).select("user_id", "pos", "value")
    out = windowed(us, USERS, lambda w: [
        W.strict("mean", "value", w, 5).alias("mean_5"), W.strict("std", "value", w, 5).alias("std_5"),
        W.strict("mean", "value", w, 20).alias("mean_20"), W.strict("std", "value", w, 20).alias("std_20"),
        (W.strict("mean", "value", w, 5) - W.strict("mean", "value", w, 20)).alias("momentum_diff")], before=19)
    return rounded(out.drop("value"))


# --- lag / diff / pct_change (W2-W4) -----------------------------------------------
_LAG_SQL = with_(USER_SERIES, """
f AS (SELECT *, LAST_VALUE(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff FROM user_series)""") + """
SELECT user_id, pos,
  ROUND(LAG(value, 1) OVER w, 6) AS value_lag1,
  ROUND(LAG(value, 5) OVER w, 6) AS value_lag5,
  ROUND(value - LAG(value, 1) OVER w, 6) AS value_diff,
  ROUND(ff / NULLIF(LAG(ff, 1) OVER w, 0) - 1, 6) AS value_pct1,
  ROUND(ff / NULLIF(LAG(ff, 5) OVER w, 0) - 1, 6) AS value_pct5
FROM f WINDOW w AS (PARTITION BY user_id ORDER BY pos)"""


@query("lag_diff_pct", _LAG_SQL)
def lag_diff_pct(spark, sf_dir):
    """Lags 1 and 5, first difference, forward-filled percent change."""
    us = user_series(spark, sf_dir).select("user_id", "pos", "value")
    d = W.lag_features(us, USERS, ["value"], [1, 5])
    d = W.diff(d, USERS, ["value"], 1)
    d = W.pct_change(d, USERS, ["value"], 1)
    d = W.pct_change(d, USERS, ["value"], 5)
    return rounded(d.drop("value"))


# --- rolling percentile rank (W11) ---------------------------------------------------
_RANK_N, _RANK_MIN = 30, 10
_RANK_SQL = with_(USER_SERIES, f"""
p AS (
  SELECT a.user_id, a.pos, a.value,
         SUM(CASE WHEN b.value < a.value THEN 1 ELSE 0 END) AS lt,
         SUM(CASE WHEN b.value = a.value THEN 1 ELSE 0 END) AS eq,
         COUNT(b.value) AS k
  FROM user_series a JOIN user_series b
    ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - {_RANK_N - 1} AND a.pos
  GROUP BY 1, 2, 3)""") + f"""
SELECT user_id, pos,
  ROUND(CASE WHEN value IS NOT NULL AND k >= {_RANK_MIN} THEN (lt + (eq + 1) / 2.0) / k END, 6) AS value_pct_rank
FROM p"""


@query("rolling_pct_rank", _RANK_SQL)
def rolling_pct_rank(spark, sf_dir):
    """Percentile rank of the current value in the last 30 (min 10)."""
    us = user_series(spark, sf_dir).select("user_id", "pos", "value")
    out = windowed(us, USERS, lambda w: [W.pct_rank_expr("value", w, _RANK_N, _RANK_MIN).alias("value_pct_rank")],
                   before=_RANK_N - 1)
    return rounded(out.drop("value"))


# --- RSI (W13) -------------------------------------------------------------------------
def rsi_sql(n):
    g, lo = f"AVG(gain) OVER w{n}", f"AVG(loss) OVER w{n}"
    return (f"CASE WHEN COUNT(*) OVER w{n} >= {n} THEN CASE WHEN {lo} > 0 THEN 100.0 - 100.0 / (1.0 + {g} / {lo}) "
            f"WHEN {g} > 0 THEN 100.0 END END")


_RSI_SQL = with_(DAILY_MARKET, """
dd AS (SELECT date_id, forward_returns - LAG(forward_returns) OVER (ORDER BY date_id) AS delta FROM daily_market),
gl AS (SELECT date_id, COALESCE(GREATEST(delta, 0.0), 0.0) AS gain, COALESCE(GREATEST(-delta, 0.0), 0.0) AS loss
       FROM dd)""") + "\nSELECT date_id, " + ", ".join(
    f"ROUND({rsi_sql(n)}, 6) AS forward_returns_rsi_{n}" for n in (7, 14, 21)) + \
    f"\nFROM gl WINDOW {frames_sql('', 'date_id', (7, 14, 21))}"


@query("rsi", _RSI_SQL)
def rsi(spark, sf_dir):
    """RSI over 7/14/21 days on the daily forward return."""
    dm = daily_market(spark, sf_dir).select("date_id", "forward_returns")
    return rounded(W.rsi(dm, DAILY, ["forward_returns"]).drop("forward_returns"))


# --- volatility of volatility (W15) ----------------------------------------------------
_VOV_SQL = with_(DAILY_MARKET, """
l AS (SELECT date_id, LAG(forward_returns) OVER (ORDER BY date_id) AS lfr FROM daily_market),
s AS (SELECT date_id, """ + f"{roll_sql('std', 'lfr', 'w20', 1)} AS s20, {roll_sql('std', 'lfr', 'w60', 1)} AS s60"
    + f" FROM l WINDOW {frames_sql('', 'date_id', (20, 60))})") + f"""
SELECT date_id, ROUND(s20, 6) AS vol_20, ROUND(s60, 6) AS vol_60,
  ROUND({roll_sql('std', 's20', 'w20', 20)}, 6) AS vol_of_vol_20,
  ROUND({roll_sql('std', 's60', 'w20', 20)}, 6) AS vol_of_vol_60
FROM s WINDOW {frames_sql('', 'date_id', (20,))}"""


@query("vol_of_vol", _VOV_SQL)
def vol_of_vol(spark, sf_dir):
    """Strict 20-row std of the 20/60-row std of lagged returns."""
    dm = daily_market(spark, sf_dir).select("date_id", "forward_returns")
    d = W.lag_features(dm, DAILY, ["forward_returns"], [1], name="lfr")
    d = W.rolling(d, DAILY, ["lfr"], [20, 60], ["std"], 1, name="vol_{n}")
    d = windowed(d, DAILY, lambda w: [W.strict("std", "vol_20", w, 20).alias("vol_of_vol_20"),
                                      W.strict("std", "vol_60", w, 20).alias("vol_of_vol_60")], before=19)
    return rounded(d.select("date_id", "vol_20", "vol_60", "vol_of_vol_20", "vol_of_vol_60"))


# --- z-score, mean reversion, momentum product (W16, W17, W29) -------------------------
_Z_SQL = with_(USER_SERIES, "s AS (SELECT user_id, pos, value - 35 AS x FROM user_series)") + f"""
SELECT user_id, pos,
  ROUND((x - ({roll_sql('mean', 'x', 'w20', 1)})) / (({roll_sql('std', 'x', 'w20', 1)}) + {EPS}), 6) AS zscore,
  ROUND(x - ({roll_sql('mean', 'x', 'w20', 1)}), 6) AS mean_reversion,
  ROUND(x * LAG(x) OVER w, 6) AS momentum_product
FROM s WINDOW {frames_sql('user_id', 'pos', (20,))}, w AS (PARTITION BY user_id ORDER BY pos)"""


@query("zscore_reversion", _Z_SQL)
def zscore_reversion(spark, sf_dir):
    """Rolling z-score, mean reversion and ``x * lag(x)``."""
    us = user_series(spark, sf_dir).select("user_id", "pos", (F.col("value") - 35).alias("x"))
    out = windowed(us, USERS, lambda w: [
        W.zscore_expr("x", w, 20).alias("zscore"), W.reversion_expr("x", w, 20).alias("mean_reversion"),
        (F.col("x") * F.lag("x", 1).over(w)).alias("momentum_product")], before=19)
    return rounded(out.drop("x"))


# --- autocorrelation (W18-W20) -----------------------------------------------------------
_ACF_LAGS = range(1, 61)


def _acf_sql():
    parts = []
    lag_cols = lambda c: ", ".join(f"LAG({c}, {k}) OVER (ORDER BY date_id) AS {c}_l{k}" for k in _ACF_LAGS)
    base = with_(DAILY_MARKET, f"""
v AS (SELECT date_id, forward_returns AS x, ABS(forward_returns) AS ax,
      {roll_sql('std', 'forward_returns', 'w20', 20)} AS vx
      FROM daily_market WINDOW {frames_sql('', 'date_id', (20,))}),
l AS (SELECT x, ax, vx, {lag_cols('x')}, {lag_cols('ax')}, {lag_cols('vx')} FROM v),
n AS (SELECT COUNT(*) AS n FROM v)""")
    for name, c in (("x", "x"), ("abs", "ax"), ("vol", "vx")):
        for k in _ACF_LAGS:
            parts.append(f"SELECT '{name}' AS series, CAST({k} AS BIGINT) AS lag, ROUND(CORR({c}, {c}_l{k}), 6) AS acf,"
                         f" ROUND(1.96 / SQRT((SELECT n FROM n)), 6) AS bound FROM l")
    return base + "\n" + "\nUNION ALL ".join(parts)


@query("acf", _acf_sql())
def acf(spark, sf_dir):
    """ACF of returns, absolute returns and 20-day volatility for lags 1-60
    with the +-1.96/sqrt(n) band (W18-W20)."""
    dm = daily_market(spark, sf_dir).select("date_id", "forward_returns")
    dm = windowed(dm, DAILY, lambda w: [W.strict("std", "forward_returns", w, 20).alias("vol")], before=19)
    parts = [W.acf(dm, DAILY, "forward_returns", _ACF_LAGS).select(F.lit("x").alias("series"), "*"),
             W.acf(dm, DAILY, "forward_returns", _ACF_LAGS, of="abs").select(F.lit("abs").alias("series"), "*"),
             W.acf(dm, DAILY, "vol", _ACF_LAGS).select(F.lit("vol").alias("series"), "*")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


# --- sign runs (W22, W23) -----------------------------------------------------------------
_RUNS_SQL = with_(USER_SERIES, """
s AS (SELECT user_id, pos, (value - 35) > 0 AS p FROM user_series WHERE value IS NOT NULL),
c AS (SELECT *, CASE WHEN LAG(p) OVER (PARTITION BY user_id ORDER BY pos) <> p THEN 1 ELSE 0 END AS chg FROM s),
r AS (SELECT *, SUM(chg) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT user_id, run, FIRST(p) AS positive, COUNT(*) AS length FROM r GROUP BY 1, 2),
g2 AS (SELECT g.* FROM g JOIN (SELECT user_id, MAX(run) AS mx FROM g GROUP BY 1) m USING (user_id)
       WHERE run < mx)""") + """
SELECT positive, CASE WHEN length = 14 THEN 13 ELSE length END AS bin, COUNT(*) AS runs
FROM g2 WHERE length BETWEEN 1 AND 14 GROUP BY 1, 2"""


@query("sign_runs", _RUNS_SQL)
def sign_runs(spark, sf_dir):
    """Closed runs of consecutive signs per user and their length histogram
    (W22, W23)."""
    us = user_series(spark, sf_dir).select("user_id", "pos", (F.col("value") - 35).alias("x"))
    runs = W.sign_runs(us, USERS, "x")
    return W.run_histogram(runs, 1, 14)


# --- positive share, high-volatility days, momentum signs (W21, W25, W24) ----------------
_POS_SQL = with_(DAILY_MARKET) + f"""
SELECT date_id, ROUND({roll_sql('mean', 'p', 'w60', 60)}, 6) AS positive_share
FROM (SELECT date_id, COALESCE(CAST(forward_returns > 0 AS INTEGER), 0) AS p FROM daily_market) q
WINDOW {frames_sql('', 'date_id', (60,))}"""


@query("positive_share", _POS_SQL)
def positive_share(spark, sf_dir):
    """Rolling 60-day share of positive returns."""
    dm = daily_market(spark, sf_dir).select("date_id", flag(F.col("forward_returns") > 0).alias("p"))
    out = windowed(dm, DAILY, lambda w: [W.strict("mean", "p", w, 60).alias("positive_share")], before=59)
    return rounded(out.drop("p"))


_HV_SQL = with_(DAILY_MARKET, f"""
v AS (SELECT date_id, {roll_sql('std', 'ax', 'w20', 20)} AS vol
      FROM (SELECT date_id, ABS(forward_returns) AS ax FROM daily_market) q
      WINDOW {frames_sql('', 'date_id', (20,))})""") + """
SELECT date_id, ROUND(vol, 6) AS vol FROM v WHERE vol > (SELECT QUANTILE_CONT(vol, 0.95) FROM v)"""


@query("high_vol_days", _HV_SQL)
def high_vol_days(spark, sf_dir):
    """Days whose 20-day std of |return| is above its 95th percentile."""
    dm = daily_market(spark, sf_dir).select("date_id", F.abs("forward_returns").alias("ax"))
    v = windowed(dm, DAILY, lambda w: [W.strict("std", "ax", w, 20).alias("vol")], before=19).drop("ax")
    q = v.agg(F.percentile("vol", 0.95).alias("__q"))
    return rounded(v.crossJoin(F.broadcast(q)).filter(F.col("vol") > F.col("__q")).drop("__q"))


_MS_SQL = with_(DAILY_MARKET, f"""
m AS (SELECT {roll_sql('mean', 'forward_returns', 'w5', 5)} AS m5, {roll_sql('mean', 'forward_returns', 'w10', 10)} AS m10,
             {roll_sql('mean', 'forward_returns', 'w20', 20)} AS m20
      FROM daily_market WINDOW {frames_sql('', 'date_id', (5, 10, 20))})""") + "\n" + "\nUNION ALL ".join(
    f"SELECT CAST({n} AS BIGINT) AS window, COUNT(CASE WHEN m{n} > 0 THEN 1 END) AS n_positive, "
    f"COUNT(CASE WHEN m{n} < 0 THEN 1 END) AS n_negative, ROUND(AVG(m{n}), 6) AS mean_momentum FROM m"
    for n in (5, 10, 20))


@query("momentum_signs", _MS_SQL)
def momentum_signs(spark, sf_dir):
    """Rolling momentum over 5/10/20 days and how often it is positive or
    negative (W24)."""
    dm = daily_market(spark, sf_dir).select("date_id", "forward_returns")
    m = windowed(dm, DAILY, lambda w: [W.strict("mean", "forward_returns", w, n).alias(f"m{n}")
                                       for n in (5, 10, 20)], before=19)
    agg = m.agg(*[e for n in (5, 10, 20) for e in (
        F.count(F.when(F.col(f"m{n}") > 0, 1)).alias(f"p{n}"), F.count(F.when(F.col(f"m{n}") < 0, 1)).alias(f"q{n}"),
        F.avg(f"m{n}").alias(f"a{n}"))])
    stack = ", ".join(f"{n}L, p{n}, q{n}, a{n}" for n in (5, 10, 20))
    return rounded(agg.selectExpr(f"stack(3, {stack}) as (window, n_positive, n_negative, mean_momentum)"))


# --- five-year rolling mean (W26) ---------------------------------------------------------
_FY_SQL = with_(DAILY_MARKET) + f"""
SELECT date_id, ROUND({roll_sql('mean', 'forward_returns', 'w1260', 1260)}, 8) AS mean_1260
FROM daily_market WINDOW {frames_sql('', 'date_id', (1260,))}"""


@query("five_year_mean", _FY_SQL)
def five_year_mean(spark, sf_dir):
    """Strict 1,260-row mean (five trading years)."""
    dm = daily_market(spark, sf_dir).select("date_id", "forward_returns")
    out = windowed(dm, DAILY, lambda w: [W.strict("mean", "forward_returns", w, 1260).alias("mean_1260")],
                   before=1259)
    return rounded(out.drop("forward_returns"), 8)


# --- sequences (W27, W28) ------------------------------------------------------------------
def _cents(c: str) -> str:
    return f"CAST(ROUND({c} * 100) AS BIGINT)"


_SEQ_L = 5
_SEQ_SQL = with_(USER_SERIES, f"""
s AS (SELECT user_id, pos, value,
        LIST({_cents('value')} || ':' || pos) OVER (PARTITION BY user_id ORDER BY pos
             ROWS BETWEEN {_SEQ_L} PRECEDING AND 1 PRECEDING) AS l
      FROM user_series)""") + f"""
SELECT user_id, pos, ROUND(value, 6) AS target, ARRAY_TO_STRING(l, ';') AS seq
FROM s WHERE LEN(l) = {_SEQ_L}"""


def _seq_text(col: str):
    return F.array_join(F.transform(F.col(col), lambda r: F.concat_ws(
        ":", F.round(r[0] * 100).cast("long").cast("string"), r[1].cast("long").cast("string"))), ";")


@query("sequences", _SEQ_SQL)
def sequences(spark, sf_dir):
    """Training sequences of the 5 previous (value, pos) rows per user, only
    full windows, serialised to text (W27)."""
    us = user_series(spark, sf_dir).select("user_id", "pos", "value")
    s = W.sequences(us, USERS, ["value", "pos"], _SEQ_L, include_current=False)
    return rounded(s.select("user_id", "pos", F.col("value").alias("target"), _seq_text("seq").alias("seq")))


_PAD_SQL = with_(USER_SERIES, f"""
s AS (SELECT user_id, pos,
        LIST({_cents('value')} || ':' || pos) OVER (PARTITION BY user_id ORDER BY pos
             ROWS BETWEEN {_SEQ_L - 1} PRECEDING AND CURRENT ROW) AS l
      FROM user_series)""") + f"""
SELECT user_id, pos,
  ARRAY_TO_STRING(LIST_CONCAT(LIST_TRANSFORM(RANGE({_SEQ_L} - LEN(l)), lambda i: '0:0'), l), ';') AS seq
FROM s"""


@query("padded_sequences", _PAD_SQL)
def padded_sequences(spark, sf_dir):
    """Scoring sequences including the current row, zero-padded at the
    start of each series (W28)."""
    us = user_series(spark, sf_dir).select("user_id", "pos", "value")
    s = W.padded_sequences(us, USERS, ["value", "pos"], _SEQ_L)
    return s.select("user_id", "pos", _seq_text("seq").alias("seq"))
