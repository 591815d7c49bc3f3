"""Strategy, allocation and risk-metric queries over the daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import lit_d
from tidemark.operators import strategy as S
from tidemark.plans.fixtures_sql import DAILY_MARKET, with_
from tidemark.plans.registry import query, rounded
from tidemark.sources.tables import DAILY, daily_market

SHARPE_COLS = ("sharpe_ratio, annualized_return, annualized_volatility, volatility_ratio, "
               "exceeds_constraint, mean_allocation, std_allocation, n_days")


def sharpe_sql(src: str, alloc: str, ret: str, rf: str | None, by: str = "", max_ratio: float = 1.2,
               ddof: int = 0) -> str:
    """Oracle text of ``strategy.sharpe`` over a relation ``src``."""
    std = "STDDEV_POP" if ddof == 0 else "STDDEV_SAMP"
    ex = f"{alloc} * {ret}" + (f" - {rf}" if rf else "")
    keep = f"{alloc} IS NOT NULL AND {ret} IS NOT NULL" + (f" AND {rf} IS NOT NULL" if rf else "")
    sel_by = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""
SELECT {sel_by}
  ROUND(CASE WHEN s > 0 THEN m / s * SQRT(252) ELSE 0 END, 6) AS sharpe_ratio,
  ROUND(m * 252, 6) AS annualized_return,
  ROUND(s * SQRT(252), 6) AS annualized_volatility,
  ROUND(CASE WHEN ms > 0 THEN s / ms ELSE 0 END, 6) AS volatility_ratio,
  (CASE WHEN ms > 0 THEN s / ms ELSE 0 END) > {max_ratio} AS exceeds_constraint,
  ROUND(ma, 6) AS mean_allocation, ROUND(sa, 6) AS std_allocation, n_days
FROM (
  SELECT {sel_by}AVG(ex) AS m, {std}(ex) AS s, {std}(r) AS ms, AVG(a) AS ma, {std}(a) AS sa,
         COUNT(*) AS n_days
  FROM (SELECT {sel_by}{ex} AS ex, {ret} AS r, {alloc} AS a FROM {src} WHERE {keep}) q{grp}) z"""


MOMENTUM_SQL = with_(DAILY_MARKET, """
a AS (
  SELECT *, CASE WHEN COUNT(forward_returns) OVER w >= 5
                 THEN CASE WHEN AVG(forward_returns) OVER w > 0 THEN 1.5 ELSE 0.5 END
                 ELSE 1.0 END AS allocation
  FROM daily_market
  WINDOW w AS (ORDER BY date_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""") + sharpe_sql(
    "a", "allocation", "forward_returns", "risk_free_rate")


@query("momentum_sharpe", MOMENTUM_SQL)
def momentum_sharpe(spark, sf_dir):
    """Minimum slice: daily series -> momentum allocation from the previous 5
    returns -> Sharpe with risk-free rate (W2, W10, R8b, R3)."""
    dm = daily_market(spark, sf_dir)
    a = S.momentum_allocation(dm, DAILY, "forward_returns", 5, lag_input=1)
    return rounded(S.sharpe(a, "allocation", "forward_returns", "risk_free_rate"))


def momentum_rows(spark, sf_dir):
    """Row-level form of the minimum slice (used by ``entry``)."""
    dm = daily_market(spark, sf_dir)
    return S.momentum_allocation(dm, DAILY, "forward_returns", 5, lag_input=1)


# --- allocation rules on a naive prediction (R4-R6c) -------------------------------------------
def predicted(spark, sf_dir):
    """Daily series with ``pred`` = the previous day's return (a naive
    forecast known at the start of the day)."""
    from tidemark.operators.series import windowed

    dm = daily_market(spark, sf_dir)
    return windowed(dm, DAILY, lambda w: [F.lag("forward_returns", 1).over(w).alias("pred")], before=1)


_PRED_SQL = with_(DAILY_MARKET, """
p AS (SELECT *, LAG(forward_returns) OVER (ORDER BY date_id) AS pred FROM daily_market)""")

_ALLOC_SQL = _PRED_SQL + """
SELECT date_id, ROUND(pred, 8) AS pred,
  CASE WHEN pred > 0 THEN 1.5 ELSE 0.5 END AS alloc_simple,
  CASE WHEN pred > 0.003 THEN 1.8 WHEN pred > 0 THEN 1.3 WHEN pred < -0.003 THEN 0.2 WHEN pred < 0 THEN 0.7
       ELSE 1.0 END AS alloc_threshold,
  CASE WHEN pred > 0.003 THEN 1.8 WHEN pred > 0 THEN 1.3 WHEN pred > -0.003 THEN 0.7 ELSE 0.2 END AS alloc_serving,
  CASE WHEN pred > 0.005 THEN 1.5 WHEN pred < -0.005 THEN 0.3 ELSE 1.0 END AS alloc_readme,
  ROUND(CASE WHEN pred IS NULL THEN NULL ELSE LEAST(GREATEST(
      CAST(0.2 AS DOUBLE) + CAST(1.6 AS DOUBLE) * (pred - CAST(-0.02 AS DOUBLE)) / CAST(0.04 AS DOUBLE), 0.0), 2.0) END, 6)
    AS alloc_fixed
FROM p"""


@query("alloc_rules", _ALLOC_SQL)
def alloc_rules(spark, sf_dir):
    """Simple, threshold, serving-threshold, three-level and fixed-bound
    proportional allocations of a prediction (R4, R5b, R6, R6b, R6c)."""
    p = predicted(spark, sf_dir)
    return rounded(p.select("date_id", "pred", S.alloc_simple("pred").alias("alloc_simple"),
                            S.alloc_threshold("pred").alias("alloc_threshold"),
                            S.alloc_threshold_serving("pred").alias("alloc_serving"),
                            S.alloc_readme("pred").alias("alloc_readme"),
                            S.alloc_fixed_bounds("pred").alias("alloc_fixed")), 6, pred=8)


_PROP_SQL = _PRED_SQL + """, b AS (SELECT MIN(pred) AS lo, MAX(pred) AS hi FROM p)
SELECT date_id, ROUND(LEAST(GREATEST(CASE WHEN hi > lo THEN CAST(0.2 AS DOUBLE) + CAST(1.6 AS DOUBLE) * (pred - lo)
  / (hi - lo) ELSE 1.0 END, 0.0), 2.0), 6) AS allocation
FROM p, b WHERE pred IS NOT NULL"""


@query("alloc_proportional", _PROP_SQL)
def alloc_proportional(spark, sf_dir):
    """Min-max proportional allocation over the prediction set."""
    p = predicted(spark, sf_dir).filter(F.col("pred").isNotNull())
    return rounded(S.alloc_proportional(p, "pred").select("date_id", "allocation"))


_SX_SQL = _PRED_SQL + """, a AS (SELECT *, forward_returns - risk_free_rate AS target,
  CASE WHEN pred > 0.003 THEN 1.8 WHEN pred > 0 THEN 1.3 WHEN pred < -0.003 THEN 0.2 WHEN pred < 0 THEN 0.7
       ELSE 1.0 END AS allocation FROM p)""" + sharpe_sql("a", "allocation", "target", None, max_ratio=1.5)


@query("sharpe_excess", _SX_SQL)
def sharpe_excess(spark, sf_dir):
    """Sharpe on the excess target with threshold allocation, 1.5 cap."""
    p = predicted(spark, sf_dir).withColumn("target", F.col("forward_returns") - F.col("risk_free_rate"))
    a = p.withColumn("allocation", S.alloc_threshold("pred"))
    return rounded(S.sharpe(a, "allocation", "target", None, max_ratio=1.5))


_SR_SQL = _SX_SQL.split(")" + sharpe_sql("a", "allocation", "target", None, max_ratio=1.5))[0] + ")" + \
    sharpe_sql("a", "allocation", "forward_returns", "risk_free_rate").replace("SQRT(252)", "SQRT(1)").replace(
        "m * 252", "m * 1")


@query("sharpe_raw", _SR_SQL)
def sharpe_raw(spark, sf_dir):
    """Un-annualised Sharpe (periods = 1) of the threshold allocation."""
    a = predicted(spark, sf_dir).withColumn("allocation", S.alloc_threshold("pred"))
    return rounded(S.sharpe(a, "allocation", "forward_returns", "risk_free_rate", periods=1))


_BH_SQL = with_(DAILY_MARKET, """
g AS (SELECT * FROM (VALUES (0.5), (1.0), (1.5), (2.0)) t(allocation)),
a AS (SELECT CAST(g.allocation AS DOUBLE) AS allocation, forward_returns, risk_free_rate FROM daily_market, g)""") + \
    sharpe_sql("a", "allocation", "forward_returns", "risk_free_rate", by="allocation")


@query("buy_hold_grid", _BH_SQL)
def buy_hold_grid(spark, sf_dir):
    """Constant allocations 0.5 / 1 / 1.5 / 2."""
    return rounded(S.buy_hold(daily_market(spark, sf_dir), "forward_returns", "risk_free_rate"))


def _mom_sql(n):
    return with_(DAILY_MARKET, f"""
a AS (SELECT *, CASE WHEN COUNT(forward_returns) OVER w >= {n}
                 THEN CASE WHEN AVG(forward_returns) OVER w > 0 THEN 1.5 ELSE 0.5 END ELSE 1.0 END AS allocation,
              CAST({n} AS BIGINT) AS lookback
      FROM daily_market WINDOW w AS (ORDER BY date_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))""") + \
        sharpe_sql("a", "allocation", "forward_returns", "risk_free_rate", by="lookback")


_MG_SQL = "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(_mom_sql(n) for n in (5, 10, 20)) + ")"


@query("momentum_grid", _MG_SQL)
def momentum_grid(spark, sf_dir):
    """Momentum strategy over 5/10/20 days (R8), one Sharpe row per window."""
    dm = daily_market(spark, sf_dir)
    parts = []
    for n in (5, 10, 20):
        a = S.momentum_allocation(dm, DAILY, "forward_returns", n, lag_input=1)
        parts.append(S.sharpe(a.withColumn("lookback", F.lit(n).cast("long")), "allocation", "forward_returns",
                              "risk_free_rate", by=["lookback"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


_VS_SQL = with_(DAILY_MARKET, """
v AS (SELECT *, CASE WHEN COUNT(forward_returns) OVER w >= 20 THEN STDDEV_SAMP(forward_returns) OVER w END AS rv
      FROM daily_market WINDOW w AS (ORDER BY date_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
f AS (SELECT * FROM v WHERE rv IS NOT NULL),
st AS (SELECT AVG(rv) AS vm, STDDEV_SAMP(rv) AS vs FROM f),
a AS (SELECT *, LEAST(GREATEST(CAST(1.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * ((rv - vm) / vs), CAST(0.2 AS DOUBLE)),
                      CAST(2.0 AS DOUBLE)) AS allocation FROM f, st)""") + \
    sharpe_sql("a", "allocation", "forward_returns", "risk_free_rate")


@query("vol_strategy", _VS_SQL)
def vol_strategy(spark, sf_dir):
    """Volatility-targeting allocation from the z-scored 20-day std."""
    a = S.vol_strategy(daily_market(spark, sf_dir), DAILY, "forward_returns", 20, lag_input=0)
    return rounded(S.sharpe(a, "allocation", "forward_returns", "risk_free_rate"))


_PR_SQL = with_(DAILY_MARKET) + """
SELECT date_id, ROUND(LEAD(price) OVER (ORDER BY date_id) / price - 1, 9) AS price_return FROM daily_market"""


@query("price_return", _PR_SQL)
def price_return(spark, sf_dir):
    """Forward return from prices ``p[t+1] / p[t] - 1``."""
    from tidemark.operators.series import windowed
    from tidemark.functions.columns import safe_div

    dm = daily_market(spark, sf_dir).select("date_id", "price")
    out = windowed(dm, DAILY, lambda w: [(safe_div(F.lead("price", 1).over(w), F.col("price")) - 1)
                                         .alias("price_return")], after=1)
    return rounded(out.select("date_id", "price_return"), 9)


_TB_SQL = with_(DAILY_MARKET, """
e AS (SELECT date_id, forward_returns - risk_free_rate AS ex FROM daily_market),
f AS (SELECT date_id, ex, CASE WHEN COUNT(ex) OVER w >= 1260 THEN AVG(ex) OVER w END AS m5
      FROM e WINDOW w AS (ORDER BY date_id ROWS BETWEEN 1259 PRECEDING AND CURRENT ROW)),
d AS (SELECT date_id, ex - m5 AS dm FROM f),
md AS (SELECT MEDIAN(dm) AS med FROM d),
mad AS (SELECT MEDIAN(ABS(dm - med)) AS mad, MAX(med) AS med FROM d, md)""") + """
SELECT date_id, ROUND(dm, 9) AS demeaned,
  ROUND(CASE WHEN dm IS NULL THEN NULL ELSE LEAST(GREATEST(dm, med - 4 * mad), med + 4 * mad) END, 9) AS target
FROM d, mad"""


@query("target_build", _TB_SQL)
def target_build(spark, sf_dir):
    """Target construction: excess return minus its five-year mean, then
    winsorised at median +- 4 MAD (R12, F18, W26)."""
    from tidemark.functions.columns import winsorize
    from tidemark.operators.series import windowed
    from tidemark.operators.windows import strict

    dm = daily_market(spark, sf_dir).select("date_id", (F.col("forward_returns") - F.col("risk_free_rate")).alias("ex"))
    d = windowed(dm, DAILY, lambda w: [strict("mean", "ex", w, 1260).alias("m5")], before=1259)
    d = d.select("date_id", (F.col("ex") - F.col("m5")).alias("demeaned"))
    med = d.agg(F.median("demeaned").alias("med"))
    d = d.crossJoin(F.broadcast(med))  # one row
    mad = d.agg(F.median(F.abs(F.col("demeaned") - F.col("med"))).alias("mad"))
    d = d.crossJoin(F.broadcast(mad))  # one row
    return rounded(d.select("date_id", "demeaned", winsorize("demeaned", "med", "mad", 4.0).alias("target")), 9)


_AS_SQL = _PRED_SQL + """, a AS (SELECT CASE WHEN pred > 0.003 THEN 1.8 WHEN pred > 0 THEN 1.3 WHEN pred < -0.003 THEN 0.2
  WHEN pred < 0 THEN 0.7 ELSE 1.0 END AS x FROM p)
SELECT COUNT(x) AS n, ROUND(AVG(x), 6) AS mean, ROUND(STDDEV_SAMP(x), 6) AS std, ROUND(MIN(x), 6) AS min,
  ROUND(MAX(x), 6) AS max, ROUND(MEDIAN(x), 6) AS median,
  COUNT(CASE WHEN x >= 0 AND x < 0.5 THEN 1 END) AS bin_0_05, COUNT(CASE WHEN x >= 0.5 AND x < 1.0 THEN 1 END) AS bin_05_1,
  COUNT(CASE WHEN x >= 1.0 AND x < 1.5 THEN 1 END) AS bin_1_15, COUNT(CASE WHEN x >= 1.5 AND x < 2.0 THEN 1 END) AS bin_15_2
FROM a"""


@query("allocation_summary", _AS_SQL)
def allocation_summary(spark, sf_dir):
    """Summary of an allocation column and its four half-open bins."""
    x = F.col("x")
    a = predicted(spark, sf_dir).select(S.alloc_threshold("pred").alias("x"))
    out = a.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                F.max(x).alias("max"), F.median(x).alias("median"),
                *[F.count(F.when((x >= lo) & (x < hi), 1)).alias(n) for n, lo, hi in
                  (("bin_0_05", 0.0, 0.5), ("bin_05_1", 0.5, 1.0), ("bin_1_15", 1.0, 1.5), ("bin_15_2", 1.5, 2.0))])
    return rounded(out)


_LB_SQL = "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS strategy, sharpe_ratio, annualized_return, annualized_volatility, volatility_ratio, "
    f"exceeds_constraint, mean_allocation, std_allocation, n_days FROM ({q})" for name, q in (
        ("buy_hold", with_(DAILY_MARKET, "a AS (SELECT *, CAST(1.0 AS DOUBLE) AS allocation FROM daily_market)")
         + sharpe_sql("a", "allocation", "forward_returns", "risk_free_rate")),
        ("momentum_5", MOMENTUM_SQL), ("volatility", _VS_SQL))) + """),
b AS (SELECT sharpe_ratio AS base FROM s WHERE strategy = 'buy_hold')
SELECT s.*, ROW_NUMBER() OVER (ORDER BY sharpe_ratio DESC, strategy) AS rank,
  ROUND((sharpe_ratio - base) * 100.0 / NULLIF(ABS(base), 0), 6) AS improvement_pct
FROM s, b"""


@query("leaderboard", _LB_SQL)
def leaderboard(spark, sf_dir):
    """Strategy leaderboard ranked by Sharpe with improvement over buy-and-hold
    (R11, K4, A15)."""
    dm = daily_market(spark, sf_dir)
    frames = {
        "buy_hold": rounded(S.sharpe(dm.withColumn("allocation", F.lit(1.0)), "allocation", "forward_returns",
                                     "risk_free_rate")),
        "momentum_5": momentum_sharpe(spark, sf_dir),
        "volatility": vol_strategy(spark, sf_dir),
    }
    lb = S.leaderboard(frames, "sharpe_ratio", base="buy_hold")
    return rounded(lb.withColumn("rank", F.col("rank").cast("long")))
