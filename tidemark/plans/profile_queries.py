"""Profile / exploratory-statistics queries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import lit_d
from tidemark.operators import profile as P
from tidemark.operators.series import SeriesSpec
from tidemark.plans.fixtures_sql import DAILY_MARKET, USER_SERIES, WIDE_DAILY, WIDE_DAILY_NULLS, with_
from tidemark.plans.registry import query, rounded
from tidemark.sources.tables import DAILY, daily_market, read_table, user_series, wide_daily, wide_daily_nulls

WD_COLS = ["D1", "E1", "E2", "V1", "V2", "V3", "V4", "M1", "M2", "M3", "S1", "S2", "P1", "P2", "I1", "I2", "I3"]
WDN_COLS = ["date_id"] + WD_COLS + ["target"]
LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts):
    return "\nUNION ALL ".join(parts)


# --- describe_long (A1-A6, L6) -------------------------------------------------------------
_DESC_COLS = WD_COLS + ["target"]
_DESC_SQL = with_(WIDE_DAILY) + "\n" + _union(
    f"""SELECT '{c}' AS column, COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std,
  ROUND(MIN({c}), 6) AS min, ROUND(QUANTILE_CONT({c}, 0.25), 6) AS q25, ROUND(MEDIAN({c}), 6) AS median,
  ROUND(QUANTILE_CONT({c}, 0.75), 6) AS q75, ROUND(MAX({c}), 6) AS max,
  ROUND(CASE WHEN COUNT({c}) >= 3 THEN SKEWNESS({c}) END, 6) AS skew,
  ROUND(CASE WHEN COUNT({c}) >= 4 THEN KURTOSIS({c}) END, 6) AS kurt FROM wide_daily""" for c in _DESC_COLS)


@query("describe_long", _DESC_SQL)
def describe_long(spark, sf_dir):
    """Per-column describe with quartiles and corrected moments, long form
    (A1-A6, L6)."""
    return rounded(P.describe_long(wide_daily(spark, sf_dir), _DESC_COLS))


# --- null profile and blocks (A7, A8, M9, V1) -------------------------------------------------
_NULL_SQL = with_(WIDE_DAILY_NULLS) + "\n" + _union(
    f"SELECT '{c}' AS column, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count, "
    f"ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 6) AS null_pct FROM wide_daily_nulls" for c in WDN_COLS)


@query("null_profile", _NULL_SQL)
def null_profile(spark, sf_dir):
    """Null count and percent per column."""
    return rounded(P.null_profile(wide_daily_nulls(spark, sf_dir), WDN_COLS))


_NB_NULLS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in WDN_COLS)
_NB_SQL = with_(WIDE_DAILY_NULLS, f"""
b AS (SELECT *, date_id // ((SELECT COUNT(*) FROM wide_daily_nulls) // 10) AS block, {_NB_NULLS} AS nn
      FROM wide_daily_nulls)""") + f"""
SELECT CAST(block AS BIGINT) AS block, MIN(date_id) AS first, MAX(date_id) AS last,
       ROUND(SUM(nn) * 100.0 / (COUNT(*) * {len(WDN_COLS)}), 6) AS null_pct
FROM b WHERE block < 10 GROUP BY block"""


@query("null_blocks", _NB_SQL)
def null_blocks(spark, sf_dir):
    """Null percent per tenth of the series, remainder dropped."""
    return rounded(P.null_blocks(wide_daily_nulls(spark, sf_dir), DAILY, 10, WDN_COLS))


_NT_NULLS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in WDN_COLS)
_NT_SQL = with_(WIDE_DAILY_NULLS) + f"""
SELECT CAST(SUM({_NT_NULLS}) AS BIGINT) AS null_cells, COUNT(*) AS rows,
       ROUND(SUM({_NT_NULLS}) * 100.0 / (COUNT(*) * {len(WDN_COLS)}), 6) AS null_pct
FROM wide_daily_nulls"""


@query("null_total", _NT_SQL)
def null_total(spark, sf_dir):
    """Total null cells and their share."""
    return rounded(P.null_total(wide_daily_nulls(spark, sf_dir), WDN_COLS))


# --- distribution of l_extendedprice (A18, A19, E7, E8) ---------------------------------------
_H_SQL = """
WITH mm AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(CASE WHEN (hi - lo) / 20 > 0 THEN LEAST(FLOOR((l_extendedprice - lo) / ((hi - lo) / 20)), 19)
                 ELSE 0 END AS BIGINT) AS bin, lo, hi
      FROM lineitem, mm WHERE l_extendedprice IS NOT NULL)
SELECT bin, ROUND(lo + bin * (hi - lo) / 20, 4) AS lower, ROUND(lo + (bin + 1) * (hi - lo) / 20, 4) AS upper,
       COUNT(*) AS count
FROM b GROUP BY bin, lo, hi"""


@query("histogram", _H_SQL)
def histogram(spark, sf_dir):
    """20 equal-width bins of l_extendedprice."""
    li = read_table(spark, sf_dir, "lineitem")
    return rounded(P.histogram(li, "l_extendedprice", 20), 4)


_ECDF_SQL = """
SELECT ROUND(l_extendedprice, 2) AS l_extendedprice,
       ROUND(ROW_NUMBER() OVER (ORDER BY l_extendedprice) / COUNT(*) OVER (), 9) AS ecdf
FROM lineitem WHERE l_extendedprice IS NOT NULL"""


@query("ecdf", _ECDF_SQL)
def ecdf(spark, sf_dir):
    """Empirical CDF of l_extendedprice by sorted position."""
    li = read_table(spark, sf_dir, "lineitem")
    return rounded(P.ecdf(li, "l_extendedprice"), 9, l_extendedprice=2)


_BOX_SQL = """
WITH q AS (SELECT QUANTILE_CONT(l_extendedprice, 0.25) AS q1, MEDIAN(l_extendedprice) AS median,
                  QUANTILE_CONT(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3,
  ROUND(MIN(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END), 4)
    AS whisker_low,
  ROUND(MAX(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END), 4)
    AS whisker_high,
  COUNT(CASE WHEN NOT (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) THEN 1 END) AS fliers
FROM lineitem, q WHERE l_extendedprice IS NOT NULL GROUP BY q1, median, q3"""


@query("boxplot", _BOX_SQL)
def boxplot(spark, sf_dir):
    """Box-plot statistics of l_extendedprice."""
    return rounded(P.boxplot(read_table(spark, sf_dir, "lineitem"), "l_extendedprice"), 4)


_PROBS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
_QQ_SQL = "WITH st AS (SELECT AVG(l_extendedprice) AS m, STDDEV_SAMP(l_extendedprice) AS s FROM lineitem)\n" + _union(
    f"SELECT CAST({p!r} AS DOUBLE) AS p, ROUND(CAST({NormalDist().inv_cdf(p)!r} AS DOUBLE), 6) AS theoretical, "
    f"ROUND((QUANTILE_CONT(l_extendedprice, {p!r}) - MAX(m)) / MAX(s), 6) AS sample FROM lineitem, st" for p in _PROBS)


@query("qq_grid", _QQ_SQL)
def qq_grid(spark, sf_dir):
    """Normal Q-Q points of l_extendedprice on a fixed grid."""
    return rounded(P.qq_grid(read_table(spark, sf_dir, "lineitem"), "l_extendedprice", _PROBS))


# --- outliers, extremes, conditional counts (E1, E2, K2, A9) --------------------------------
_OZ_SQL = "WITH st AS (SELECT " + ", ".join(
    f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in LI_COLS) + " FROM lineitem)\n" + _union(
    f"SELECT '{c}' AS column, COUNT(CASE WHEN ABS({c} - m_{c}) / s_{c} > 3 THEN 1 END) AS outliers, COUNT({c}) AS n, "
    f"ROUND(COUNT(CASE WHEN ABS({c} - m_{c}) / s_{c} > 3 THEN 1 END) * 100.0 / COUNT({c}), 6) AS outlier_pct "
    f"FROM lineitem, st" for c in LI_COLS)


@query("outliers_z", _OZ_SQL)
def outliers_z(spark, sf_dir):
    """|z| > 3 outlier counts per lineitem measure."""
    return rounded(P.outliers(read_table(spark, sf_dir, "lineitem"), LI_COLS, "z"))


_OI_SQL = "WITH st AS (SELECT " + ", ".join(
    f"QUANTILE_CONT({c}, 0.25) AS a_{c}, QUANTILE_CONT({c}, 0.75) AS b_{c}" for c in LI_COLS) + " FROM lineitem)\n" + \
    _union(f"SELECT '{c}' AS column, COUNT(CASE WHEN {c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * "
           f"(b_{c} - a_{c}) THEN 1 END) AS outliers, COUNT({c}) AS n, ROUND(COUNT(CASE WHEN {c} < a_{c} - 1.5 * "
           f"(b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}) THEN 1 END) * 100.0 / COUNT({c}), 6) AS outlier_pct "
           f"FROM lineitem, st" for c in LI_COLS)


@query("outliers_iqr", _OI_SQL)
def outliers_iqr(spark, sf_dir):
    """IQR-fence outlier counts per lineitem measure."""
    return rounded(P.outliers(read_table(spark, sf_dir, "lineitem"), LI_COLS, "iqr"))


_EX_SQL = with_(DAILY_MARKET) + """
SELECT * FROM (SELECT 'largest' AS side, date_id, ROUND(forward_returns, 8) AS forward_returns FROM daily_market
  WHERE forward_returns IS NOT NULL ORDER BY forward_returns DESC, date_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'smallest' AS side, date_id, ROUND(forward_returns, 8) AS forward_returns
  FROM daily_market WHERE forward_returns IS NOT NULL ORDER BY forward_returns ASC, date_id LIMIT 5)"""


@query("extremes", _EX_SQL)
def extremes(spark, sf_dir):
    """Five largest and smallest daily returns with their date_id."""
    return rounded(P.extremes(daily_market(spark, sf_dir), "forward_returns", 5, ["date_id"]), 8)


_CC_SQL = with_(DAILY_MARKET, "st AS (SELECT AVG(forward_returns) AS m, STDDEV_SAMP(forward_returns) AS s "
                              "FROM daily_market)") + """
SELECT COUNT(forward_returns) AS n, COUNT(CASE WHEN forward_returns > 0 THEN 1 END) AS positive,
  COUNT(CASE WHEN forward_returns < 0 THEN 1 END) AS negative, COUNT(CASE WHEN forward_returns = 0 THEN 1 END) AS zero,
  COUNT(CASE WHEN forward_returns > m + 2 * s THEN 1 END) AS above_k_std,
  COUNT(CASE WHEN forward_returns < m - 2 * s THEN 1 END) AS below_k_std
FROM daily_market, st"""


@query("conditional_counts", _CC_SQL)
def conditional_counts(spark, sf_dir):
    """Positive / negative / zero / beyond 2 std counts of returns."""
    return P.conditional_counts(daily_market(spark, sf_dir), "forward_returns")


_VC_SQL = "SELECT 'event_type' AS column, CAST(event_type AS VARCHAR) AS value, COUNT(*) AS count FROM events GROUP BY 2"


@query("value_counts", _VC_SQL)
def value_counts(spark, sf_dir):
    """Value counts of events.event_type (A10)."""
    return P.value_counts(read_table(spark, sf_dir, "events"), ["event_type"])


# --- block statistics (E5, A16) ----------------------------------------------------------------
_ST_SQL = with_(DAILY_MARKET, """
c AS (SELECT forward_returns AS x, ROW_NUMBER() OVER (ORDER BY date_id) - 1 AS i FROM daily_market
      WHERE forward_returns IS NOT NULL),
b AS (SELECT x, i // ((SELECT COUNT(*) FROM c) // 5) AS block FROM c),
v AS (SELECT block, VAR_SAMP(x) AS var FROM b WHERE block < 5 GROUP BY block)""") + """
SELECT ROUND(VAR_POP(var), 12) AS var_of_vars, VAR_POP(var) < 0.0001 AS stationary FROM v"""


@query("stationarity_blocks", _ST_SQL)
def stationarity_blocks(spark, sf_dir):
    """Variance of five block variances of the returns and the stationarity
    flag (E5)."""
    return rounded(P.stationarity(daily_market(spark, sf_dir), DAILY, "forward_returns", 5), 12)


_QT_SQL = with_(DAILY_MARKET, """
b AS (SELECT *, LEAST(date_id // ((SELECT COUNT(*) FROM daily_market) // 4), 3) AS block FROM daily_market)""") + """
SELECT CAST(block AS BIGINT) AS block, MIN(date_id) AS first, MAX(date_id) AS last,
  ROUND(AVG(forward_returns), 8) AS mean, ROUND(STDDEV_SAMP(forward_returns), 8) AS std,
  ROUND(VAR_SAMP(forward_returns), 10) AS var
FROM b GROUP BY block"""


@query("quartile_trend", _QT_SQL)
def quartile_trend(spark, sf_dir):
    """Mean and std of returns per time quartile, remainder to the last."""
    return rounded(P.block_stats(daily_market(spark, sf_dir), DAILY, "forward_returns", 4, "last"), 8, var=10)


# --- correlation (A12, A13, L1, L7) --------------------------------------------------------------
_CR_SQL = with_(WIDE_DAILY, "c AS (" + _union(
    f"SELECT '{c}' AS column, {i} AS k, CORR({c}, target) AS corr, COUNT(CASE WHEN {c} IS NOT NULL AND target IS NOT "
    f"NULL THEN 1 END) AS pairs FROM wide_daily" for i, c in enumerate(WD_COLS)) + ")") + """
SELECT "column", ROUND(CASE WHEN pairs > 100 THEN corr END, 6) AS corr, pairs,
  ROW_NUMBER() OVER (ORDER BY ABS(ROUND(CASE WHEN pairs > 100 THEN corr END, 6)) DESC NULLS LAST, k) AS rank
FROM c"""


@query("corr_rank", _CR_SQL)
def corr_rank(spark, sf_dir):
    """Correlation of each family column with the target (> 100 pairs),
    ranked by |r| with ties in column order (A12, L1, K3)."""
    c = rounded(P.corr_with(wide_daily(spark, sf_dir), WD_COLS, "target", min_pairs=100))
    pos = F.create_map(*[x for i, col in enumerate(WD_COLS) for x in (F.lit(col), F.lit(i))])
    w = Window.orderBy(F.abs("corr").desc_nulls_last(), pos[F.col("column")])  # one row per column
    return c.withColumn("rank", F.row_number().over(w).cast("long"))


_CM_COLS = WD_COLS
_CM_PAIRS = [(a, b) for i, a in enumerate(_CM_COLS) for b in _CM_COLS[i + 1:]]
_CM_SQL = with_(WIDE_DAILY, "x AS (SELECT * FROM wide_daily WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in _CM_COLS) + ")") + "\n" + _union(
    f"SELECT '{a}' AS a, '{b}' AS b, ROUND(CORR({a}, {b}), 6) AS corr FROM x" for a, b in _CM_PAIRS)


@query("corr_matrix", _CM_SQL)
def corr_matrix(spark, sf_dir):
    """Correlation matrix on listwise-complete rows, long form."""
    return rounded(P.corr_matrix(wide_daily(spark, sf_dir), _CM_COLS))


_CP_SQL = with_(WIDE_DAILY, "x AS (SELECT * FROM wide_daily WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in _CM_COLS) + "), m AS (" + _union(
    f"SELECT '{a}' AS a, '{b}' AS b, CORR({a}, {b}) AS corr FROM x" for a, b in _CM_PAIRS) + ")") + \
    "\nSELECT a, b, ROUND(corr, 6) AS corr FROM m WHERE NOT ISNAN(corr) AND ABS(corr) > 0.8"


@query("corr_pairs", _CP_SQL)
def corr_pairs(spark, sf_dir):
    """Pairs with |r| > 0.8."""
    return rounded(P.corr_pairs(P.corr_matrix(wide_daily(spark, sf_dir), _CM_COLS), 0.8))


# --- moments and normality (F9, A6, E6) --------------------------------------------------------
_MC_SQL = with_(USER_SERIES) + """
SELECT user_id, COUNT(value) AS n, ROUND(SKEWNESS(value), 6) AS skew, ROUND(KURTOSIS(value), 6) AS kurt
FROM user_series GROUP BY user_id"""


@query("moments_corrected", _MC_SQL)
def moments_corrected(spark, sf_dir):
    """Bias-corrected skewness and excess kurtosis per user."""
    from tidemark.functions.columns import bias_corrected_kurt, bias_corrected_skew

    us = user_series(spark, sf_dir)
    g = us.groupBy("user_id").agg(F.count("value").alias("n"), F.skewness("value").alias("g1"),
                                  F.kurtosis("value").alias("g2"))
    return rounded(g.select("user_id", "n", bias_corrected_skew("g1", "n").alias("skew"),
                            bias_corrected_kurt("g2", "n").alias("kurt")))


_JB_SQL = with_(DAILY_MARKET, """
s AS (SELECT COUNT(forward_returns) AS n, AVG(forward_returns) AS m FROM daily_market),
mo AS (SELECT n, AVG(POWER(forward_returns - m, 2)) AS m2, AVG(POWER(forward_returns - m, 3)) AS m3,
              AVG(POWER(forward_returns - m, 4)) AS m4
       FROM daily_market, s WHERE forward_returns IS NOT NULL GROUP BY n)""") + """
SELECT n, ROUND(m3 / POWER(m2, 1.5), 6) AS g1, ROUND(m4 / (m2 * m2) - 3, 6) AS g2,
  ROUND(n / 6.0 * (POWER(m3 / POWER(m2, 1.5), 2) + POWER(m4 / (m2 * m2) - 3, 2) / 4.0), 6) AS jb,
  ROUND(EXP(-(n / 6.0 * (POWER(m3 / POWER(m2, 1.5), 2) + POWER(m4 / (m2 * m2) - 3, 2) / 4.0)) / 2.0), 6) AS p_value
FROM mo"""


@query("normality_jb", _JB_SQL)
def normality_jb(spark, sf_dir):
    """Jarque-Bera statistic of the daily returns (E6, re-aimed)."""
    return rounded(P.jarque_bera(daily_market(spark, sf_dir), "forward_returns"))
