"""Report queries: profiles by family, insight flags, model comparison, rules
with a score, and sinks read back (see ``operators.report``)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tidemark.functions.columns import row_nulls
from tidemark.operators import missing as M
from tidemark.operators import profile as P
from tidemark.operators import report as R
from tidemark.operators import strategy as S
from tidemark.operators.series import restrict, windowed
from tidemark.operators.windows import roll
from tidemark.plans.feature_queries import market_targets
from tidemark.plans.fixtures_sql import DAILY_MARKET, WIDE_DAILY, WIDE_DAILY_NULLS, with_
from tidemark.plans.profile_queries import WD_COLS, WDN_COLS, _union
from tidemark.plans.registry import query, rounded
from tidemark.plans.strategy_queries import sharpe_sql
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import sinks
from tidemark.sources.tables import DAILY, daily_market, read_table, wide_daily, wide_daily_nulls

# --- schema, previews, batches (A17, P10, P5) --------------------------------------------------
_SP_SQL = with_(WIDE_DAILY) + """
SELECT 20 AS n_columns, 3 AS n_integer, 16 AS n_real, 1 AS n_other, COUNT(*) AS n_rows, MIN(date_id) AS id_min, MAX(date_id) AS id_max,
  MAX(date_id) - MIN(date_id) + 1 AS id_range FROM wide_daily"""


@query("schema_profile", _SP_SQL)
def schema_profile(spark, sf_dir):
    """Columns by kind, rows and id range of the wide table."""
    return R.schema_profile(wide_daily(spark, sf_dir), "date_id")


_PV_SQL = with_(DAILY_MARKET) + """
SELECT * FROM (SELECT date_id, ROUND(price, 4) AS price, 'first' AS part FROM daily_market ORDER BY date_id LIMIT 3)
UNION ALL SELECT * FROM (SELECT date_id, ROUND(price, 4) AS price, 'last' AS part FROM daily_market ORDER BY date_id DESC LIMIT 3)"""


@query("preview_rows", _PV_SQL)
def preview_rows(spark, sf_dir):
    """The first and last three days (P10)."""
    return rounded(R.preview(daily_market(spark, sf_dir).select("date_id", "price"), ["date_id"]), 4)


@query("batch_rows", "SELECT l_orderkey, l_linenumber, ROUND(l_quantity, 4) AS l_quantity FROM lineitem WHERE l_linenumber = 3")
def batch_rows(spark, sf_dir):
    """The rows of one batch id, filtered in the scan (P5)."""
    return rounded(R.batch_rows(read_table(spark, sf_dir, "lineitem"), "l_linenumber", 3).select("l_orderkey", "l_linenumber", "l_quantity"), 4)


# --- families (E3, E4, M9, M2, M8, K6, F12) --------------------------------------------------------
_FD_SQL = with_(WIDE_DAILY, "s AS (" + _union(
    f"SELECT '{c[0]}' AS family, AVG({c}) AS m, STDDEV_SAMP({c}) AS s, MIN({c}) AS lo, MAX({c}) AS hi FROM wide_daily" for c in WD_COLS) + ")") + """
SELECT family, COUNT(*) AS n_columns, ROUND(MIN(m), 6) AS min_mean, ROUND(MAX(m), 6) AS max_mean, ROUND(MIN(s), 6) AS min_std, ROUND(MAX(s), 6) AS max_std,
  ROUND(MIN(lo), 6) AS least, ROUND(MAX(hi), 6) AS greatest FROM s GROUP BY family"""


@query("family_describe", _FD_SQL)
def family_describe(spark, sf_dir):
    """Range of the statistics of each column family."""
    return rounded(R.family_describe(wide_daily(spark, sf_dir), WD_COLS))


_CC_SQL = with_(WIDE_DAILY_NULLS, "s AS (" + _union(f"SELECT '{c[0]}' AS family, COUNT(*) - COUNT({c}) AS nulls, (COUNT(*) - COUNT({c})) * 100.0 / COUNT(*) AS pct FROM wide_daily_nulls"
                                                    for c in WD_COLS) + ")") + """
SELECT family, COUNT(*) AS n_columns, COUNT(CASE WHEN nulls = 0 THEN 1 END) AS n_complete, ROUND(AVG(pct), 6) AS null_pct FROM s GROUP BY family"""


@query("complete_columns", _CC_SQL)
def complete_columns(spark, sf_dir):
    """Columns without a null, per family."""
    return rounded(R.complete_columns(wide_daily_nulls(spark, sf_dir), WD_COLS))


_NULLS = "n AS (" + _union(f"SELECT '{c}' AS column, COUNT(*) - COUNT({c}) AS null_count, (COUNT(*) - COUNT({c})) * 100.0 / COUNT(*) AS null_pct FROM wide_daily_nulls"
                           for c in WDN_COLS) + ")"


@query("sparse_report", with_(WIDE_DAILY_NULLS, _NULLS) + '\nSELECT "column", null_count, ROUND(null_pct, 6) AS null_pct FROM n WHERE null_pct > 30')
def sparse_report(spark, sf_dir):
    """Columns with more than 30 % nulls (M2)."""
    return rounded(M.sparse_columns(P.null_profile(wide_daily_nulls(spark, sf_dir), WDN_COLS)))


@query("fewest_nulls", with_(WIDE_DAILY_NULLS, _NULLS) + '\nSELECT "column", null_count, ROUND(null_pct, 6) AS null_pct FROM n ORDER BY null_count, "column" LIMIT 5')
def fewest_nulls(spark, sf_dir):
    """The five most complete columns, ties by name (K6)."""
    return rounded(P.rank_columns(P.null_profile(wide_daily_nulls(spark, sf_dir), WDN_COLS), "null_count", 5, ascending=True))


_RN_COLS = [c for c in WD_COLS if c != "D1"]


@query("row_null_counts", with_(WIDE_DAILY_NULLS) + "\nSELECT date_id, " + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _RN_COLS) + " AS n_nulls, " + ", ".join(
    f"CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in _RN_COLS) + " FROM wide_daily_nulls")
def row_null_counts(spark, sf_dir):
    """Null cells of each row and a flag per column."""
    wd = wide_daily_nulls(spark, sf_dir).select("date_id", *_RN_COLS)
    return M.missing_matrix(wd.withColumn("n_nulls", row_nulls(_RN_COLS).cast("int")), _RN_COLS)


# --- components and insights (E10, E9) -----------------------------------------------------------------
_COMPONENTS = ("market_forward_excess_returns", "forward_returns", "risk_free_rate")
_CS_SQL = with_(DAILY_MARKET, "m AS (SELECT *, forward_returns - risk_free_rate AS market_forward_excess_returns FROM daily_market)") + "\n" + _union(
    f"SELECT '{c}' AS component, COUNT({c}) AS count, ROUND(AVG({c}), 8) AS mean, ROUND(STDDEV_SAMP({c}), 8) AS std, ROUND(MIN({c}), 8) AS min, ROUND(MAX({c}), 8) AS max, "
    f"COUNT(CASE WHEN {c} > 0 THEN 1 END) AS n_positive, ROUND(COUNT(CASE WHEN {c} > 0 THEN 1 END) / CAST(COUNT({c}) AS DOUBLE), 8) AS positive_share FROM m" for c in _COMPONENTS)


@query("component_summary", _CS_SQL)
def component_summary(spark, sf_dir):
    """The target's components side by side."""
    return rounded(R.component_summary(market_targets(spark, sf_dir), _COMPONENTS), 8)


_IN_PAIRS = [(a, b) for i, a in enumerate(WD_COLS) for b in WD_COLS[i + 1:]]
_IN_SQL = with_(WIDE_DAILY, "x AS (SELECT * FROM wide_daily WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in WD_COLS) + "), al AS (" + _union(
    f"SELECT CORR({a}, {b}) AS r FROM x" for a, b in _IN_PAIRS) + "), nal AS (SELECT COUNT(CASE WHEN NOT ISNAN(r) AND ABS(r) > 0.8 THEN 1 END) AS n_alike FROM al), fc AS (" + _union(
    f"SELECT '{c}' AS f, {i} AS i, ABS(CORR({c}, target)) AS r FROM wide_daily" for i, c in enumerate(WD_COLS)) + "), best AS (SELECT f, r FROM fc WHERE r IS NOT NULL AND NOT ISNAN(r) ORDER BY r DESC, i LIMIT 1), "
    "g AS (SELECT target AS t, LAG(target) OVER (ORDER BY date_id) AS p FROM wide_daily), mo AS (SELECT AVG(target) AS m, STDDEV_POP(target) AS s FROM wide_daily), "
    "o AS (SELECT COUNT(t) AS n, SKEWNESS(t) AS skew, COUNT(CASE WHEN ABS(t - m) / s > 3 THEN 1 END) AS n_outliers, COUNT(CASE WHEN t > 0 THEN 1 END) * 100.0 / COUNT(t) AS pos, "
    "CORR(t, p) AS ac, CORR(ABS(t), ABS(p)) AS vac FROM g, mo), nu AS (SELECT SUM(" + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in [*WD_COLS, "target"])
    + f") * 100.0 / (COUNT(*) * {len(WD_COLS) + 1}) AS np FROM wide_daily)") + """
SELECT n, ROUND(np, 6) AS null_pct, ROUND(skew, 6) AS skew, n_outliers, ROUND(pos, 6) AS positive_pct, f AS best_feature, ROUND(r, 6) AS best_corr, n_alike, ROUND(ac, 6) AS autocorr,
  ROUND(vac, 6) AS vol_autocorr, ABS(skew) > 0.5 AS skewed, n_alike > 10 AS collinear, ABS(ac) > 0.1 AS dependent, vac > 0.3 AS clustered
FROM o, nu, best, nal"""


@query("insight_flags", _IN_SQL)
def insight_flags(spark, sf_dir):
    """What stands out in the wide table, in one row."""
    return rounded(R.insight_flags(wide_daily(spark, sf_dir), DAILY, "target", WD_COLS))


# --- model comparison (R15, A11, K5, R1) -------------------------------------------------------------------
_TYPES = {"zero": "constant", "last": "lagged", "trend": "lagged", "mean5": "rolling", "mean20": "rolling"}
_LOG_CTE = """
p AS (SELECT date_id, forward_returns AS y, risk_free_rate AS rf, CAST(0 AS DOUBLE) AS zero, LAG(forward_returns) OVER w AS last,
        2 * LAG(forward_returns) OVER w - LAG(forward_returns, 2) OVER w AS trend,
        AVG(forward_returns) OVER (ORDER BY date_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean5,
        AVG(forward_returns) OVER (ORDER BY date_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean20 FROM daily_market WINDOW w AS (ORDER BY date_id)),
g AS (""" + _union(f"SELECT '{m}' AS model, '{t}' AS type, y, rf, {m} AS yhat, CASE WHEN {m} > 0.003 THEN 1.8 WHEN {m} > 0 THEN 1.3 WHEN {m} < -0.003 THEN 0.2 WHEN {m} < 0 THEN 0.7 ELSE 1.0 END::DOUBLE AS a FROM p"
                   for m, t in _TYPES.items()) + """),
fit AS (SELECT model, type, COUNT(*) AS n, SQRT(AVG((y - yhat) * (y - yhat))) AS rmse, AVG(ABS(y - yhat)) AS mae, 1 - SUM((y - yhat) * (y - yhat)) / (VAR_POP(y) * COUNT(*)) AS r2,
        AVG(CASE WHEN y <> 0 THEN ABS((y - yhat) / y) END) * 100 AS mape FROM g WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY ALL),
sh AS (""" + sharpe_sql("g", "a", "y", "rf", "model").replace("ROUND(", "(").replace(", 6)", ")") + """),
t AS (SELECT f.model, type, n, rmse, mae, r2, mape, sharpe_ratio, annualized_return * 100 AS return_pct, annualized_volatility * 100 AS volatility_pct, volatility_ratio, exceeds_constraint,
        ROW_NUMBER() OVER (ORDER BY sharpe_ratio DESC, f.model) AS rank FROM fit f JOIN sh USING (model))"""


def _compared(spark, sf_dir):
    dm = daily_market(spark, sf_dir).withColumn("y", F.col("forward_returns"))

    def build(w):
        lag = lambda k: F.lag("y", k).over(w)
        return [F.lit(0.0).alias("zero"), lag(1).alias("last"), (2 * lag(1) - lag(2)).alias("trend"),
                F.avg("y").over(w.rowsBetween(-5, -1)).alias("mean5"), F.avg("y").over(w.rowsBetween(-20, -1)).alias("mean20")]

    log = R.by_model(windowed(dm, DAILY, build, before=20), {m: m for m in _TYPES}, ["date_id", "y", "y AS ret", "risk_free_rate AS rf"])
    runs = spark.createDataFrame([(m, t, None) for m, t in _TYPES.items()], "model string, type string, seconds double")  # nothing is fitted
    return log, R.model_table(log, runs, S.alloc_threshold("yhat"))


@query("model_table", with_(DAILY_MARKET, _LOG_CTE) + """
SELECT model, type, n, ROUND(rmse, 8) AS rmse, ROUND(mae, 8) AS mae, ROUND(r2, 6) AS r2, ROUND(sharpe_ratio, 6) AS sharpe_ratio, ROUND(return_pct, 6) AS return_pct,
  ROUND(volatility_pct, 6) AS volatility_pct, ROUND(volatility_ratio, 6) AS volatility_ratio, exceeds_constraint, rank FROM t""")
def model_table(spark, sf_dir):
    """Five forecasts of the next return compared by fit and risk."""
    return rounded(_compared(spark, sf_dir)[1].drop("seconds"), 6, rmse=8, mae=8)


@query("forecast_errors", with_(DAILY_MARKET, _LOG_CTE) + "\nSELECT model, n, ROUND(rmse, 8) AS rmse, ROUND(mae, 8) AS mae, ROUND(r2, 6) AS r2, ROUND(mape, 4) AS mape FROM t")
def forecast_errors(spark, sf_dir):
    """All regression metrics of the forecasts, mape among them."""
    return rounded(S.regression_metrics(_compared(spark, sf_dir)[0], "y", "yhat", by=["model"]), 6, rmse=8, mae=8, mape=4)


@query("top_per_type", with_(DAILY_MARKET, _LOG_CTE) + """
SELECT type, ARG_MIN(model, rank) AS model, ROUND(ARG_MIN(sharpe_ratio, rank), 6) AS sharpe_ratio, ROUND(ARG_MIN(r2, rank), 6) AS r2 FROM t GROUP BY type""")
def top_per_type(spark, sf_dir):
    """The best forecast of each type (K5)."""
    return rounded(R.top_per_type(_compared(spark, sf_dir)[1]).drop("seconds"))


@query("type_stats", with_(DAILY_MARKET, _LOG_CTE) + """
SELECT type, COUNT(*) AS n_models, ROUND(AVG(sharpe_ratio), 6) AS mean_sharpe, ROUND(STDDEV_SAMP(sharpe_ratio), 6) AS std_sharpe, ROUND(AVG(r2), 6) AS mean_r2 FROM t GROUP BY type""")
def type_stats(spark, sf_dir):
    """Mean and deviation of the forecasts of each type."""
    return rounded(R.type_stats(_compared(spark, sf_dir)[1]).drop("mean_seconds"))


# --- rules and scores (R9b, R10, R13) ------------------------------------------------------------------------
@query("two_level_rule", with_(WIDE_DAILY) + "\nSELECT date_id, CASE WHEN V1 > 14.5 THEN 0.5 ELSE 1.5 END::DOUBLE AS allocation FROM wide_daily")
def two_level_rule(spark, sf_dir):
    """0.5 above a volatility threshold, else 1.5."""
    return wide_daily(spark, sf_dir).select("date_id", R.alloc_two_level("V1", 14.5).alias("allocation"))


_VC_SQL = with_(DAILY_MARKET, """
v AS (SELECT date_id, STDDEV_SAMP(forward_returns) OVER (ORDER BY date_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS e,
             STDDEV_SAMP(forward_returns) OVER (ORDER BY date_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m FROM daily_market)""") + """
SELECT date_id, ROUND(LEAST(GREATEST(CASE WHEN 1.5 * e / m > 1.2 THEN 1.2 * m / e ELSE 1.5 END, 0), 2), 6) AS allocation FROM v"""


@query("volatility_cap", _VC_SQL)
def volatility_cap(spark, sf_dir):
    """An allocation of 1.5 cut where 20-day volatility would break the cap
    against 60-day volatility (R10)."""
    d = windowed(daily_market(spark, sf_dir), DAILY, lambda w: [roll("std", "forward_returns", w, n, 2).alias(f"v{n}") for n in (20, 60)], before=59)
    return rounded(d.select("date_id", S.vol_cap(F.lit(1.5), "v20", "v60").alias("allocation")))


_PS_SQL = with_(DAILY_MARKET, """
l AS (SELECT forward_returns AS r, LAG(forward_returns) OVER (ORDER BY date_id) AS p FROM daily_market),
a AS (SELECT 'simple' AS strategy, CASE WHEN p > 0 THEN 1.5 ELSE 0.5 END::DOUBLE AS a, r FROM l UNION ALL SELECT 'double', 2.0::DOUBLE, r FROM l UNION ALL SELECT 'hold', 1.0::DOUBLE, r FROM l),
g AS (SELECT strategy, COUNT(*) AS n, AVG(a * r) AS ms, AVG(r) AS mr, STDDEV_POP(a * r) AS ss, STDDEV_POP(r) AS sr FROM a WHERE r IS NOT NULL GROUP BY strategy),
z AS (SELECT *, (ms - mr) * SQRT(252) / ss AS raw, ss / sr AS ratio FROM g)""") + """
SELECT strategy, n, ROUND(raw, 6) AS raw_score, ROUND(ratio, 6) AS volatility_ratio, ratio > 1.2 AS too_volatile, ms < mr AS underperforms,
  ROUND(raw - CASE WHEN ratio > 1.2 THEN ratio - 1.2 ELSE 0 END - CASE WHEN ms < mr THEN ABS(raw) ELSE 0 END, 6) AS score FROM z"""


@query("penalised_scores", _PS_SQL)
def penalised_scores(spark, sf_dir):
    """Three strategies scored with penalties."""
    d = windowed(daily_market(spark, sf_dir), DAILY, lambda w: [F.lag("forward_returns", 1).over(w).alias("p")], before=1)
    d = d.select(S.alloc_simple("p").alias("simple"), F.lit(2.0).alias("double"), F.lit(1.0).alias("hold"), "forward_returns")
    log = R.by_model(d, {m: m for m in ("simple", "double", "hold")}, ["forward_returns"]).withColumnRenamed("model", "strategy")
    return rounded(R.penalised_score(log, "yhat", "forward_returns", by=["strategy"]))


# --- a range with its halo, sinks read back (P4, S5, S7, S8, S10, J1) ---------------------------------------------
_RR_SQL = with_(DAILY_MARKET, """
v AS (SELECT date_id, AVG(forward_returns) OVER (ORDER BY date_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM daily_market)""") + """
SELECT date_id, ROUND(m, 8) AS mean20 FROM v WHERE date_id BETWEEN 500 AND 900"""


@query("restricted_rolling", _RR_SQL)
def restricted_rolling(spark, sf_dir):
    """A 20-day mean for a range of days, from those days and 19 before."""
    out = restrict(daily_market(spark, sf_dir).select("date_id", "forward_returns"), DAILY, 500, 900, 19,
                   lambda d: windowed(d, DAILY, lambda w: [roll("mean", "forward_returns", w, 20).alias("mean20")], before=19))
    return rounded(out.select("date_id", "mean20"), 8)


_PRED = "p AS (SELECT date_id, CASE WHEN forward_returns > 0.003 THEN 1.8 WHEN forward_returns > 0 THEN 1.3 WHEN forward_returns < -0.003 THEN 0.2 WHEN forward_returns < 0 THEN 0.7 ELSE 1.0 END::DOUBLE AS prediction FROM daily_market)"


@query("prediction_sink", with_(DAILY_MARKET, _PRED) + "\nSELECT COUNT(*) AS n, ROUND(AVG(prediction), 6) AS mean, ROUND(STDDEV_SAMP(prediction), 6) AS std, ROUND(MIN(prediction), 6) AS min, "
       "ROUND(MAX(prediction), 6) AS max, ROUND(MEDIAN(prediction), 6) AS median, " + ", ".join(
           f"COUNT(CASE WHEN prediction >= {lo} AND prediction < {lo + 0.5} THEN 1 END) AS bin_{i}" for i, lo in enumerate((0.0, 0.5, 1.0, 1.5))) + " FROM p")
def prediction_sink(spark, sf_dir):
    """Predictions beside their ids, written, read back and summed up."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"predictions-{uuid.uuid4().hex}")
    dm = daily_market(spark, sf_dir)
    pred = dm.select("date_id", S.allocate("forward_returns", "threshold").alias("prediction"))
    sinks.write_predictions(sinks.attach_ids(pred, dm.select("date_id"), "date_id"), path, ["date_id"])
    return rounded(sinks.summarize_sink(spark, path))


@query("csv_round_trip", with_(DAILY_MARKET, _PRED) + "\nSELECT date_id, ROUND(prediction, 6) AS prediction FROM p")
def csv_round_trip(spark, sf_dir):
    """A result table as CSV and a list of its columns as JSON, read back."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"results-{uuid.uuid4().hex}")
    rows = daily_market(spark, sf_dir).select("date_id", S.allocate("forward_returns", "threshold").alias("prediction"))
    sinks.write_csv(rows, f"{path}/table")
    sinks.write_names(spark, rows.columns, f"{path}/names")
    back = spark.read.schema(rows.schema).option("header", True).csv(f"{path}/table")
    return rounded(back.select(*sinks.read_names(spark, f"{path}/names")))


# --- stages that save and load (UD4, S9) --------------------------------------------------------------------------
_ST_COLS = [c for c in WD_COLS if c != "D1"]
_ST_SQL = with_(WIDE_DAILY_NULLS, "md AS (SELECT " + ", ".join(f"MEDIAN({c}) AS m_{c}" for c in _ST_COLS) + " FROM wide_daily_nulls WHERE date_id < 1500)",
                "fl AS (SELECT date_id, " + ", ".join(f"COALESCE({c}, m_{c}) AS {c}" for c in _ST_COLS) + " FROM wide_daily_nulls, md)",
                "sd AS (SELECT " + ", ".join(f"AVG({c}) AS a_{c}, STDDEV_POP({c}) AS s_{c}" for c in _ST_COLS) + " FROM fl WHERE date_id < 1500)") + \
    "\nSELECT date_id, " + ", ".join(f"ROUND(({c} - a_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in _ST_COLS) + " FROM fl, sd"


@query("fitted_stages", _ST_SQL)
def fitted_stages(spark, sf_dir):
    """Median filling and scaling fitted on the first 1,500 days, saved, loaded
    and applied to all (UD4, S9, M5, L5)."""
    from pyspark.ml import Pipeline, PipelineModel

    from tidemark.operators.stages import FillMedian, ScaleColumns

    path = os.path.join(ensure_checkpoint_dir(spark), f"stages-{uuid.uuid4().hex}")
    rows = wide_daily_nulls(spark, sf_dir).select("date_id", *_ST_COLS)
    Pipeline(stages=[FillMedian(inputCols=_ST_COLS), ScaleColumns(inputCols=_ST_COLS)]).fit(rows.where("date_id < 1500")).write().save(path)
    return rounded(PipelineModel.load(path).transform(rows))


# --- quantiles by rank (A4, A5) ------------------------------------------------------------------------------------
_Q_COLS, _Q_PROBS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)


@query("quantiles_by_rank", _union(f"SELECT '{c}' AS column, {p}::DOUBLE AS prob, ROUND(QUANTILE_CONT({c}, {p}), 6) AS value FROM lineitem" for c in _Q_COLS for p in _Q_PROBS))
def quantiles_by_rank(spark, sf_dir):
    """Exact quantiles of the line items from numbered ranges of 8,192 rows (A4, A5)."""
    return rounded(P.quantiles(read_table(spark, sf_dir, "lineitem"), _Q_COLS, _Q_PROBS, block_rows=8192))
