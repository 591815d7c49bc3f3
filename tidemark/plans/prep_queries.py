"""Data-preparation queries: imputation, forward fill, selection, scaling,
time-ordered splits and positional slices (M3-M7, L2, L5, U3, V1-V5, P8,
P11, S3, S4, U5, K9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import select as L
from tidemark.operators import splits as V
from tidemark.operators import strategy as S
from tidemark.operators.missing import MedianImputer
from tidemark.operators.series import SeriesSpec, ffill, slice_rows, take_evenly, windowed, with_row_index, is_sorted
from tidemark.plans.fixtures_sql import DAILY_MARKET, USER_SERIES, WIDE_DAILY, WIDE_DAILY_NULLS, with_
from tidemark.plans.profile_queries import WD_COLS
from tidemark.plans.registry import query, round_sig, rounded, sig_sql
from tidemark.sources.tables import DAILY, USERS, daily_market, read_table, user_series, wide_daily, wide_daily_nulls

_IMP_COLS = WD_COLS + ["target"]
_IMP_SQL = with_(WIDE_DAILY_NULLS, "lng AS (" + " UNION ALL ".join(
    f"SELECT date_id, '{c}' AS column, CAST({c} AS DOUBLE) AS value FROM wide_daily_nulls" for c in _IMP_COLS) + """),
st AS (SELECT "column", MEDIAN(value) AS med, AVG(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS nf
       FROM lng GROUP BY "column")""") + """
SELECT date_id, "column", ROUND(COALESCE(value, med), 6) AS value
FROM lng JOIN st USING ("column") WHERE nf <= 0.3"""


@query("impute_median", _IMP_SQL)
def impute_median(spark, sf_dir):
    """Drop columns with more than 30 % nulls, fill the rest with the median
    (fitted), long form (M1-M5)."""
    w = wide_daily_nulls(spark, sf_dir)
    model = MedianImputer(0.3).fit(w, _IMP_COLS)
    t = model.transform(w.select("date_id", *_IMP_COLS))
    keep = model.keep
    rows = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in keep)
    return rounded(t.selectExpr("date_id", f"stack({len(keep)}, {rows}) as (column, value)"))


_FF_SQL = with_(WIDE_DAILY_NULLS) + """
SELECT date_id, """ + ", ".join(
    f"ROUND(LAST_VALUE({c} IGNORE NULLS) OVER (ORDER BY date_id ROWS UNBOUNDED PRECEDING), 6) AS {c}"
    for c in ("E2", "M1", "P1")) + " FROM wide_daily_nulls"


@query("ffill", _FF_SQL)
def ffill_query(spark, sf_dir):
    """Forward fill over a 61-row gap, every-4th-row nulls and a leading gap
    (M7); block carry, no unbounded single-task window."""
    w = wide_daily_nulls(spark, sf_dir).select("date_id", "E2", "M1", "P1")
    return rounded(ffill(w, DAILY, ["E2", "M1", "P1"]))


_VR_SQL = with_(WIDE_DAILY, "v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, {i} AS k, VAR_SAMP({c}) AS variance FROM wide_daily" for i, c in enumerate(WD_COLS))
    + ")") + """
SELECT "column", {sig} AS score, ROW_NUMBER() OVER (ORDER BY {sig} DESC NULLS LAST, k) AS rank
FROM v""".replace("{sig}", sig_sql("variance"))


@query("variance_rank", _VR_SQL)
def variance_rank(spark, sf_dir):
    """Columns ranked by sample variance (L2); ties at the reported precision
    go to column order."""
    v = L.variance_scores(wide_daily(spark, sf_dir), WD_COLS).select("column", round_sig(F.col("variance")).alias("score"))
    return L.rank_scores(v, WD_COLS, "score")


_MI_COLS = WD_COLS
_MI_SQL = with_(WIDE_DAILY, "z AS (SELECT " + ", ".join(f"COALESCE(ROUND({c}, 9), 0.0) AS {c}" for c in _MI_COLS)
                + ", COALESCE(ROUND(target, 9), 0.0) AS y FROM wide_daily), q AS (SELECT " + ", ".join(
    f"QUANTILE_CONT({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q_{c}" for c in _MI_COLS + ["y"])
    + " FROM z), lng AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, LEN(LIST_FILTER(q_{c}, lambda t: t < {c})) AS bx, LEN(LIST_FILTER(q_y, lambda t: t < y)) AS bin_y"
    f" FROM z, q" for c in _MI_COLS) + """),
j AS (SELECT "column", bx, bin_y, COUNT(*) AS nxy FROM lng GROUP BY 1, 2, 3),
m AS (SELECT *, SUM(nxy) OVER (PARTITION BY "column") AS n, SUM(nxy) OVER (PARTITION BY "column", bx) AS nx,
             SUM(nxy) OVER (PARTITION BY "column", bin_y) AS ny FROM j),
s AS (SELECT "column", SUM(nxy / n * LN(nxy * n / (nx * ny))) AS mi FROM m GROUP BY 1),
o AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', {i})" for i, c in enumerate(_MI_COLS)) + """) t("column", k))
SELECT "column", ROUND(mi, 6) AS score, ROW_NUMBER() OVER (ORDER BY ROUND(mi, 9) DESC NULLS LAST, k) AS rank
FROM s JOIN o USING ("column")""")


@query("mi_rank", _MI_SQL)
def mi_rank(spark, sf_dir):
    """Binned (decile) mutual information with the target, ranked (L3); ties at
    nine decimals go to column order."""
    mi = rounded(L.mutual_info_scores(rounded(wide_daily(spark, sf_dir), 9), _MI_COLS, "target").withColumnRenamed("mutual_info", "score"), 9)
    return rounded(L.rank_scores(mi, _MI_COLS, "score"))


_SC_COLS = WD_COLS
_SC_SQL = with_(WIDE_DAILY, """
sp AS (SELECT *, CASE WHEN date_id < FLOOR((SELECT COUNT(*) FROM wide_daily) * 0.8) THEN 'train' ELSE 'test' END
              AS split FROM wide_daily),
st AS (SELECT """ + ", ".join(
    f"AVG(COALESCE(CAST({c} AS DOUBLE), 0.0)) AS m_{c}, STDDEV_POP(COALESCE(CAST({c} AS DOUBLE), 0.0)) AS s_{c}"
    for c in _SC_COLS) + " FROM sp WHERE split = 'train')") + "\nSELECT date_id, split, " + ", ".join(
    f"ROUND((COALESCE(CAST({c} AS DOUBLE), 0.0) - m_{c}) / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END), 6)"
    f" AS {c}" for c in _SC_COLS) + " FROM sp, st"


@query("scale_train_test", _SC_SQL)
def scale_train_test(spark, sf_dir):
    """80/20 ordered split and standardisation fitted on the train part with
    population std (V2, L5, M6)."""
    w = ordered = V.ordered_split(wide_daily(spark, sf_dir).select("date_id", *_SC_COLS), DAILY, 0.8)
    model = L.Scaler().fit(w.filter(F.col("split") == "train"), _SC_COLS)
    del ordered
    return rounded(model.transform(w).select("date_id", "split", *_SC_COLS))


_FU_SQL = with_(WIDE_DAILY, "c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, {i} AS k, CASE WHEN COUNT(CASE WHEN {c} IS NOT NULL AND target IS NOT NULL THEN 1 END) > 100"
    f" THEN CORR({c}, target) END AS r, VAR_SAMP({c}) AS v FROM wide_daily" for i, c in enumerate(WD_COLS)) + """),
rk AS (SELECT "column", ROW_NUMBER() OVER (ORDER BY ABS(r) DESC NULLS LAST, k) AS rc,
              ROW_NUMBER() OVER (ORDER BY v DESC NULLS LAST, k) AS rv FROM c)""") + """
SELECT "column" FROM rk WHERE rc <= 5 UNION SELECT "column" FROM rk WHERE rv <= 5"""


@query("feature_union", _FU_SQL)
def feature_union(spark, sf_dir):
    """Union of the top-5 by |correlation| and the top-5 by variance."""
    wd = wide_daily(spark, sf_dir)
    a = L.feature_scores(wd, WD_COLS, "target", "correlation")
    b = L.feature_scores(wd, WD_COLS, "target", "variance")
    return L.union_selected(a, b, 5)


# --- walk-forward (V3, V5, R1, A14) -----------------------------------------------------------------
_WF_SQL = with_(DAILY_MARKET, """
n AS (SELECT COUNT(*) AS n FROM daily_market),
f AS (SELECT range AS fold FROM range(5)),
b AS (SELECT fold, (fold + 1) * (n // 6) + n - 6 * (n // 6) AS train_end,
             LEAST((fold + 1) * (n // 6) + n - 6 * (n // 6) + n // 6, n) AS test_end FROM f, n),
j AS (SELECT b.fold, CASE WHEN d.date_id < b.train_end THEN 'train' ELSE 'test' END AS role, d.date_id
      FROM daily_market d JOIN b ON d.date_id < b.test_end)""") + """
SELECT fold, role, COUNT(*) AS rows, MIN(date_id) AS first, MAX(date_id) AS last FROM j GROUP BY fold, role"""


@query("walk_forward_folds", _WF_SQL)
def walk_forward_folds(spark, sf_dir):
    """Expanding walk-forward, 5 folds: train/test sizes and ranges (V3)."""
    j = V.walk_forward(daily_market(spark, sf_dir).select("date_id"), DAILY, 5)
    return j.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("date_id").alias("first"),
                                         F.max("date_id").alias("last"))


_FM_SQL = _WF_SQL.split("\nSELECT fold, role")[0].replace(
    "d.date_id\n      FROM daily_market d", "d.date_id, d.forward_returns AS y, d.pred\n      FROM p d").replace(
    "daily_market AS (", "daily_market AS (", 1) + """,
t AS (SELECT fold, y, pred FROM j WHERE role = 'test' AND y IS NOT NULL AND pred IS NOT NULL),
pf AS (SELECT fold, SQRT(AVG((y - pred) * (y - pred))) AS rmse,
              1 - SUM((y - pred) * (y - pred)) / (VAR_POP(y) * COUNT(*)) AS r2 FROM t GROUP BY fold),
g AS (SELECT SQRT(AVG((y - pred) * (y - pred))) AS global_rmse,
             1 - SUM((y - pred) * (y - pred)) / (VAR_POP(y) * COUNT(*)) AS global_r2 FROM t)
SELECT 'lag1' AS model, ROUND(global_rmse, 9) AS global_rmse, ROUND(global_r2, 9) AS global_r2,
  ROUND(AVG(rmse), 9) AS avg_rmse, ROUND(STDDEV_POP(rmse), 9) AS std_rmse, ROUND(AVG(r2), 9) AS avg_r2,
  ROUND(STDDEV_POP(r2), 9) AS std_r2
FROM pf, g GROUP BY global_rmse, global_r2"""
_FM_SQL = _FM_SQL.replace("n AS (SELECT COUNT(*) AS n FROM daily_market),",
                          "p AS (SELECT *, LAG(forward_returns) OVER (ORDER BY date_id) AS pred FROM daily_market),\n"
                          "n AS (SELECT COUNT(*) AS n FROM daily_market),")


@query("fold_metrics", _FM_SQL)
def fold_metrics(spark, sf_dir):
    """Walk-forward validation of the lag-1 forecast: pooled and per-fold
    RMSE / R2 with mean and population std over folds (V5, R1, A14)."""
    from tidemark.plans.strategy_queries import predicted

    p = predicted(spark, sf_dir).select("date_id", F.col("forward_returns").alias("y"), "pred")
    j = V.walk_forward(p, DAILY, 5).filter(F.col("role") == "test")
    per = S.regression_metrics(j, "y", "pred", by=["fold"])
    glob = S.regression_metrics(j, "y", "pred")
    agg = per.agg(F.avg("rmse").alias("avg_rmse"), F.stddev_pop("rmse").alias("std_rmse"),
                  F.avg("r2").alias("avg_r2"), F.stddev_pop("r2").alias("std_r2"))
    out = glob.select(F.lit("lag1").alias("model"), F.col("rmse").alias("global_rmse"),
                      F.col("r2").alias("global_r2")).crossJoin(agg)  # one row each
    return rounded(out, 9)


_LB_SQL = with_(DAILY_MARKET, """
t AS (SELECT date_id, f.range AS fold FROM daily_market, (SELECT UNNEST(range(0, MAX(date_id) // 50 + 1)) AS range FROM daily_market) f
      WHERE date_id BETWEEN 1000 + f.range * 50 - 250 AND 1000 + f.range * 50
        AND 1000 + f.range * 50 <= (SELECT MAX(date_id) FROM daily_market))""") + """
SELECT fold, CASE WHEN date_id = 1000 + fold * 50 THEN 'test' ELSE 'train' END AS role, COUNT(*) AS rows,
       MIN(date_id) AS first, MAX(date_id) AS last FROM t GROUP BY 1, 2"""


@query("walk_lookback", _LB_SQL)
def walk_lookback(spark, sf_dir):
    """Rolling-lookback walk-forward (250 rows back, a fold every 50 rows
    from row 1000) (V4)."""
    j = V.walk_lookback(daily_market(spark, sf_dir).select("date_id"), DAILY, 250, 1000, 50)
    return j.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("date_id").alias("first"),
                                         F.max("date_id").alias("last"))


# --- slices, samples, sortedness, distinct ids ------------------------------------------------------
_RS_SQL = with_(DAILY_MARKET) + "\nSELECT date_id, price FROM daily_market WHERE date_id >= 100 AND date_id < 200"


@query("row_slice", _RS_SQL)
def row_slice(spark, sf_dir):
    """Positional slice ``iloc[100:200]`` of the series."""
    return rounded(slice_rows(daily_market(spark, sf_dir).select("date_id", "price"), DAILY, 100, 200), 2)


_ES_SQL = with_(WIDE_DAILY, "n AS (SELECT COUNT(*) AS n FROM wide_daily)") + """
SELECT date_id, E1 FROM wide_daily, n
WHERE n <= 500 OR date_id IN (SELECT CAST(FLOOR(range * (n - 1) / 499.0) AS BIGINT) FROM range(500), n)"""


@query("even_sample", _ES_SQL)
def even_sample(spark, sf_dir):
    """Evenly spaced sample of 500 rows, ``linspace`` positions."""
    return take_evenly(wide_daily(spark, sf_dir).select("date_id", "E1"), DAILY, 500, "date_id")


_SO_SQL = with_(USER_SERIES) + """
SELECT COUNT(*) AS violations FROM (
  SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY pos) AS prev FROM user_series) q
WHERE prev > event_id"""


@query("sorted_check", _SO_SQL)
def sorted_check(spark, sf_dir):
    """Is ``event_id`` increasing in time order within each user? Count of
    violations (S3, K9)."""
    us = user_series(spark, sf_dir).select("user_id", "pos", "event_id")
    return is_sorted(us, USERS, "event_id").agg(F.count(F.lit(1)).alias("violations"))


_DI_SQL = """
SELECT user_id, MIN(ts) AS first_ts, ROW_NUMBER() OVER (ORDER BY MIN(ts), user_id) - 1 AS first_seen
FROM events GROUP BY user_id"""


@query("distinct_ids", _DI_SQL)
def distinct_ids(spark, sf_dir):
    """Distinct ids in first-seen order (S4, U5): one group-by, then
    positions from block counts (no single-partition row_number)."""
    e = read_table(spark, sf_dir, "events")
    firsts = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    return with_row_index(firsts, SeriesSpec(order="first_ts", tiebreak="user_id"), "first_seen")


_UB_SQL = with_(WIDE_DAILY) + """
SELECT COUNT(*) AS rows, COUNT(DISTINCT date_id) AS ids, ROUND(SUM(E2), 2) AS e2_sum FROM (
  SELECT date_id, E2 FROM wide_daily WHERE date_id < 1000 UNION ALL SELECT date_id, E2 FROM wide_daily WHERE date_id >= 1000)"""


@query("union_batches", _UB_SQL)
def union_batches(spark, sf_dir):
    """Vertical concat of two batches by column name with a schema check."""
    from tidemark.sources.sinks import union_batches as ub

    w = wide_daily(spark, sf_dir).select("date_id", "E2")
    u = ub([w.filter("date_id < 1000"), w.filter("date_id >= 1000").select("E2", "date_id")])
    return rounded(u.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("date_id").alias("ids"),
                         F.sum("E2").alias("e2_sum")), 2)
