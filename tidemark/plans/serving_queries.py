"""Serving queries: streams replayed in parts, dispatch, user functions,
outcome codes, exact samples and expanding ranks (T2-T7, UD1, UD2, X4, X6, P12)."""

from __future__ import annotations

import os
import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidemark.functions.columns import lit_d
from tidemark.operators import features as X
from tidemark.operators import strategy as S
from tidemark.operators.expanding import expanding_rank
from tidemark.operators.sample import bottom_k
from tidemark.operators.windows import lag_features
from tidemark.plans.feature_queries import _fam_select
from tidemark.plans.fixtures_sql import DAILY_MARKET, USER_SERIES, WIDE_DAILY, with_
from tidemark.plans.registry import query, rounded
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.tables import DAILY, USERS, daily_market, read_table, user_series, wide_daily
from tidemark.streaming.serving import EpochSink, dispatch, reported, score, score_stream, serve

PARTS = ("pos <= 20", "pos BETWEEN 21 AND 45", "pos > 45", "pos % 10 = 0")  # the last one repeats rows: late
SERIES = "user_id long, pos long, x double"


def _folder(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _replay(rows, base: str, run) -> None:
    """Writes each part of ``rows`` to the source folder and runs the stream to
    its end, from its checkpoint: parts arrive in order at any file times."""
    for cond in PARTS:
        rows.where(cond).write.mode("append").parquet(f"{base}/source")
        run(rows.sparkSession.readStream.schema(SERIES).parquet(f"{base}/source"))


def _values(spark, sf_dir):
    return user_series(spark, sf_dir).select("user_id", "pos", (F.col("value") - 35).alias("x"))


def _served(spark, sf_dir):
    """The series scored on a stream by a saved model of the value before."""
    base = _folder(spark, "serve")
    _values(spark, sf_dir).write.parquet(f"{base}/rows")  # read for the model and by every part
    rows = spark.read.schema(SERIES).parquet(f"{base}/rows")
    train = lag_features(rows, USERS, ["x"], [1]).select("x", F.col("x_lag1").alias("lag_1")).dropna()
    model = Pipeline(stages=[VectorAssembler(inputCols=["lag_1"], outputCol="features"), LinearRegression(labelCol="x", solver="normal")]).fit(train)
    model.write().save(f"{base}/model")
    sink = EpochSink(spark, f"{base}/sink")

    def run(sdf):
        scored = score_stream(sdf, f"{base}/model", "user_id", "pos", "x", 1)
        serve(scored, lambda b: b.withColumn("prediction", F.coalesce("prediction", lit_d(0.0))), lambda b: b.select("key", "pos"),
              sink, f"{base}/checkpoint", "key", "pos", "late")

    _replay(rows, base, run)
    return sink


_LAGGED = """
l AS (SELECT user_id, pos, value - 35 AS x, LAG(value - 35) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM user_series)"""
_SS_SQL = with_(USER_SERIES, _LAGGED, """
m AS (SELECT REGR_SLOPE(x, p) AS a, REGR_INTERCEPT(x, p) AS b FROM l WHERE x IS NOT NULL AND p IS NOT NULL)""") + """
SELECT user_id, pos, ROUND(x, 6) AS x, ROUND(CASE WHEN p IS NULL THEN 0.0 ELSE a * p + b END, 6) AS prediction FROM l, m"""


@query("stream_scores", _SS_SQL)
def stream_scores(spark, sf_dir):
    """Scores of a saved pipeline on the replayed stream, features from state,
    equal to scoring the whole table (T2, T5, S9)."""
    rows = _served(spark, sf_dir).read("good", "key long, pos long, value double, prediction double")
    return rounded(rows.select(F.col("key").alias("user_id"), "pos", F.col("value").alias("x"), "prediction"))


_SL_SQL = with_(USER_SERIES) + "\nSELECT user_id, pos, ROUND(value - 35, 6) AS x FROM user_series WHERE pos % 10 = 0"


@query("stream_late_rows", _SL_SQL)
def stream_late_rows(spark, sf_dir):
    """Rows that came late, from the sink's own part."""
    rows = _served(spark, sf_dir).read("late", "key long, pos long, value double")
    return rounded(rows.select(F.col("key").alias("user_id"), "pos", F.col("value").alias("x")))


def _validated(spark, sf_dir):
    """A stream whose step loses, repeats, spoils or invents predictions."""
    base, rows = _folder(spark, "valid"), _values(spark, sf_dir)
    sink = EpochSink(spark, f"{base}/sink")
    fifth = F.col("user_id") % 5 == 0

    def step(b):
        x = F.when((F.col("pos") == 12) & fifth, F.lit(None).cast("double")).otherwise(F.col("x") * 2)
        made = b.select("user_id", "pos", x.alias("prediction")).where(~((F.col("pos") == 11) & fifth))
        twice = made.where((F.col("pos") == 13) & fifth)
        other = made.where((F.col("pos") == 30) & fifth).withColumn("user_id", -F.col("user_id") - 1)
        return made.union(twice).union(other)

    def run(sdf):
        serve(sdf, step, lambda b: b.select("user_id", "pos"), sink, f"{base}/checkpoint", "user_id", "pos")

    for cond in PARTS[:3]:
        rows.where(cond).write.mode("append").parquet(f"{base}/source")
        run(spark.readStream.schema(SERIES).parquet(f"{base}/source"))
    return sink


_FAULTS = """
h AS (SELECT pos, COUNT(*) AS n_rows, CASE WHEN MAX(user_id % 5 = 0) THEN CASE pos WHEN 11 THEN 'missing prediction' WHEN 12 THEN 'not a number'
             WHEN 13 THEN 'repeated id' WHEN 30 THEN 'unknown id' END END AS fault FROM user_series GROUP BY pos)"""
_SV_SQL = with_(USER_SERIES, _FAULTS) + """
SELECT user_id, pos, ROUND((value - 35) * 2, 6) AS prediction FROM user_series JOIN h USING (pos) WHERE fault IS NULL"""


@query("stream_validated", _SV_SQL)
def stream_validated(spark, sf_dir):
    """Predictions of the batches that are valid by id; others are not in the
    committed part (T2, T3, T6)."""
    return rounded(_validated(spark, sf_dir).read("good", "user_id long, pos long, prediction double"))


_SF_SQL = with_(USER_SERIES, _FAULTS) + "\nSELECT pos, fault FROM h WHERE fault IS NOT NULL"


@query("stream_faults", _SF_SQL)
def stream_faults(spark, sf_dir):
    """Batches that were refused, with the reason."""
    return _validated(spark, sf_dir).read("faults", "pos long, fault string")


# --- dispatch (T4) -------------------------------------------------------------------------------
def risky(frame):
    """A rule that fails on falling days."""
    if (frame["forward_returns"] < 0).any():
        raise ValueError("falling")
    return 1.0 + 100.0 * frame["forward_returns"]


_DF_SQL = with_(DAILY_MARKET) + """
SELECT date_id, ROUND(CASE date_id % 6
    WHEN 0 THEN CASE WHEN forward_returns > 0.003 THEN 1.8 WHEN forward_returns > 0 THEN 1.3 WHEN forward_returns < -0.003 THEN 0.2 WHEN forward_returns < 0 THEN 0.7 ELSE 1.0 END
    WHEN 1 THEN 1.0
    WHEN 2 THEN COALESCE(LEAST(GREATEST(1 + 300 * forward_returns, 0), 2), 1)
    WHEN 3 THEN CASE WHEN forward_returns < 0 THEN 1.0 ELSE COALESCE(LEAST(1 + 100 * forward_returns, 2), 1) END
    ELSE 1.0 END, 6) AS allocation,
  CASE date_id % 6 WHEN 2 THEN CASE WHEN forward_returns IS NULL THEN 'no result' END
    WHEN 3 THEN CASE WHEN forward_returns < 0 THEN 'ValueError: falling' WHEN forward_returns IS NULL THEN 'no result' END
    WHEN 4 THEN 'unknown strategy: astrology' WHEN 5 THEN 'no strategy' END AS allocation_reason
FROM daily_market"""


@query("dispatch_fallback", _DF_SQL)
def dispatch_fallback(spark, sf_dir):
    """Four rules by day, one of which fails on falling days, an unknown and a
    missing one: failures are neutral and say why (T4)."""
    names = F.array(*[F.lit(x) for x in ("threshold", "hold", "steep", "risky", "astrology")])
    dm = daily_market(spark, sf_dir).withColumn("strategy", F.try_element_at(names, (F.col("date_id") % 6 + 1).cast("int")))
    rules = {"threshold": S.alloc_threshold("forward_returns"), "hold": lit_d(1.0), "steep": lit_d(1.0) + lit_d(300.0) * F.col("forward_returns"), "risky": risky}
    return rounded(dispatch(dm, "strategy", rules, ["forward_returns"]).select("date_id", "allocation", "allocation_reason"))


# --- user functions (UD1, UD2) ---------------------------------------------------------------------
def as_scalar(frame):
    return 0.25


def as_list(frame):
    return [None if v != v else 2 * v + 1 for v in frame["x"].tolist()]


def as_array(frame):
    return (2 * frame["x"] + 1).to_numpy()


def as_series(frame):
    return 2 * frame["x"] + 1


def as_frame(frame):
    return frame.assign(prediction=2 * frame["x"] + 1)


_SH_SQL = with_(USER_SERIES) + """
SELECT form, user_id, pos, ROUND(CASE WHEN form = 'scalar' THEN 0.25 ELSE 2 * (value - 35) + 1 END, 6) AS prediction
FROM user_series, (VALUES ('scalar'), ('list'), ('array'), ('series'), ('frame')) f(form)"""


@query("score_hook", _SH_SQL)
def score_hook(spark, sf_dir):
    """A user's function that returns a scalar, list, array, series or frame
    for a batch (UD1, UD2)."""
    out = None
    for form, fn in (("scalar", as_scalar), ("list", as_list), ("array", as_array), ("series", as_series), ("frame", as_frame)):
        made = score(_values(spark, sf_dir), fn, ["x"]).select(F.lit(form).alias("form"), "user_id", "pos", "prediction")
        out = made if out is None else out.union(made)
    return rounded(out)


# --- outcome codes (T7, S6) --------------------------------------------------------------------------
_MESSAGES = """
m AS (SELECT event_id, CASE event_id % 9 WHEN 1 THEN 'Failed to connect to server after waiting 900 s' WHEN 2 THEN 'No listener for predict was registered'
    WHEN 3 THEN 'status: "Exception calling application: bad ' || event_type || '"' WHEN 4 THEN 'socket closed' WHEN 5 THEN 'too late'
    WHEN 6 THEN 'odd ids' WHEN 7 THEN 'disk full' WHEN 8 THEN '' END AS message,
  CASE event_id % 9 WHEN 1 THEN 'RuntimeError' WHEN 2 THEN 'RuntimeError' WHEN 3 THEN 'InactiveRpcError' WHEN 4 THEN 'InactiveRpcError' WHEN 5 THEN 'DeadlineError'
    WHEN 6 THEN 'ValidationError' WHEN 7 THEN 'OSError' END AS kind FROM events)"""
_RE_SQL = with_(_MESSAGES) + """
SELECT event_id, event_id % 9 = 0 AS "Succeeded", CASE event_id % 9 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 7 WHEN 6 THEN 6 WHEN 7 THEN 5 WHEN 8 THEN 0 END AS "ErrorType",
  CASE event_id % 9 WHEN 1 THEN 'SERVER_NEVER_STARTED' WHEN 2 THEN 'SERVER_MISSING_ENDPOINT' WHEN 3 THEN 'SERVER_RAISED_EXCEPTION' WHEN 4 THEN 'SERVER_CONNECTION_FAILED'
    WHEN 5 THEN 'GRPC_DEADLINE_EXCEEDED' WHEN 6 THEN 'INVALID_SUBMISSION' WHEN 7 THEN 'GATEWAY_RAISED_EXCEPTION' WHEN 8 THEN 'UNSPECIFIED' END AS "ErrorName",
  CASE event_id % 9 WHEN 2 THEN 'Server did not register a listener for predict' WHEN 3 THEN substr(message, 41, length(message) - 41) WHEN 1 THEN NULL WHEN 8 THEN NULL ELSE message END AS "ErrorDetails"
FROM m"""


@query("run_error_classes", _RE_SQL)
def run_error_classes(spark, sf_dir):
    """Run messages sorted into the eight outcome codes."""
    read_table(spark, sf_dir, "events").createOrReplaceTempView("tidemark_run_events")
    rows = spark.sql("WITH " + _MESSAGES.replace("FROM events", "FROM tidemark_run_events") + " SELECT * FROM m")
    return reported(rows, "message", "kind").drop("message", "kind")


# --- expanding ranks (X4, X6) --------------------------------------------------------------------------
_ER_SQL = with_(USER_SERIES) + """
SELECT a.user_id, a.pos, COUNT(CASE WHEN b.value < a.value THEN 1 END) AS value_less, COUNT(CASE WHEN b.value <= a.value THEN 1 END) AS value_most,
  COUNT(b.value) AS value_seen
FROM user_series a JOIN user_series b ON a.user_id = b.user_id AND b.pos <= a.pos GROUP BY a.user_id, a.pos"""


@query("expanding_rank_panel", _ER_SQL)
def expanding_rank_panel(spark, sf_dir):
    """Rank of each value among the values of its user so far, in blocks of 16
    rows, so that most counts cross blocks (X4)."""
    return expanding_rank(user_series(spark, sf_dir), USERS.with_blocks(16), ["value"]).select("user_id", "pos", "value_less", "value_most", "value_seen")


_RG_SQL = with_(WIDE_DAILY, f"""
f AS (SELECT date_id, {_fam_select(False)} FROM wide_daily),
q AS (SELECT date_id, feat_v_mean, ABS(feat_s_mean) AS s, QUANTILE_CONT(feat_v_mean, 0.75) OVER w AS q75, QUANTILE_CONT(feat_v_mean, 0.25) OVER w AS q25,
        QUANTILE_CONT(ABS(feat_s_mean), 0.9) OVER w AS q90 FROM f WINDOW w AS (ORDER BY date_id ROWS UNBOUNDED PRECEDING))""") + """
SELECT date_id, COALESCE(CAST(feat_v_mean > q75 AS INTEGER), 0) AS feat_high_vol, COALESCE(CAST(feat_v_mean < q25 AS INTEGER), 0) AS feat_low_vol,
  COALESCE(CAST(feat_v_mean > q75 OR feat_v_mean < q25 AS INTEGER), 0) AS feat_extreme_vol, COALESCE(CAST(s > q90 AS INTEGER), 0) AS feat_extreme_sentiment
FROM q"""


@query("regime_expanding", _RG_SQL)
def regime_expanding(spark, sf_dir):
    """Regime flags against the quantiles of the days so far, in blocks of 256
    rows (X4, X6)."""
    out = X.regime_flags(X.family_row_features(wide_daily(spark, sf_dir)), DAILY.with_blocks(256), "expanding")
    return out.select("date_id", "feat_high_vol", "feat_low_vol", "feat_extreme_vol", "feat_extreme_sentiment")


# --- exact samples (P12) ---------------------------------------------------------------------------------
_HASH = "md5('7|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR))"
_RS_SQL = f"""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY {_HASH}, l_orderkey, l_linenumber LIMIT 5000"""


@query("random_sample", _RS_SQL)
def random_sample(spark, sf_dir):
    """5,000 rows drawn by seeded hash, the same in any partitioning."""
    li = read_table(spark, sf_dir, "lineitem")
    return bottom_k(li, 5000, ["l_orderkey", "l_linenumber"], seed=7).select("l_orderkey", "l_linenumber", "l_quantity")


_RK_SQL = f"""SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem
QUALIFY ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY {_HASH}, l_orderkey, l_linenumber) <= 200"""


@query("random_sample_by_key", _RK_SQL)
def random_sample_by_key(spark, sf_dir):
    """200 rows of each return flag, drawn the same way."""
    li = read_table(spark, sf_dir, "lineitem")
    return bottom_k(li, 200, ["l_orderkey", "l_linenumber"], seed=7, by=["l_returnflag"]).select("l_returnflag", "l_orderkey", "l_linenumber")
