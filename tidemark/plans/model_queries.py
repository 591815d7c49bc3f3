"""Model queries (rows-only checks: algorithms differ from the reference)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import bins_right_closed, label_map
from tidemark.operators import models as ML
from tidemark.operators import strategy as S
from tidemark.operators.splits import ordered_split
from tidemark.plans.registry import query, rounded
from tidemark.plans.profile_queries import WD_COLS
from tidemark.sources.tables import DAILY, wide_daily

_FEATS = [c for c in WD_COLS if c not in ("M1",)]


XGB_ROUNDS = 100  # of the preset's 700, which has no early stop: each is a pass over the rows


def _train_test(spark, sf_dir):
    wd = wide_daily(spark, sf_dir).filter(F.col("target").isNotNull()).fillna(0.0, subset=_FEATS)
    return ordered_split(wd, DAILY, 0.8)


def _validated(name, rows, **overrides):
    return ML.fit_validated(name, rows, _FEATS, "target", DAILY, **overrides)


@query("gbt_score")
def gbt_score(spark, sf_dir):
    """Fit the early-stopping boosting preset (500 rounds at most) on the first
    80 % and score the last 20 % with threshold allocation (ML1, ML5, R6)."""
    d = _train_test(spark, sf_dir)
    fitted = _validated("lightgbm", d.filter(F.col("split") == "train")).model
    p = fitted.transform(d.filter(F.col("split") == "test"))
    return rounded(p.select("date_id", "target", "prediction", S.alloc_threshold("prediction").alias("allocation")))


@query("boosting_rounds")
def boosting_rounds(spark, sf_dir):
    """Training and validation error per round of the two presets that stop
    early, with the best round (ML1, ML3, ML5)."""
    train = _train_test(spark, sf_dir).filter(F.col("split") == "train")
    parts = [_validated(n, train).rounds.select(F.lit(n).alias("model"), "*") for n in ("lightgbm", "catboost")]
    return rounded(parts[0].union(parts[1]), 9)


def _forest(train):
    return ML.pipeline("random_forest", _FEATS, "target").fit(train)


@query("rf_score")
def rf_score(spark, sf_dir):
    """Random-forest preset (300 trees) in the weighted ensemble with the two
    boosting presets, one of 500 rounds at most with an early stop, one of 100
    of its 700 rounds: each model's prediction of the last 20 % and their sum at
    .4 / .3 / .3 (ML1, ML2, ML4, ML8)."""
    d = _train_test(spark, sf_dir)
    train, p = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test").select("date_id", "target", *_FEATS)
    watched = _validated("lightgbm", train).model
    p = watched.transform(p).drop("features").withColumnRenamed("prediction", "lightgbm")
    boosted = [ML.pipeline("xgboost", _FEATS, "target", prediction="xgboost", maxIter=XGB_ROUNDS).fit(train)]
    for fitted in (*boosted, _forest(train)):
        p = fitted.transform(p).drop("features")
    p = p.withColumnRenamed("prediction", "random_forest")
    return rounded(p.select("date_id", "target", "lightgbm", "xgboost", "random_forest",
                            S.ensemble(["lightgbm", "xgboost", "random_forest"]).alias("prediction")))


@query("importance")
def importance(spark, sf_dir):
    """Feature-importance ranking of the random-forest preset (ML9)."""
    return ML.importance(_forest(_train_test(spark, sf_dir).filter(F.col("split") == "train")), _FEATS)


@query("signal_class")
def signal_class(spark, sf_dir):
    """Three-class signal (bear / neutral / bull, cut at -0.3 and 0.3 of
    the target) and a forest classifier over it (ML7, F15, F16)."""
    d = _train_test(spark, sf_dir)
    lab = bins_right_closed(F.col("target"), [-1e300, -0.3, 0.3, 1e300], ["bear", "neutral", "bull"])
    d = d.withColumn("signal_name", lab).withColumn(
        "signal", label_map(F.col("signal_name"), {"bear": 0.0, "neutral": 1.0, "bull": 2.0}))
    fitted = ML.signal_classifier(_FEATS, "signal", trees=100).fit(d.filter(F.col("split") == "train"))
    p = fitted.transform(d.filter(F.col("split") == "test"))
    return p.select("date_id", "signal_name", "signal", "prediction")
