"""The model queries have no SQL twin."""

import pytest

from conftest import SF_SMALL
from tidemark.plans import QUERIES
from tidemark.plans.model_queries import _FEATS


def test_rf_score_is_the_weighted_ensemble(spark):
    rows = QUERIES["rf_score"](spark, SF_SMALL).collect()
    assert rows
    for r in rows:
        assert r.prediction == pytest.approx(0.4 * r.lightgbm + 0.3 * r.xgboost + 0.3 * r.random_forest, abs=1e-5)
    assert len({round(r.lightgbm, 4) for r in rows}) > 1 and any(r.lightgbm != r.xgboost != r.random_forest for r in rows)
    assert {r.feature for r in QUERIES["importance"](spark, SF_SMALL).collect()} == set(_FEATS)
