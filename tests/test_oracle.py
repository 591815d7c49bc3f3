"""Every query with an oracle twin must match DuckDB on the sf0.001 tables
(the driver checks sf0.01).  Slow nested-EWM queries run in their own test."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import compare  # noqa: E402

from tidemark.plans import ORACLE, QUERIES  # noqa: E402

SLOW = {"ewm_macd", "ewm_gaps"}
FAST = sorted(n for n in ORACLE if n not in SLOW)


def test_every_query_has_builder():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    r = compare(spark, duck, name, QUERIES[name], ORACLE[name], "/root/testdata/sf0.001")
    assert r["ok"], r.get("why", r)


@pytest.mark.parametrize("name", sorted(SLOW))
def test_ewm_queries_match_oracle(spark, duck, name):
    r = compare(spark, duck, name, QUERIES[name], ORACLE[name], "/root/testdata/sf0.001")
    assert r["ok"], r.get("why", r)
