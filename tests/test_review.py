"""Cases of the last review: statistics per key and validation by id."""

import math
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.operators.profile import boxplot, outliers, percentiles, qq_grid  # noqa: E402
from tidemark.operators.series import SeriesSpec  # noqa: E402
from tidemark.operators.strategy import vol_strategy  # noqa: E402
from tidemark.operators.windows import acf  # noqa: E402
from tidemark.streaming.momentum import validate_batch  # noqa: E402


def test_acf_of_a_panel_is_that_of_each_key(spark):
    rows = [(k, i, base + (i * 7 % 5)) for k, base in (("a", 0.0), ("b", 100.0)) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i long, x double")
    panel = acf(df, SeriesSpec(key=("k",), order="i"), "x", [1, 2]).collect()
    one = {r.lag: r for r in acf(df.where("k = 'a'"), SeriesSpec(order="i"), "x", [1, 2]).collect()}
    assert len(panel) == 4
    for r in panel:
        assert r.acf == pytest.approx(one[r.lag].acf, abs=1e-9) and r.bound == one[r.lag].bound


def test_batches_are_validated_by_id(spark):
    ids = spark.createDataFrame([(1, 7), (1, 8), (2, 9), (3, 5), (5, None)], "b long, id long")
    pred = spark.createDataFrame([(1, 7, 0.1), (1, 7, 0.2), (2, 9, 1.0), (3, 5, None), (4, 6, 1.0), (5, None, 1.0)], "b long, id long, prediction double")
    got = {r.b: r.valid for r in validate_batch(pred, ids, "id", "b").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_volatility_of_a_row_does_not_hold_its_own_return(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 11)) for i in range(30)], "i long, x double")
    now = {r.i: r.rolling_vol for r in vol_strategy(df, SeriesSpec(order="i"), "x", 5, lag_input=0).collect()}
    late = {r.i: r.rolling_vol for r in vol_strategy(df, SeriesSpec(order="i"), "x", 5).collect()}
    assert min(now) == 4 and min(late) == 5 and len(late) == 25
    assert all(late[i] == pytest.approx(now[i - 1], abs=1e-12) for i in late)


def plan_of(df):
    return df._jdf.queryExecution().toString().lower()


def spread_out(spark):
    rows = [(None if i % 11 == 3 else float(i * 37 % 1009) ** 6, float(i % 4)) for i in range(2000)]
    return spark.createDataFrame(rows, "x double, y double")


@pytest.mark.parametrize("cells, few", [(4096, 1 << 17), (64, 3)])
def test_percentiles_from_counts_equal_those_of_all_values(spark, cells, few):
    probs, inf = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0), math.inf
    odd = [inf, -inf, math.nan, 1.0, 2.0, 1.7e308, -1.7e308, 5e-324, 0.0, None]
    rows = [(odd[i] if i < 10 else None, float(i % 3), float(i * 37 % 101) / 7, None, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = percentiles(df, df.columns, probs, cells, few)
    for c in df.columns:
        want = df.agg(F.percentile(c, list(probs))).first()[0] or [None] * len(probs)
        assert [str(x) for x in got[c]] == [str(x) for x in want]


def test_boxplot_gathers_no_values(spark):
    df = spread_out(spark)
    assert "percentile" not in plan_of(boxplot(df, "x"))
    row = boxplot(df, "x").first()
    want = df.agg(F.percentile("x", [0.25, 0.5, 0.75])).first()[0]
    assert [row.q1, row.median, row.q3] == want and row.fliers > 0
    assert boxplot(df.where("x IS NULL"), "x").count() == 0


def test_iqr_outliers_gather_no_values(spark):
    df = spread_out(spark)
    out = outliers(df, ["x", "y"], "iqr")
    assert "percentile" not in plan_of(out)
    q1, q3 = df.agg(F.percentile("x", [0.25, 0.75])).first()[0]
    far = df.where((F.col("x") < q1 - 1.5 * (q3 - q1)) | (F.col("x") > q3 + 1.5 * (q3 - q1))).count()
    assert {r.column: (r.outliers, r.n) for r in out.collect()} == {"x": (far, df.where("x IS NOT NULL").count()), "y": (0, 2000)} and far > 0


def test_qq_grid_gathers_no_values(spark):
    df, probs = spread_out(spark), (0.05, 0.5, 0.95)
    out = qq_grid(df, "x", probs)
    assert "percentile" not in plan_of(out)
    m, s, q = df.agg(F.avg("x"), F.stddev_samp("x"), F.percentile("x", list(probs))).first()
    assert [r.sample for r in out.orderBy("p").collect()] == pytest.approx([(x - m) / s for x in q], abs=1e-12)
