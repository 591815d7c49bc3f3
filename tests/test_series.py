"""Invariance and pandas-parity tests for the block + halo core."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.operators.ewm import ewm
from tidemark.operators.series import SeriesSpec, ffill, prefix_sum, windowed, with_row_index


def _frame(spark, n=500, keys=3, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        m = n // (k + 1)
        t = np.sort(rng.choice(10 * m, size=m, replace=False))
        x = rng.normal(size=m)
        x[rng.integers(0, m, m // 10)] = np.nan
        rows.append(pd.DataFrame({"k": k, "t": t, "x": x}))
    pdf = pd.concat(rows, ignore_index=True)
    return pdf, spark.createDataFrame(pdf)


def test_row_index_matches_rank(spark):
    pdf, df = _frame(spark)
    for b in (7, 64, 100000):
        got = with_row_index(df, SeriesSpec(order="t", key="k", block_rows=b), "i").toPandas()
        got = got.sort_values(["k", "t"])
        exp = pdf.sort_values(["k", "t"]).groupby("k").cumcount().values
        assert (got["i"].values == exp).all()


def test_block_halo_equals_single_partition(spark):
    pdf, df = _frame(spark)
    res = []
    for b in (21, 50, 1 << 20):
        spec = SeriesSpec(order="t", key="k", block_rows=b)
        out = W.rolling(df, spec, ["x"], [5, 20], ["mean", "std", "max", "skew"], 1)
        out = W.lag_features(out, spec, ["x"], [1, 20]).orderBy("k", "t").toPandas()
        res.append(out)
    for r in res[1:]:
        pd.testing.assert_frame_equal(res[0], r, check_exact=False, rtol=1e-12)


def test_rolling_matches_pandas(spark):
    pdf, df = _frame(spark, keys=1)
    spec = SeriesSpec(order="t", key="k", block_rows=37)
    out = W.rolling(df, spec, ["x"], [10], ["mean", "std", "min", "skew", "kurt"], 1).orderBy("t").toPandas()
    r = pdf.sort_values("t")["x"].rolling(10, min_periods=1)
    for stat, ref in (("mean", r.mean()), ("std", r.std()), ("min", r.min()), ("skew", r.skew()), ("kurt", r.kurt())):
        got = out[f"x_rolling_{stat}_10"].astype(float).values
        np.testing.assert_allclose(got, ref.values, rtol=1e-7, atol=1e-9, equal_nan=True)


def test_prefix_sum_and_ffill(spark):
    pdf, df = _frame(spark, keys=2)
    spec = SeriesSpec(order="t", key="k", block_rows=13)
    out = prefix_sum(df, spec, {"cs": F.coalesce(F.col("x"), F.lit(0.0))})
    out = ffill(out, spec, ["x"], suffix="_ff").orderBy("k", "t").toPandas()
    p = pdf.sort_values(["k", "t"])
    np.testing.assert_allclose(out["cs"].values, p.groupby("k")["x"].apply(lambda s: s.fillna(0).cumsum()).values)
    np.testing.assert_allclose(out["x_ff"].values, p.groupby("k")["x"].ffill().values, equal_nan=True)


def test_ewm_matches_pandas_with_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1500)
    x[[0, 3]] = np.nan
    x[200:260] = np.nan
    x[900:1400] = np.nan
    pdf = pd.DataFrame({"t": np.arange(1500), "x": x})
    df = spark.createDataFrame(pdf)
    out = ewm(df, SeriesSpec(order="t", block_rows=101), "x", [2, 26], ["e2", "e26"]).orderBy("t").toPandas()
    for s, c in ((2, "e2"), (26, "e26")):
        ref = pdf["x"].ewm(span=s, adjust=False).mean().values
        np.testing.assert_allclose(out[c].astype(float).values, ref, rtol=1e-9, atol=1e-12, equal_nan=True)


def test_no_single_partition_exchange_over_rows(spark):
    """Row-level windows of one long series partition by block.  (The only
    single-partition step in ``with_row_index`` is the prefix over the
    per-block counts table, one row per block.)"""
    pdf = pd.DataFrame({"i": np.arange(1000), "x": np.random.default_rng(0).normal(size=1000)})
    df = spark.createDataFrame(pdf)
    spec = SeriesSpec(order="i", index="i", block_rows=50)
    out = windowed(df, spec, lambda w: [F.avg("x").over(w.rowsBetween(-9, 0)).alias("m")], before=9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    got = out.orderBy("i").toPandas()["m"].values
    np.testing.assert_allclose(got, pdf["x"].rolling(10, min_periods=1).mean().values)


def test_sign_runs_open_run(spark):
    pdf = pd.DataFrame({"t": range(9), "x": [1.0, 2.0, -1.0, np.nan, -2.0, 0.0, 3.0, 4.0, 5.0]})
    df = spark.createDataFrame(pdf)
    runs = W.sign_runs(df, SeriesSpec(order="t", block_rows=4), "x").orderBy("run").toPandas()
    # runs: [+,+] [-,-,0] [+,+,+ open] -> the open run is left out
    assert list(runs["length"]) == [2, 3]
    assert list(runs["positive"]) == [True, False]


def test_null_key_and_order_rows_stay(spark):
    """Rows with a null key or order value keep their place and their carry."""
    from tidemark.operators.series import SeriesSpec, prefix_sum, with_row_index

    rows = [(None, i, 1.0) for i in range(10)] + [("a", i, 2.0) for i in range(10)] + [("a", None, 5.0)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    spec = SeriesSpec(order="t", key="k", block_rows=3)
    ri = with_row_index(df, spec, "ri").collect()
    assert len(ri) == 21
    assert sorted(r.ri for r in ri if r.k is None) == list(range(10))
    assert sorted(r.ri for r in ri if r.k == "a") == list(range(11)) and [r.ri for r in ri if r.t is None] == [0]
    from pyspark.sql import functions as F

    got = {r.t: r.s for r in prefix_sum(df, spec, {"s": F.col("x")}).collect() if r.k is None}
    assert got == {i: float(i + 1) for i in range(10)}
