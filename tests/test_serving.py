"""Streams, dispatch, user functions, committed sink, outcome codes, samples,
expanding ranks and EWM over blocks."""

import os
import sys
import uuid

import numpy as np
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# workers import the functions of this module by name
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])

from pyspark.sql import functions as F  # noqa: E402

from tidemark.operators.ewm import ewm, macd  # noqa: E402
from tidemark.operators.expanding import dominated, expanding_rank  # noqa: E402
from tidemark.operators.features import regime_flags  # noqa: E402
from tidemark.operators.sample import bottom_k  # noqa: E402
from tidemark.operators.series import SeriesSpec, take_evenly, with_row_index  # noqa: E402
from tidemark.session import ensure_checkpoint_dir  # noqa: E402
from tidemark.streaming import serving as V  # noqa: E402

NAN = float("nan")


def folder(spark):
    return os.path.join(ensure_checkpoint_dir(spark), f"test-{uuid.uuid4().hex}")


# --- expanding ranks -----------------------------------------------------------------------------------
def test_dominated_counts():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 200):
        when, value = np.sort(rng.integers(0, max(1, n // 3) + 1, n)), rng.integers(0, max(1, n // 4) + 1, n).astype(float)
        for strict in (True, False):
            want = [sum(when[j] < when[i] and (value[j] < value[i] or (not strict and value[j] == value[i])) for j in range(n)) for i in range(n)]
            assert dominated(when, value, strict).tolist() == want


def test_dominated_counts_in_groups():
    rng = np.random.default_rng(1)
    of = np.repeat(np.arange(40), rng.integers(1, 30, 40))
    when = np.concatenate([np.sort(rng.integers(0, 9, (of == g).sum())) for g in range(40)])
    value = rng.integers(0, 7, len(of)).astype(float)
    for strict in (True, False):
        want = np.concatenate([dominated(when[of == g], value[of == g], strict) for g in range(40)])
        assert dominated(when, value, strict, of).tolist() == want.tolist()


def test_expanding_rank_of_many_short_series_takes_few_cuts_and_groups(spark, monkeypatch):
    asked, real = [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, grid, *a: asked.append(len(grid)) or real(c, grid, *a))
    df = spark.range(3000).select((F.col("id") % 100).alias("k"), F.floor(F.col("id") / 100).alias("i"), (F.hash("id") % 50).cast("double").alias("x"))
    got = expanding_rank(df, SeriesSpec("i", "k", block_rows=8), ["x"])
    assert asked == [4]  # blocks of a series, not of the table
    rows = sorted((r.k, r.i, r.x, r.x_less, r.x_most, r.x_seen) for r in got.collect())
    for j in range(0, 3000, 30):
        x = [r[2] for r in rows[j: j + 30]]
        assert [r[3:] for r in rows[j: j + 30]] == [(sum(v < x[i] for v in x[: i + 1]), sum(v <= x[i] for v in x[: i + 1]), i + 1) for i in range(30)]


def series(spark, n=120):
    rng, rows = np.random.default_rng(4), []
    for key in ("a", "b", None):
        for i in range(n if key != "b" else 9):
            x = None if i % 13 == 5 else NAN if i % 17 == 3 else 7.0 if i % 3 == 0 else float(rng.integers(0, 40))
            rows.append((key, i, x))
    return rows, spark.createDataFrame(rows, "k string, i long, x double")


@pytest.mark.parametrize("block", [3, 16, 1000])
def test_expanding_rank_at_every_block_size(spark, block):
    rows, df = series(spark)
    got = {(r.k, r.i): (r.x_less, r.x_most, r.x_seen) for r in expanding_rank(df, SeriesSpec("i", "k", block_rows=block), ["x"]).collect()}
    assert len(got) == len(rows)
    for k, i, x in rows:
        seen = [v for q, j, v in rows if q == k and j <= i and v is not None and v == v]
        have = x is not None and x == x
        assert got[k, i] == ((sum(v < x for v in seen), sum(v <= x for v in seen), len(seen)) if have else (None, None, len(seen))), (k, i)


@pytest.mark.parametrize("block", [3, 1000])
def test_expanding_flags_do_not_see_the_future(spark, block):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=90), 1)
    v[7] = NAN
    df = spark.createDataFrame([(i, float(x), float(-x)) for i, x in enumerate(v)], "i long, feat_v_mean double, feat_s_mean double")
    got = {r.i: r for r in regime_flags(df, SeriesSpec("i", block_rows=block), "expanding").collect()}
    for i, x in enumerate(v):
        past = v[: i + 1][~np.isnan(v[: i + 1])]
        want = (0, 0, 0) if x != x else (int(x > np.quantile(past, .75)), int(x < np.quantile(past, .25)), int(abs(x) > np.quantile(np.abs(past), .9)))
        assert (got[i].feat_high_vol, got[i].feat_low_vol, got[i].feat_extreme_sentiment) == want, i
    cut = {r.i: r.feat_high_vol for r in regime_flags(df.where("i < 40"), SeriesSpec("i", block_rows=block), "expanding").collect()}
    assert all(cut[i] == got[i].feat_high_vol for i in cut)
    with pytest.raises(ValueError):
        regime_flags(df, SeriesSpec("i"), "tomorrow")


# --- EWM -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [1, 5, 1000])
def test_ewm_over_blocks_and_null_keys(spark, block):
    rows, df = series(spark)
    spec = SeriesSpec("i", "k", block_rows=block)
    got = {(r.k, r.i): r for r in ewm(df, spec, "x", [1, 2, 12], ["one", "two", "twelve"]).collect()}
    line = {(r.k, r.i): r for r in macd(df, spec, "x", prefix="").collect()}
    for key in ("a", "b", None):
        x = pd.Series([r[2] for r in rows if r[0] == key], dtype=float)
        want = {n: x.ewm(span=s, adjust=False).mean() for n, s in (("one", 1), ("two", 2), ("twelve", 12))}
        m = x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
        for i in range(len(x)):
            for n, w in want.items():
                v = getattr(got[key, i], n)
                assert (v is None) == bool(np.isnan(w[i])) and (v is None or v == pytest.approx(w[i], rel=1e-11))
            assert line[key, i].macd_signal == pytest.approx(m.ewm(span=9, adjust=False).mean()[i], rel=1e-9, abs=1e-12)
    assert ewm(df.limit(0), spec, "x", [3]).count() == 0


def test_ewm_after_a_long_gap(spark):
    x = [1.0] + [None] * 3000 + [5.0, 6.0]
    df = spark.createDataFrame(list(enumerate(x)), "i long, x double")
    got = {r.i: r.y for r in ewm(df, SeriesSpec("i", block_rows=100), "x", [2], ["y"]).collect()}
    want = pd.Series(x, dtype=float).ewm(span=2, adjust=False).mean()
    assert all(got[i] == pytest.approx(want[i]) for i in (0, 5, 2999, 3001, 3002))


def test_null_keys_and_odd_order_values(spark):
    df = spark.createDataFrame([(None, 0), (None, 1), (None, 2), ("a", 0), ("a", 1)], "k string, i long")
    d = with_row_index(df, SeriesSpec("i", "k"), "pos")
    assert take_evenly(d, SeriesSpec("i", "k"), 10, "pos").count() == 5
    odd = spark.createDataFrame([(x,) for x in (2.0, NAN, 1.0, float("inf"), None, float("-inf"), 1.5)], "x double")
    got = [r.x for r in with_row_index(odd, SeriesSpec("x", block_rows=2), "pos").orderBy("pos").collect()]
    assert got[0] is None and got[1] != got[1] and got[2:] == [float("-inf"), 1.0, 1.5, 2.0, float("inf")]


# --- sink, validation, stream --------------------------------------------------------------------------------
def test_a_replayed_epoch_adds_no_row(spark):
    sink = V.EpochSink(spark, folder(spark), "s")
    rows = spark.range(5)
    assert sink.write({"good": rows}, 0) and not sink.write({"good": rows}, 0) and sink.write({"good": rows}, 1)
    rows.write.parquet(f"{sink.path}/good/epoch=s-2")  # died before its manifest
    assert sink.read("good", "id long").count() == 10
    assert sink.write({"good": spark.range(3)}, 2) and sink.read("good", "id long").count() == 13
    assert V.EpochSink(spark, sink.path, "other").write({"good": rows}, 0) and sink.manifest().count() == 4
    assert V.EpochSink(spark, folder(spark)).read("good", "id long").count() == 0


def test_batch_faults(spark):
    ids = spark.createDataFrame([(1, 7), (1, 8), (2, 9), (3, 5), (5, None), (6, 1), (7, 1), (8, 1)], "b long, id long")
    pred = spark.createDataFrame([(1, 7, .1), (1, 7, .2), (2, 9, 1.), (3, 5, None), (4, 6, 1.), (5, None, 1.), (6, 1, 1.), (6, 2, 1.), (7, 1, 1.), (7, 1, 1.), (8, 1, NAN)], "b long, id long, prediction double")
    got = {r.b: r.fault for r in V.batch_faults(pred, ids, "id", "b").collect()}
    assert got == {1: "missing prediction", 2: None, 3: "not a number", 4: "no ids", 5: None, 6: "unknown id", 7: "repeated id", 8: "not a number"}
    for bad in ("b long, id long, guess double", "b long, id long, prediction string"):
        with pytest.raises(TypeError):
            V.batch_faults(spark.createDataFrame([], bad), ids, "id", "b")


def test_lags_from_state_equal_lags_of_the_table(spark):
    rng = np.random.default_rng(9)
    rows = [(u, p, None if (u + p) % 11 == 0 else float(rng.normal())) for u in range(4) for p in range(30)]
    base, sink = folder(spark), None
    sink = V.EpochSink(spark, f"{base}/sink")
    for lo, hi in ((0, 1), (1, 4), (4, 20), (20, 30)):
        part = [r for r in rows if lo <= r[1] < hi] + ([rows[2], rows[2]] if lo == 20 else [])
        spark.createDataFrame(part, "u long, p long, x double").write.mode("append").parquet(f"{base}/src")
        sdf = spark.readStream.schema("u long, p long, x double").parquet(f"{base}/src")
        V.serve(V.lag_stream(sdf, "u", "p", "x", 3), lambda b: b.withColumn("prediction", F.lit(1.0)), lambda b: b.select("key", "pos"), sink, f"{base}/ckpt", "key", "pos", "late")
    got = {(r.key, r.pos): (r.value, r.lag_1, r.lag_2, r.lag_3) for r in sink.read("good", "key long, pos long, value double, lag_1 double, lag_2 double, lag_3 double").collect()}
    x = {(u, p): v for u, p, v in rows}
    assert got == {(u, p): tuple(x.get((u, p - k)) for k in range(4)) for u, p, _ in rows}
    assert sorted((r.key, r.pos) for r in sink.read("late", "key long, pos long").collect()) == [(0, 2), (0, 2)]


def test_lags_of_many_keys_share_calls_and_stay_apart(spark):
    import inspect
    assert "buckets" in inspect.signature(V.lag_stream).parameters
    big = (1 << 60) + 1  # not a double
    keys = [None, 0, 1, big, big + 1, -7]
    rows = [(k, p, None if p == 3 else float(100 * i + p)) for i, k in enumerate(keys) for p in range(12)]
    base = folder(spark)
    sink = V.EpochSink(spark, f"{base}/sink")
    for lo, hi in ((0, 1), (1, 6), (6, 12)):
        part = [r for r in rows if lo <= r[1] < hi and (r[0] != 1 or lo != 1)] + [(k, 2, 5.0) for k in keys if lo == 6]
        spark.createDataFrame(part, "u long, p long, x double").write.mode("append").parquet(f"{base}/src")
        sdf = spark.readStream.schema("u long, p long, x double").parquet(f"{base}/src")
        V.serve(V.lag_stream(sdf, "u", "p", "x", 2, buckets=2), lambda b: b.withColumn("prediction", F.lit(1.0)), lambda b: b.select("key", "pos"), sink, f"{base}/ckpt", "key", "pos", "late")
    got = {(r.key, r.pos): (r.value, r.lag_1, r.lag_2) for r in sink.read("good", "key long, pos long, value double, lag_1 double, lag_2 double").collect()}
    want = {}
    for k in keys:
        own = [(p, x) for q, p, x in rows if q == k and (k != 1 or not 1 <= p < 6)]
        if k == 1:
            own.insert(1, (2, 5.0))  # its first row at 2 is not late
        for i, (p, x) in enumerate(own):
            want[k, p] = (x, *(own[i - j][1] if i >= j else None for j in (1, 2)))
    assert got == want
    assert sorted(str(r.key) for r in sink.read("late", "key long, pos long").collect()) == sorted(str(k) for k in keys if k != 1)


# --- user functions, dispatch, outcome ----------------------------------------------------------------------------
def half(frame):
    return [0.5] * (len(frame) // 2)


def words(frame):
    return ["x"] * len(frame)


def wide(frame):
    return frame.assign(a=1, b=2)


def good(frame):
    return frame["x"] + 1


def test_score_refuses_what_is_no_column(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    for fn, what in ((half, "values for"), (words, "not numbers"), (wide, "one column")):
        with pytest.raises(Exception, match=what):
            V.score(df, fn, ["x"]).collect()
    for fn in (lambda f: 1.0, "good", np.sum, None):
        with pytest.raises(TypeError):
            V.score(df, fn, ["x"])
    assert sorted(r.prediction for r in V.score(df, good, ["x"]).collect()) == [2.0, 3.0] and V.score(df.limit(0), good, ["x"]).count() == 0


def fails_on_two(frame):
    if (frame["x"] == 2).any():
        raise KeyError("two")
    return frame["x"] * 10


def test_dispatch_isolates_failures(spark):
    rows = [("call", 1.0), ("call", 2.0), ("call", 0.1), ("col", 0.5), ("col", None), ("col", NAN), ("none", 1.0), (None, 1.0), ("col", -4.0)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "s string, x double, allocation string").coalesce(1)
    got = [(r.allocation, r.allocation_reason) for r in V.dispatch(df, "s", {"call": fails_on_two, "col": F.col("x")}, ["x"]).collect()]
    assert got == [(2.0, None), (1.0, "KeyError: 'two'"), (1.0, None), (0.5, None), (1.0, "no result"), (1.0, "no result"), (1.0, "unknown strategy: none"), (1.0, "no strategy"), (0.0, None)]


def test_outcome_codes(spark):
    rows = [(None, None, None), ("", "", 0), ("Failed to connect to server after waiting 3", "gaierror", 1), ("gone", "InactiveRpcError", 2),
            ('x "Exception calling application: oh "no""', "InactiveRpcError", 3), ("No listener for predict was registered", "Any", 4), ("boom", "KeyError", 5),
            ("two ids", "ValidationError", 6), ("late", "DeadlineError", 7), ("y" * 9000, "OSError", 5)]
    df = spark.createDataFrame([(i, m, k, c) for i, (m, k, c) in enumerate(rows)], "i int, m string, k string, want int")
    for r in V.reported(df, "m", "k").collect():
        assert r.ErrorType == r.want and r.Succeeded == (r.want is None) and (r.ErrorDetails is None or len(r.ErrorDetails) <= 8000)
        assert r.ErrorName == (None if r.want is None else V.OUTCOMES[r.want])


# --- samples -----------------------------------------------------------------------------------------------------------
def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("k")).union(spark.createDataFrame([(9000, None), (9001, None)], "id long, k long"))
    few, many = (sorted(map(tuple, bottom_k(df.repartition(n), 40, ["id"], seed=3).collect()), key=str) for n in (3, 50))
    assert few == many and len(few) == 40
    assert few != sorted(map(tuple, bottom_k(df, 40, ["id"], seed=4).collect()), key=str)
    by = [sorted(map(tuple, bottom_k(df.repartition(n), 10, ["id"], by=["k"]).collect()), key=str) for n in (3, 50)]
    assert by[0] == by[1] and len(by[0]) == 32
    assert {r[0] for r in bottom_k(df, 20, ["id"]).collect()} <= {r[0] for r in bottom_k(df, 90, ["id"]).collect()} and bottom_k(df, 10**6, ["id"]).count() == 5002


# --- numbering by ranges ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [3, 20, 10_000])
def test_numbering_with_outliers_ties_and_dense_keys(spark, block):
    rng = np.random.default_rng(8)
    rows = [("dense", float(x), i) for i, x in enumerate(rng.normal(size=300))] + [("dense", 1e15, 900), ("dense", -1e12, 901), ("dense", None, 902), ("dense", NAN, 903)]
    rows += [("tied", 5.0, i) for i in rng.permutation(100).tolist()] + [("tied", float("inf"), 900), ("tied", float("-inf"), 901)]
    rows += [(f"small{k}", float(i), i) for k in range(20) for i in range(3)] + [(None, float(i % 7), i) for i in range(90)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, x double, t long, _n string").repartition(7)
    got = {(r.k, r.t): r.pos for r in with_row_index(df, SeriesSpec("x", "k", "t", block_rows=block), "pos").collect()}
    assert len(got) == len(rows)
    rank = lambda r: (r[1] is not None, r[1] is not None and r[1] == r[1], r[1] if r[1] is not None and r[1] == r[1] else 0.0, r[2])
    for k in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=rank)):
            assert got[k, r[2]] == i, r
    from tidemark.operators.series import ROOM, _cut_ranges

    if block == 20:  # no range is much fuller than a block
        d, cells = _cut_ranges(df, SeriesSpec("x", "k", "t", block_rows=block))
        assert d.groupBy("k", *cells).count().agg(F.max("count")).first()[0] <= ROOM * block
    text = spark.createDataFrame([(1.0, c) for c in "dacb" * 5], "x double, t string")
    assert [r.t for r in with_row_index(text, SeriesSpec("x", tiebreak="t", block_rows=2), "pos").orderBy("pos").collect()] == sorted("dacb" * 5)


# --- CSV source ----------------------------------------------------------------------------------------------------------
def test_bad_rows_of_a_csv_stream_go_to_quarantine(spark):
    from pyspark.sql import types as T

    from tidemark.sources.csv import bad_rows, good_rows, read_csv, with_id

    base = folder(spark).removeprefix("file:")
    os.makedirs(f"{base}/in")
    with open(f"{base}/in/a.csv", "w") as f:
        f.write("date_id,x,flag\n1,0.5,true\n2,NaN,false\nthree,1.0,true\n4,Infinity,true\n,2.0,false\n6,1.5\n7,,\n")
    schema = T.StructType([T.StructField("date_id", T.LongType(), False), T.StructField("x", T.DoubleType()), T.StructField("flag", T.BooleanType())])

    def check(good, bad):
        assert sorted(map(tuple, good.collect())) == [(1, 0.5, True), (2, None, False), (4, None, True), (7, None, None)]
        assert sorted(map(tuple, bad.select("line", "reason").collect()), key=str) == [("6,1.5", "does not fit the schema"), ("three,1.0,true", "does not fit the schema"), (None, "no date_id")]

    rows = read_csv(spark, f"{base}/in", schema)
    check(good_rows(rows, ("date_id",)), bad_rows(rows, ("date_id",)))
    sink = V.EpochSink(spark, f"{base}/sink")

    def run(batch, epoch):
        sink.write({"good": good_rows(batch, ("date_id",)), "bad": bad_rows(batch, ("date_id",))}, epoch)

    read_csv(spark, f"{base}/in", schema, stream=True, files_per_batch=1).writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    check(sink.read("good", "date_id long, x double, flag boolean"), sink.read("bad", "line string, reason string, date_id long"))
    named = with_id(good_rows(rows).drop("date_id"), "date_id")
    assert sorted(r.date_id for r in named.collect()) == [0, 1, 2, 3, 4] and with_id(rows, "date_id") is rows
    assert [r.pos for r in with_id(rows.where("x IS NOT NULL"), "pos", "x").orderBy("x").collect()] == list(range(rows.where("x IS NOT NULL").count()))


# --- stages and validated fits ------------------------------------------------------------------------------------------------
def test_a_saved_pipeline_scores_alike(spark):
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import LinearRegression

    from tidemark.operators.stages import prepared

    rng = np.random.default_rng(3)
    rows = [(i, float(a), None if i % 9 == 0 else float(b), NAN if i % 11 == 0 else float(c), float(3 * a - b)) for i, (a, b, c) in enumerate(rng.normal(size=(400, 3)))]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, y double")
    for most in (2, None):
        fitted = prepared(["a", "b", "c"], "y", LinearRegression(labelCol="y"), most=most).fit(df)
        path = folder(spark)
        fitted.write().save(path)
        other = PipelineModel.load(path).transform(df)
        assert {r.i: r.prediction for r in fitted.transform(df).collect()} == {r.i: r.prediction for r in other.collect()}
        assert ("c" in other.columns) == (most is None) and "y" in other.columns
    with pytest.raises(ValueError):
        prepared(["a", "nowhere"], "y", LinearRegression(labelCol="y")).fit(df)


def test_boosting_stops_early_on_a_planted_signal(spark):
    from tidemark.operators import models as ML

    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 3))
    df = spark.createDataFrame([(i, *map(float, v), float(v[0] - 2 * (v[1] > 0) + 0.3 * e)) for i, (v, e) in enumerate(zip(x, rng.normal(size=700)))], "date_id long, a double, b double, c double, y double")
    got = ML.fit_validated("lightgbm", df, ["a", "b", "c"], "y", SeriesSpec("date_id", index="date_id"), maxIter=60)
    rounds = got.rounds.orderBy("round").collect()
    assert 1 < len(rounds) < 60 and sum(r.best for r in rounds) == 1 and rounds[got.best - 1].best and rounds[-1].train_mse < rounds[0].train_mse
    m = got.metrics.first()
    assert m.n == 140 and m.r2 > 0.5
    few = ML.fit_validated("random_forest", df, ["a", "b", "c"], "y", SeriesSpec("date_id", index="date_id"), most_rows=200, numTrees=5)
    assert few.rounds.count() == 1 and few.metrics.first().n == 40
