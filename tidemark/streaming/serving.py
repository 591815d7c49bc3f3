"""Serving on a stream: scoring, dispatch, validation and a committed sink.

``lag_stream`` turns a stream of one value per row into the last values of its
series (bounded state per key); any fitted ``PipelineModel`` scores it
(``score_stream``).  ``dispatch`` applies one of several allocation rules per
row and turns failures into a neutral allocation with a reason.  ``score`` runs
a user's function over Arrow batches and makes a declared column of what it
returns.  ``serve`` drives a stream through a step, validates every batch by id
and commits what is valid, once per epoch, to an ``EpochSink``.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping, Sequence
from numbers import Number

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.operators.strategy import ALLOC_MAX, ALLOC_MIN

NEUTRAL = 1.0

# --- fixed values: outcome codes of a run --------------------------------------------
OUTCOMES = ("UNSPECIFIED", "SERVER_NEVER_STARTED", "SERVER_CONNECTION_FAILED", "SERVER_RAISED_EXCEPTION",
            "SERVER_MISSING_ENDPOINT", "GATEWAY_RAISED_EXCEPTION", "INVALID_SUBMISSION", "GRPC_DEADLINE_EXCEEDED")
MOST_DETAILS = 8000
# ---------------------------------------------------------------------------------------


# --- features from state (T5) -----------------------------------------------------------------
def _lag_fn(n: int):
    def fn(bucket, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """Rows of one bucket of keys in a micro-batch, in order within each key,
        behind the kept values."""
        held = {(a, k): (at, x) for a, k, at, x in zip(*state.get[:3], np.reshape(state.get[3], (-1, n)), strict=True)} if state.exists else {}
        parts = [[p[c].to_numpy() for c in ("known", "key", "pos", "value")] for p in pdfs]
        known, key, pos, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, key, known))
        known, key, pos, value = known[order].astype(bool), key[order].astype(np.int64), pos[order].astype(np.int64), value[order].astype(np.float64)
        new = np.append(True, (key[1:] != key[:-1]) | (known[1:] != known[:-1]))
        of, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        names = list(zip(known[begin].tolist(), key[begin].tolist(), strict=True))
        there = np.array([k in held for k in names])
        last = np.array([held[k][0] if k in held else 0 for k in names], np.int64)
        kept = np.array([held[k][1] if k in held else np.full(n, np.nan) for k in names], np.float64)
        late = (there[of] & (pos <= last[of])) | (np.append(False, pos[1:] == pos[:-1]) & ~new)
        good = np.flatnonzero(~late)
        count = np.bincount(of[good], minlength=len(names))
        end = np.cumsum(count)
        rank, at = np.arange(len(good)) - (end - count)[of[good]], np.arange(len(good))
        seen = value[good]
        out = {"known": known, "key": key, "pos": pos, "value": value}
        for k in range(1, n + 1):
            lag = np.full(len(pos), np.nan)
            lag[good] = np.where(rank >= k, seen[np.maximum(at - k, 0)], kept[of[good], np.minimum(n - k + rank, n - 1)])
            out[f"lag_{k}"] = lag
        out["late"] = late
        for g in np.flatnonzero(count):
            held[names[g]] = (int(pos[good[end[g] - 1]]), np.concatenate([kept[g], seen[end[g] - min(count[g], n): end[g]]])[-n:])
        state.update(([a for a, _ in held], [k for _, k in held], [x for x, _ in held.values()], [float(v) for _, x in held.values() for v in x]))
        yield pd.DataFrame(out)  # NaN becomes null on the way out

    return fn


def lag_stream(sdf: DataFrame, key: str, order: str, value: str, n: int, buckets: int = 1 << 12) -> DataFrame:
    """``key, pos, value, lag_1 .. lag_n, late``: the ``n`` values before each
    row of its series, from state; null where there are fewer.  A row that is
    not after the last one of its key, or repeats an order value, is late: it
    gets no lags and changes no state.  Null values take their place as null,
    rows of a null key are a series.

    Keys are dealt by hash to ``buckets`` states, since a call of Python costs
    far more than a key; a checkpoint holds for its number of buckets."""
    src = sdf.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("pos"), F.col(value).cast("double").alias("value"))
    src = src.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), F.col("key").isNotNull().alias("known"), F.coalesce("key", F.lit(0)).alias("key"), "pos", "value")
    lags = [f"lag_{k}" for k in range(1, n + 1)]
    made = src.groupBy("bucket").applyInPandasWithState(
        _lag_fn(n), f"known boolean, key long, pos long, value double, {', '.join(f'{c} double' for c in lags)}, late boolean",
        "known array<boolean>, key array<long>, last array<long>, kept array<double>", "append", GroupStateTimeout.NoTimeout)
    return made.select(F.when(F.col("known"), F.col("key")).alias("key"), "pos", "value", *lags, "late")


def score_stream(sdf: DataFrame, model: str | PipelineModel, key: str, order: str, value: str, n: int) -> DataFrame:
    """T5: predictions of a fitted pipeline (or the path of a saved one) from
    the ``n`` last values of each series: ``key, pos, value, prediction, late``.
    Rows with fewer values, and late rows, have no prediction."""
    model = PipelineModel.load(model) if isinstance(model, str) else model
    lags = [f"lag_{k}" for k in range(1, n + 1)]
    known = F.lit(True)
    for c in lags:
        known = known & F.col(c).isNotNull()
    rows = lag_stream(sdf, key, order, value, n).withColumn("_known", known).fillna(0.0, lags)
    return model.transform(rows).select("key", "pos", "value", F.when(F.col("_known"), F.col("prediction")).alias("prediction"), "late")


# --- user functions (UD1, UD2) -----------------------------------------------------------------
def _as_column(made, rows: int, name: str) -> pd.Series:
    """A scalar, list, array, series or one-column frame as ``rows`` doubles."""
    if isinstance(made, pd.DataFrame):
        if name in made.columns:
            made = made[name]
        elif made.shape[1] == 1:
            made = made.iloc[:, 0]
        else:
            raise TypeError(f"a frame without column {name!r} must have one column, not {made.shape[1]}")
    if made is None or isinstance(made, Number):
        made = [made] * rows
    if not isinstance(made, (list, tuple, np.ndarray, pd.Series)):
        raise TypeError(f"cannot make a column of {type(made).__name__}; expected a scalar, list, array, series or frame")
    if len(made) != rows:
        raise ValueError(f"{len(made)} values for {rows} rows")
    kinds = {type(v).__name__ for v in made if v is not None and (not isinstance(v, (Number, np.generic)) or isinstance(v, (complex, str, bytes)))}
    if kinds:
        raise TypeError(f"not numbers: {sorted(kinds)}")
    return pd.Series([None if v is None else float(v) for v in made], dtype="float64")


def named_function(fn: Callable) -> Callable:
    """``fn`` if it is a function with a name; lambdas, partials and other
    callables are refused, since reports name the function."""
    if not inspect.isfunction(fn) or fn.__name__ == "<lambda>":
        raise TypeError(f"expected a named function, got {fn!r}")
    return fn


def score(df: DataFrame, fn: Callable, inputs: Sequence[str], name: str = "prediction") -> DataFrame:
    """UD1/UD2: append the double column ``name`` that ``fn(frame of inputs)``
    gives for each Arrow batch.  ``fn`` may return a scalar (for all rows of the
    batch), a list, an array, a series (by position) or a frame; another length
    or type raises.  Works on streams.  A batch has at most
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows, so ``fn`` must not
    depend on which rows come together."""
    named_function(fn)
    cols = list(inputs)
    fields = [f for f in df.schema.fields if f.name != name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                made = _as_column(fn(pdf[cols]), len(pdf), name)
                pdf = pdf.drop(columns=[name], errors="ignore")
                pdf[name] = made.to_numpy()
                yield pdf

    return df.mapInPandas(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))


# --- dispatch with a neutral fallback (T4) ------------------------------------------------------
def dispatch(df: DataFrame, strategy: str, rules: Mapping[str, Column | Callable], inputs: Sequence[str] = (), out: str = "allocation") -> DataFrame:
    """T4: append ``out`` and ``out_reason``.  The rule named by column
    ``strategy`` gives the allocation, clipped to [0, 2].

    A rule is a Column (stays in the JVM; null or NaN is a failure) or a named
    function of a frame of ``inputs`` with the rows of its strategy.  Where a
    function raises, its rows are tried one by one, so only the rows that fail
    are lost.  A failed row, an unknown or a null strategy gets the neutral
    allocation 1.0 and the reason, which is null elsewhere."""
    reason = f"{out}_reason"
    native = {k: r for k, r in rules.items() if isinstance(r, Column)}
    calls = {k: named_function(r) for k, r in rules.items() if k not in native}
    raw, why = F.lit(None).cast("double"), F.lit(None).cast("string")
    if calls:
        cols = list(dict.fromkeys([strategy, *inputs]))

        @F.pandas_udf("value double, error string")
        def called(frame: pd.DataFrame) -> pd.DataFrame:
            value, error = np.full(len(frame), np.nan), np.full(len(frame), None, object)
            names = frame[strategy].to_numpy(object)
            for name, fn in calls.items():
                at = np.flatnonzero(names == name)
                parts = [at] if len(at) else []
                while parts:
                    part = parts.pop()
                    try:
                        value[part] = _as_column(fn(frame.iloc[part][list(inputs)]), len(part), out).to_numpy()
                    except Exception as e:  # the rule's failure is the row's result
                        if len(part) > 1:
                            parts += [part[i: i + 1] for i in range(len(part))]
                        else:
                            error[part] = f"{type(e).__name__}: {e}"[:200]
            return pd.DataFrame({"value": value, "error": error})

        df = df.withColumn("_called", called(F.struct(*cols)))
        raw, why = F.col("_called.value"), F.col("_called.error")
    for name, rule in native.items():
        raw = F.when(F.col(strategy) == name, rule.cast("double")).otherwise(raw)
    known = F.coalesce(F.col(strategy).isin(list(rules)), F.lit(False))
    missing = raw.isNull() | F.isnan(raw)
    cause = (F.when(F.col(strategy).isNull(), F.lit("no strategy"))
             .when(~known, F.concat(F.lit("unknown strategy: "), F.col(strategy).cast("string")))
             .when(why.isNotNull(), why).when(missing, F.lit("no result")))
    return df.select(*[c for c in df.columns if c not in ("_called", out, reason)],
                     F.when(missing, F.lit(NEUTRAL)).otherwise(F.least(F.greatest(raw, F.lit(ALLOC_MIN)), F.lit(ALLOC_MAX))).alias(out), cause.alias(reason))


# --- validation (T3) -------------------------------------------------------------------------------
def check_types(df: DataFrame, prediction: str = "prediction") -> None:
    """Raises TypeError unless the prediction column is there and numeric."""
    found = {f.name: f.dataType for f in df.schema.fields}
    if prediction not in found:
        raise TypeError(f"no column {prediction!r} in {sorted(found)}")
    if not isinstance(found[prediction], T.NumericType):
        raise TypeError(f"{prediction!r} is {found[prediction].simpleString()}, not a number")


def batch_faults(pred: DataFrame, ids: DataFrame, key: str, batch: str, prediction: str = "prediction") -> DataFrame:
    """``batch, n_pred, n_ids, fault``, one row per batch of either side:
    ``fault`` is null for a valid batch, else the first of ``no ids``, ``missing
    prediction`` (an id without one), ``unknown id``, ``repeated id`` and ``not a
    number`` (null, NaN or infinite).  Every id must have exactly one finite
    prediction; null ids and null batches match null ones."""
    check_types(pred, prediction)
    x = F.col(prediction).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    p = pred.select(F.col(batch).alias("b"), F.col(key).alias("k"), F.lit(1).alias("p"), F.lit(0).alias("i"), finite.cast("int").alias("ok"))
    i = ids.select(F.col(batch).alias("b"), F.col(key).alias("k"), F.lit(0).alias("p"), F.lit(1).alias("i"), F.lit(0).alias("ok"))
    each = p.unionByName(i).groupBy("b", "k").agg(F.sum("p").alias("p"), F.sum("i").alias("i"), F.sum("ok").alias("ok"))
    whole = each.groupBy("b").agg(F.sum("p").alias("n_pred"), F.sum("i").alias("n_ids"), F.max(F.col("p") < F.col("i")).alias("missing"),
                                  F.max((F.col("i") == 0)).alias("unknown"), F.max(F.col("p") > F.col("i")).alias("repeated"), F.max(F.col("ok") < F.col("p")).alias("odd"))
    fault = (F.when(F.col("n_ids") == 0, F.lit("no ids")).when(F.col("missing"), F.lit("missing prediction")).when(F.col("unknown"), F.lit("unknown id"))
             .when(F.col("repeated"), F.lit("repeated id")).when(F.col("odd"), F.lit("not a number")))
    return whole.select(F.col("b").alias(batch), "n_pred", "n_ids", fault.alias("fault"))


# --- committed sink (T2, T6) ------------------------------------------------------------------------
class EpochSink:
    """A Parquet sink with one folder and one manifest row an epoch.

    Data goes to ``data/epoch=<name>-<n>`` and counts only when
    ``manifest/epoch=<name>-<n>`` is written after it.  A replayed epoch that the
    manifest has is skipped; one that failed half-way is written over.  ``name``
    tells streams that share the sink (and their epoch numbers) apart."""

    def __init__(self, spark: SparkSession, path: str, name: str = "stream"):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self, epoch: int) -> bool:
        return self._there(f"{self.path}/manifest/epoch={self.name}-{epoch}/_SUCCESS")

    def write(self, parts: Mapping[str, DataFrame], epoch: int) -> bool:
        """Commits ``parts`` (folder name -> rows) as one epoch; False if it was."""
        if self.committed(epoch):
            return False
        mark, counts = f"epoch={self.name}-{epoch}", []
        for part, rows in parts.items():
            to = f"{self.path}/{part}/{mark}"
            rows.write.mode("overwrite").parquet(to)
            counts.append((part, self.spark.read.schema(rows.schema).parquet(to).count()))
        self.spark.createDataFrame(counts, "part string, n_rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{mark}")
        return True

    def manifest(self) -> DataFrame:
        """``part, n_rows, epoch`` of all committed epochs (none: no row)."""
        if not self._there(f"{self.path}/manifest"):
            return self.spark.createDataFrame([], "part string, n_rows long, epoch string")
        return self.spark.read.schema("part string, n_rows long, epoch string").parquet(f"{self.path}/manifest")

    def read(self, part: str, schema: str) -> DataFrame:
        """The committed rows of a part; folders of unfinished epochs are left out."""
        if not self._there(f"{self.path}/{part}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, epoch string").parquet(f"{self.path}/{part}")
        return rows.join(self.manifest().select("epoch").distinct(), "epoch", "left_semi").drop("epoch")


def serve(sdf: DataFrame, step: Callable[[DataFrame], DataFrame], ids: Callable[[DataFrame], DataFrame], sink: EpochSink,
          checkpoint: str, key: str, batch: str, late: str | None = None) -> None:
    """Runs the stream to its end.  Each micro-batch goes once through
    ``step`` (``key, batch, prediction`` and more) and is kept for the writes;
    ``ids(micro-batch)`` names the rows that must have a prediction.  Batches
    without a fault go to part ``good`` of the sink, all rows of the others to
    ``bad`` with their fault, rows flagged by column ``late`` to ``late``."""

    def run(rows: DataFrame, epoch: int) -> None:
        if sink.committed(epoch):
            return
        rows = rows.persist()
        try:
            rows.count()  # the step and the ids would make the same parts at once, one task of two waiting
            pred = step(rows if late is None else rows.where(~F.col(late))).persist()
            want = ids(rows if late is None else rows.where(~F.col(late)))
            faults = batch_faults(pred, want, key, batch).select(F.col(batch).alias("_b"), "fault").persist()
            judged = pred.join(faults, pred[batch].eqNullSafe(faults["_b"])).drop("_b")
            parts = {"good": judged.where("fault IS NULL").drop("fault"), "bad": judged.where("fault IS NOT NULL"),
                     "faults": faults.where("fault IS NOT NULL").withColumnRenamed("_b", batch)}
            if late is not None:
                parts["late"] = rows.where(F.col(late)).drop(late)
            sink.write(parts, epoch)
            for x in (pred, faults):
                x.unpersist()
        finally:
            rows.unpersist()

    query = sdf.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# --- outcome of a run (T7) ----------------------------------------------------------------------------
def outcome(message: Column, kind: Column) -> Column:
    """``(code, name, details)`` of a run from its error message and the
    kind of exception (both null: it succeeded, and so is the result).  The
    first rule that fits decides; anything else raised is the loop's own."""
    def is_(code: int, details: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(OUTCOMES[code]).alias("name"), F.substring(details, 1, MOST_DETAILS).alias("details"))

    none = F.lit(None).cast("string")
    listener = F.regexp_extract(message, r"No listener for (.+?) was registered", 1)
    inner = F.regexp_extract(message, r'(?i)"Exception calling application: (.*)"', 1)
    text, kind = F.coalesce(message, F.lit("")), F.coalesce(kind, F.lit(""))
    return (F.when(message.isNull() & (kind == ""), F.lit(None))
            .when(kind.isin("gaierror", "RuntimeError") & text.contains("Failed to connect to server after waiting"), is_(1, none))
            .when(listener != "", is_(4, F.concat(F.lit("Server did not register a listener for "), listener)))
            .when(text.contains("Exception calling application"), is_(3, F.when(inner != "", inner).otherwise(message)))
            .when(kind == "InactiveRpcError", is_(2, message))
            .when(kind.isin("DeadlineError", "TimeoutError"), is_(7, message))
            .when(kind.isin("ValidationError", "TypeError", "ValueError"), is_(6, message))
            .when((kind == "") & (text == ""), is_(0, none))
            .otherwise(is_(5, message)))


def reported(df: DataFrame, message: str, kind: str) -> DataFrame:
    """Run messages as report rows: ``Succeeded, ErrorType, ErrorName,
    ErrorDetails`` appended."""
    d = df.withColumn("_o", outcome(F.col(message), F.col(kind)))
    return d.select(*df.columns, F.col("_o").isNull().alias("Succeeded"), F.col("_o.code").alias("ErrorType"), F.col("_o.name").alias("ErrorName"), F.col("_o.details").alias("ErrorDetails"))
