"""Structured Streaming: stateful per-series momentum allocation.

The serving loop of the reference keeps a bounded history of the last
returns and answers one allocation per date.  Here each series key keeps the
last ``n`` values (plus the last order value) in Spark's state store through
``applyInPandasWithState``; every micro-batch emits one allocation per row,
computed from the values seen *before* that row, so replaying the same files
gives the batch result of ``strategy.momentum_allocation``.  Rows whose
order value is not after the last one in state are late and go to the
quarantine output instead of changing the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.streaming.serving import EpochSink

OUT_SCHEMA = "key long, pos long, allocation double, late boolean"
STATE_SCHEMA = "history array<double>, last_pos long"


def _momentum_fn(n: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """The rows of one key in a micro-batch, in order, behind the kept values."""
        hist, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        pdf = pd.concat(list(pdfs)).sort_values("pos", kind="stable")
        pos = pdf["pos"].to_numpy(np.int64)
        late = np.append(False, pos[1:] == pos[:-1])
        if last is not None:
            late |= pos <= last
        value = pdf["value"].to_numpy(np.float64)[~late]
        known = ~np.isnan(value)
        seen = np.concatenate([np.array(hist, np.float64), value[known]])
        before = len(hist) + np.cumsum(known) - known  # values seen before each row
        up = np.lib.stride_tricks.sliding_window_view(seen, n).sum(axis=1) > 0 if len(seen) >= n else np.empty(0, bool)
        ready = before >= n
        made = np.ones(len(value))
        made[ready] = np.where(up[before[ready] - n], 1.5, 0.5)
        alloc = np.full(len(pos), None, object)
        alloc[~late] = made
        if len(value):
            state.update((seen[-n:].tolist(), int(pos[~late][-1])))
        yield pd.DataFrame({"key": np.full(len(pos), key[0], object), "pos": pos, "allocation": alloc, "late": late})

    return fn


def momentum_stream(sdf: DataFrame, key: str, order: str, value: str, n: int = 5) -> DataFrame:
    """Streaming DataFrame of ``(key, pos, allocation, late)``.  State is
    the last ``n`` values of each key (bounded), never the whole series."""
    src = sdf.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("pos"),
                     F.col(value).cast("double").alias("value"))
    return src.groupBy("key").applyInPandasWithState(
        _momentum_fn(n), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def run_stream(sdf: DataFrame, sink: EpochSink, checkpoint: str) -> None:
    """Runs the stream to its end.  Good rows and late rows of a
    micro-batch are committed together, once per epoch: a replayed epoch adds
    nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        if sink.committed(epoch):
            return
        batch = batch.persist()
        try:
            sink.write({"good": batch.where(~F.col("late")).drop("late"), "late": batch.where("late").drop("late")}, epoch)
        finally:
            batch.unpersist()

    sdf.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def validate_batch(pred: DataFrame, ids: DataFrame, key: str, batch: str) -> DataFrame:
    """Ids must be non-empty and every row id must have exactly one
    prediction that is not null, and none may be left over.  Returns one row per
    batch with the counts, from a full outer join on the ids (null ids match
    null ids)."""
    p = pred.groupBy(F.col(batch).alias("pb"), F.col(key).alias("pk")).agg(
        F.count(F.lit(1)).alias("np"), F.count("prediction").alias("nv"))
    i = ids.groupBy(F.col(batch).alias("ib"), F.col(key).alias("ik")).agg(F.count(F.lit(1)).alias("ni"))
    j = p.join(i, F.col("pb").eqNullSafe(F.col("ib")) & F.col("pk").eqNullSafe(F.col("ik")), "full_outer")
    n_pred, n_ids = F.coalesce("np", F.lit(0)), F.coalesce("ni", F.lit(0))
    fits = (n_pred == n_ids) & (F.coalesce("nv", F.lit(0)) == n_ids)
    return j.groupBy(F.when(F.col("ni").isNull(), F.col("pb")).otherwise(F.col("ib")).alias(batch)).agg(
        F.sum(n_pred).alias("n_pred"), F.sum(n_ids).alias("n_ids"), (F.min(fits) & (F.sum(n_ids) > 0)).alias("valid"))
