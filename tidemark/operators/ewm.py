"""Exponentially weighted mean (W12) and MACD (W14) in two passes over blocks.

``ewm(span, adjust=False)`` is the recurrence ``y = (w y' + alpha x) / (w +
alpha)`` over the values that are not null, ``w = (1 - alpha)^(g + 1)`` after a
gap of ``g`` nulls; the first value is its own mean and null rows repeat the
last.  It is affine in ``y'``, so a block of rows is summed up in a few numbers:
where its first and last values stand, the mean at its end if it began alone,
and the factor by which the mean before it still counts there.

Pass 1 makes that row for each ``(key, block)`` and every wanted column and
span at once; one scan over the rows of a key (one a block) gives the mean and
gap that each block begins with; pass 2 runs the recurrence in each block.  Both
passes are grouped Arrow functions on ``block_rows`` rows, so a key that holds
a third of the table is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.series import SeriesSpec, ensure_index, null_safe_join

FAR = 60.0  # e^-60 is less than the last bit of any weight: longer gaps weigh the same


def _mean(x: np.ndarray, alpha: float, before: float | None, gap: int) -> np.ndarray:
    """The running means of one block that begins ``gap`` rows after the last
    value, when the mean was ``before`` (None: no value yet)."""
    if before is None or math.isnan(before):
        return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    rows = min(gap, math.ceil(FAR / -math.log1p(-alpha))) if alpha < 1 else min(gap, 1)
    led = np.concatenate([[before], np.full(rows, np.nan), x])
    return pd.Series(led).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1 + rows:]


def block_summary(x: np.ndarray, alpha: float) -> tuple[int, int, float, float, float]:
    """``first, last, x_first, end, keep`` of one block; ``first`` is -1 without
    any value."""
    there = np.flatnonzero(~np.isnan(x))
    if not len(there):
        return -1, -1, math.nan, math.nan, 1.0
    first, last = int(there[0]), int(there[-1])
    with np.errstate(divide="ignore"):
        # (1 - alpha)^k underflows after long gaps: nothing is kept then
        w = np.power(1.0 - alpha, np.diff(there).astype(np.float64))
        keep = float(np.exp(np.log(w / (w + alpha)).sum())) if len(w) else 1.0
    return first, last, float(x[first]), float(_mean(x, alpha, None, 0)[-1]), keep


def _carries(rows: list[tuple], alpha: float) -> list[tuple[float | None, int]]:
    """Mean and gap that each block of a key begins with, from the summaries
    ``(rows, first, last, x_first, end, keep)`` in order."""
    out, y, gap = [], None, 0
    for n, first, last, x, end, keep in rows:
        out.append((y, gap))
        if first < 0:
            gap += n
            continue
        start = x
        if y is not None:
            w = (1.0 - alpha) ** (gap + first + 1)
            start = (w * y + alpha * x) / (w + alpha)
        y, gap = end + (start - x) * keep, n - 1 - last
    return out


def ewm_all(df: DataFrame, spec: SeriesSpec, wanted: Sequence[tuple[str, float, str]]) -> DataFrame:
    """Append ``ewm(span, adjust=False).mean()`` for each ``(column, span,
    name)`` of ``wanted``, all in the same two passes.  NaN counts as null;
    rows before the first value are NULL; rows of a null key are a series of
    their own, and an empty table stays empty.  ``df`` is read twice: cut its
    lineage first where it is dear."""
    base, ri, added = ensure_index(df, spec)
    keys, names = spec.keys, [w[2] for w in wanted]
    alphas = [2.0 / (s + 1.0) for _, s, _ in wanted]
    cols, base_cols = sorted({c for c, _, _ in wanted}), base.columns
    blocked = base.withColumn("_blk", F.floor(F.col(ri) / spec.block_rows).cast("long"))

    def values(rows: pa.Table, c: str) -> np.ndarray:
        return rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64)

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(ri)
        out = {k: rows.column(k).slice(0, 1) for k in [*keys, "_blk"]} | {"_n": [rows.num_rows]}
        for i, ((c, _, _), alpha) in enumerate(zip(wanted, alphas, strict=True)):
            for part, v in zip(("f", "l", "x", "e", "k"), block_summary(values(rows, c), alpha), strict=True):
                out[f"_{part}{i}"] = [v]
        return pa.table(out)

    key_fields = [df.schema[k] for k in keys]
    parts = [T.StructField(f"_{p}{i}", T.LongType() if p in "fl" else T.DoubleType()) for i in range(len(names)) for p in "flxek"]
    sums = blocked.select(*keys, "_blk", ri, *[F.col(c).cast("double").alias(c) for c in cols]).groupBy(*keys, "_blk").applyInArrow(
        summed, T.StructType([*key_fields, T.StructField("_blk", T.LongType()), T.StructField("_n", T.LongType()), *parts]))

    def scanned(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_blk")
        out = {k: rows.column(k) for k in [*keys, "_blk"]}
        for i, alpha in enumerate(alphas):
            parts = [rows.column(x).to_pylist() for x in ("_n", *(f"_{p}{i}" for p in "flxek"))]
            carry = _carries(list(zip(*parts, strict=True)), alpha)
            out[f"_y{i}"], out[f"_g{i}"] = pa.array([y for y, _ in carry], pa.float64()), pa.array([g for _, g in carry], pa.int64())
        return pa.table(out)

    into = [T.StructField(f"_{p}{i}", T.DoubleType() if p == "y" else T.LongType()) for i in range(len(names)) for p in "yg"]
    carries = sums.groupBy(*keys).applyInArrow(scanned, T.StructType([*key_fields, T.StructField("_blk", T.LongType()), *into]))
    joined = null_safe_join(blocked, carries, [*keys, "_blk"])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(ri)
        out = rows.select(base_cols)
        for i, ((c, _, name), alpha) in enumerate(zip(wanted, alphas, strict=True)):
            y = _mean(values(rows, c), alpha, rows.column(f"_y{i}")[0].as_py(), rows.column(f"_g{i}")[0].as_py() or 0)
            out = out.append_column(name, pa.array(y, pa.float64(), mask=np.isnan(y)))
        return out

    done = joined.groupBy(*keys, "_blk").applyInArrow(run, T.StructType([*base.schema.fields, *[T.StructField(x, T.DoubleType()) for x in names]]))
    return done.drop(ri) if added else done


def _cut(df: DataFrame) -> DataFrame:
    from tidemark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ewm(df: DataFrame, spec: SeriesSpec, col: str, spans: Sequence[float], names: Sequence[str] | None = None,
        materialize: bool = True) -> DataFrame:
    """``ewm_all`` of one column for each span (W12).  ``materialize`` cuts the
    lineage of the input with a reliable ``checkpoint()`` into the session's
    ``spark.checkpoint.dir``, so the two passes do not compute it twice."""
    names = list(names or [f"{col}_ewm_{int(s) if float(s).is_integer() else s}" for s in spans])
    return ewm_all(_cut(df) if materialize else df, spec, list(zip([col] * len(names), spans, names)))


def macds(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], prefixes: Sequence[str], fast: int = 12, slow: int = 26,
          signal: int = 9) -> DataFrame:
    """MACD = EWM(fast) - EWM(slow), signal = EWM(signal) of MACD, histogram =
    MACD - signal (W14), of several columns in the same passes."""
    base, ri, added = ensure_index(df, spec)
    s = spec.with_index(ri)
    d = ewm_all(_cut(base), s, [x for i, c in enumerate(cols) for x in ((c, fast, f"__fast{i}"), (c, slow, f"__slow{i}"))])
    d = d.select(*base.columns, *[(F.col(f"__fast{i}") - F.col(f"__slow{i}")).alias(f"{p}macd") for i, p in enumerate(prefixes)])
    d = ewm_all(_cut(d), s, [(f"{p}macd", signal, f"{p}macd_signal") for p in prefixes])
    d = d.select("*", *[(F.col(f"{p}macd") - F.col(f"{p}macd_signal")).alias(f"{p}macd_hist") for p in prefixes])
    return d.drop(ri) if added else d


def macd(df: DataFrame, spec: SeriesSpec, col: str, fast: int = 12, slow: int = 26, signal: int = 9,
         prefix: str | None = None) -> DataFrame:
    """``macds`` of one column; names begin with ``prefix``."""
    return macds(df, spec, [col], [prefix if prefix is not None else f"{col}_"], fast, slow, signal)
