"""Ranks against everything seen so far: leak-free quantile flags.

``expanding_rank`` counts, for each row, the values of its series up to and
including it that are smaller than, or at most as large as, its own.  Whether
a value lies above or below an interpolated quantile of that prefix follows
from the two counts alone (``above_quantile``, ``below_quantile``).

Counting earlier *and* smaller rows (dominance) has no finite window frame.
Rows are dealt twice, always in bounded groups:

* by time: within ``(key, block of block_rows positions)`` the rows before each
  row are counted by numpy, one pass per bit of the rank;
* by value: cut points make value classes, each either one value that is a cut
  point (however often it occurs) or the open range between two of them: of a
  series about ``block_rows`` rows, never much more than ``MOST_OPEN`` or a
  block.  Rows of earlier time blocks in lower classes come from
  two-way prefix sums of the table of counts per (time block, class); those in
  the same open class are counted there, block against block.

A series of one block needs only the first.  The count table has
``(n / block_rows)^2`` cells a column and series of n rows, spread over keys
and blocks.  Groups are dealt to numpy many at a time (``BATCH`` rows).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.series import SeriesSpec, ensure_index, null_safe_join
from tidemark.session import ensure_checkpoint_dir

MOST_OPEN = 1 << 18  # rows of one series between two cut points, where blocks are smaller
BATCH = 1 << 14  # rows of whole groups that numpy takes at once


def dominated(when: np.ndarray, value: np.ndarray, strict: bool, of: np.ndarray | None = None) -> np.ndarray:
    """For each i the number of j with ``when[j] < when[i]`` and ``value[j] <
    value[i]`` (``<=`` if not strict).  ``when`` is ascending; equal entries of
    it are not before each other.  With ``of`` (0, 1, ... in runs) only j of the
    same group count, and ``when`` is ascending in each."""
    n = len(value)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    of = np.zeros(n, np.int64) if of is None else of
    sizes = np.bincount(of)
    bits = int(sizes.max() - 1).bit_length()
    # equal values: the later one ranks lower (strict) or higher
    order = np.lexsort((-when if strict else when, value, of))
    rank = np.empty(n, np.int64)  # groups begin at multiples of a power of two, so that they differ above its bits
    rank[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes) + (np.repeat(np.arange(len(sizes)), sizes) << bits)
    first_of_time = np.maximum.accumulate(np.where(np.append(True, (when[1:] != when[:-1]) | (of[1:] != of[:-1])), np.arange(n), 0))
    for bit in range(bits):
        # ranks that agree above this bit differ first in it: those with 0 are lower
        group = rank >> (bit + 1)
        by = np.argsort(group, kind="stable")
        zero = (((rank[by] >> bit) & 1) == 0).astype(np.int64)
        before = np.cumsum(zero) - zero
        g, t = group[by], first_of_time[by]
        new_group = np.append(True, g[1:] != g[:-1])
        new_time = new_group | np.append(True, t[1:] != t[:-1])
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new_group, at, 0))
        same = np.maximum.accumulate(np.where(new_time, at, 0))
        out[by] += np.where(zero == 0, before[same] - before[start], 0)
    return out


def _floats(col: pa.ChunkedArray) -> np.ndarray:
    """Values as doubles, nulls as NaN."""
    return col.to_numpy(zero_copy_only=False).astype(np.float64)


def _sorted_groups(rows: pa.Table, group: list[str], by: str) -> tuple[pa.Table, np.ndarray]:
    """``rows`` by groups of equal ``group`` columns (a null equals a null) and
    ``by`` within them, and each row's group number."""
    of = np.zeros(rows.num_rows, np.int64)
    for c in group:
        codes = rows.column(c)
        if pa.types.is_floating(codes.type):
            codes = pc.add(codes, 0.0)  # one zero
        codes = codes.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.unique(of * (codes.max(initial=0) + 2) + codes + 1, return_inverse=True)[1]
    order = np.lexsort((rows.column(by).to_numpy(), of))
    return rows.take(pa.array(order)), of[order]


def _dealt(df: DataFrame, group: list[str], n: int) -> GroupedData:
    """``df`` grouped so that rows of equal ``group`` columns come together,
    about ``BATCH`` rows at a time of its ``n``."""
    return df.groupBy(F.pmod(F.xxhash64(*group), F.lit(max(1, math.ceil(n / BATCH)))).alias("_deal"))


def expanding_rank(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], suffixes: Sequence[str] = ("_less", "_most", "_seen")) -> DataFrame:
    """Append per column how many values of the series up to the row are
    smaller (``_less``), smaller or equal, itself included (``_most``), and not
    null (``_seen``).  Null and NaN values count nowhere; their own ``_less`` and
    ``_most`` are null.  Rows of a null key form a series; an empty table stays
    empty.  ``spec`` gives order and blocks; results do not depend on them."""
    cols = list(cols)
    less, most, seen = ([c + s for c in cols] for s in suffixes)
    base, ri, added = ensure_index(df, spec)
    keys, size = spec.keys, spec.block_rows
    ensure_checkpoint_dir(df.sparkSession)
    narrow = base.select(*keys, F.col(ri).cast("long").alias("_pos"), F.floor(F.col(ri) / size).cast("long").alias("_blk"), *[F.col(c).cast("double").alias(c) for c in cols])
    narrow = narrow.select(*keys, "_pos", "_blk", *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in cols]).checkpoint()
    n, last = narrow.agg(F.count(F.lit(1)), F.max("_blk")).first()
    # cuts are common to all series: as many as the longest has blocks, and enough that no open range holds more than MOST_OPEN
    points = max(1, (last or 0) + 1, math.ceil(n / max(size, MOST_OPEN)))
    grid = [(i + 1) / (points + 1) for i in range(points)]
    cuts = {c: np.empty(0) for c in cols}
    if last:
        found = narrow.agg(*[F.percentile_approx(c, grid, 50 * points).alias(c) for c in cols]).first()
        cuts = {c: np.unique(np.array(found[c] or [], float)) for c in cols}

    def in_block(rows: pa.Table) -> pa.Table:
        rows, of = _sorted_groups(rows, [*keys, "_blk"], "_pos")
        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))[of]
        out = {k: rows.column(k) for k in [*keys, "_pos", "_blk"]}
        for c, a, b, s in zip(cols, less, most, seen, strict=True):
            x = _floats(rows.column(c))
            there = np.flatnonzero(~np.isnan(x))
            v, at, mine = x[there], np.arange(len(there)), of[there]
            made = []
            for strict in (True, False):
                count = np.zeros(len(x), np.int64)
                count[there] = dominated(at, v, strict, mine) + (not strict)
                made.append(pa.array(count, pa.int64(), mask=np.isnan(x)))
            out[a], out[b] = made
            upto = np.append(0, np.cumsum(~np.isnan(x)))
            out[s] = pa.array(upto[1:] - upto[begin])
            left, right = np.searchsorted(cuts[c], x, "left"), np.searchsorted(cuts[c], x, "right")
            out["_cls_" + c] = pa.array(left + right, pa.int64(), mask=np.isnan(x))  # odd: a cut point itself
            out["_val_" + c] = pa.array(x, pa.float64(), mask=np.isnan(x))
        return pa.table(out)

    fields = [*[narrow.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in ("_pos", "_blk")]]
    for c, a, b, s in zip(cols, less, most, seen, strict=True):
        fields += [T.StructField(x, T.LongType()) for x in (a, b, s, "_cls_" + c)] + [T.StructField("_val_" + c, T.DoubleType())]
    ranked = _dealt(narrow, [*keys, "_blk"], n).applyInArrow(in_block, T.StructType(fields))
    if last:
        ranked = ranked.checkpoint()
        for c, a, b, s in zip(cols, less, most, seen, strict=True):
            ranked = _with_earlier_blocks(ranked, n, keys, c, a, b, s)
    ranked = ranked.select(*keys, F.col("_pos").alias(ri), *less, *most, *seen)
    out = null_safe_join(base, ranked, [*keys, ri]) if keys else base.join(ranked, ri, "left")
    out = out.select(*base.columns, *[x for t in zip(less, most, seen, strict=True) for x in t])
    return out.drop(ri) if added else out


def _with_earlier_blocks(ranked: DataFrame, n: int, keys: list[str], c: str, less: str, most: str, seen: str) -> DataFrame:
    """Adds to the counts within blocks those of earlier time blocks."""
    cls, val = "_cls_" + c, "_val_" + c
    cells = ranked.where(F.col(cls).isNotNull()).groupBy(*keys, "_blk", cls).agg(F.count(F.lit(1)).alias("_m")).checkpoint()
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    blocks, classes = cells.select(*keys, "_blk").distinct(), cells.select(*keys, cls).distinct()
    x, y = blocks.alias("x"), classes.alias("y")
    met = x.join(y, same) if same else x.crossJoin(y)  # blocks x classes of one series: the table of counts
    dense = met.select(*[F.col(f"x.{k}").alias(k) for k in keys], "_blk", cls)
    full = null_safe_join(dense, cells, [*keys, "_blk", cls])
    earlier = Window.partitionBy(*keys, cls).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*keys, "_blk").orderBy(cls).rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("_eq", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
    full = full.withColumn("_lo", F.coalesce(F.sum("_eq").over(lower), F.lit(0))).where("_m IS NOT NULL").select(*keys, "_blk", cls, "_eq", "_lo")
    totals = ranked.groupBy(*keys, "_blk").agg(F.max(seen).alias("_in"))
    up = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_blk", F.coalesce(F.sum("_in").over(up), F.lit(0)).alias("_prior"))

    def in_class(rows: pa.Table) -> pa.Table:
        rows, of = _sorted_groups(rows, [*keys, cls], "_blk")
        when, v = rows.column("_blk").to_numpy(), _floats(rows.column(val))
        return pa.table({**{k: rows.column(k) for k in [*keys, "_pos"]}, "_a": dominated(when, v, True, of), "_b": dominated(when, v, False, of)})

    open_ = ranked.where(F.col(cls) % 2 == 0).select(*keys, "_pos", "_blk", cls, val)
    fields = [*[ranked.schema[k] for k in keys], *[T.StructField(x, T.LongType()) for x in ("_pos", "_a", "_b")]]
    inner = _dealt(open_, [*keys, cls], n).applyInArrow(in_class, T.StructType(fields))
    d = null_safe_join(ranked, full, [*keys, "_blk", cls])
    d = null_safe_join(null_safe_join(d, totals, [*keys, "_blk"]), inner, [*keys, "_pos"])
    point = F.col(cls) % 2 == 1
    new = {less: F.col(less) + F.col("_lo") + F.when(point, F.lit(0)).otherwise(F.col("_a")),
           most: F.col(most) + F.col("_lo") + F.when(point, F.col("_eq")).otherwise(F.col("_b")),
           seen: F.col(seen) + F.col("_prior")}
    return d.select(*[new[x].alias(x) if x in new else F.col(x) for x in ranked.columns]).checkpoint()


def above_quantile(less: Column, seen: Column, q: float) -> Column:
    """Whether a value lies above the interpolated quantile ``q`` of the
    prefix that it ends: enough values are smaller."""
    return less > F.floor((seen - 1) * F.lit(q))


def below_quantile(most: Column, seen: Column, q: float) -> Column:
    """Whether a value lies below that quantile: too few are as small."""
    at = (seen - 1) * F.lit(q)
    return (most <= F.floor(at)) | ((most == F.floor(at) + 1) & (at > F.floor(at)))
