"""Ordered series on Spark: row positions, block + halo windows, prefix scans.

A series is either a panel ``(key..., order, values...)`` or one long series
with no key.  A plain ``Window.partitionBy(key)`` puts a whole series into one
task, and an unpartitioned window puts *all* rows into one task.  Both break
when one series holds a large share of the table, so every operator here works
on *blocks*:

* ``with_row_index`` gives each row its 0-based position inside its series.
  Series longer than a block are cut into ranges of their own order values;
  ranges that turn out too full (an outlier, a dense stretch, ties) are cut
  again by their own values, until none holds much more than a block.  Counts
  per range and an exclusive prefix over ranges (one row each) give the rest.
* ``windowed`` evaluates finite-frame window expressions per
  ``(key, floor(pos / B))`` block; the last ``before`` rows of a block are also
  sent to the next block (and the first ``after`` rows to the previous one) so
  every frame is complete.  Halo copies are dropped after the window.
* ``prefix_sum`` / ``ffill`` compute unbounded running values from in-block
  running values plus a carry computed on the block table.

Plans therefore partition on ``(key, block)``: a hot key is split into many
tasks, and no ``Exchange SinglePartition`` touches raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

RI = "_ri"


def _tuple(x) -> tuple[str, ...]:
    if x is None:
        return ()
    if isinstance(x, str):
        return (x,)
    return tuple(x)


@dataclass(frozen=True)
class SeriesSpec:
    """How rows form ordered series.

    order:      order column (numeric, DATE or TIMESTAMP); unique within a key
                unless ``tiebreak`` makes the order total.
    key:        series key column(s); empty for one long series.
    tiebreak:   extra order columns making the order deterministic.
    index:      name of a column that already holds the 0-based position in
                the series (skips ``with_row_index``).
    block_rows: rows per window block (B); must exceed every halo.
    width:      block width in order units used to number rows, where the order
                is known to be even (positions); None measures the order.
    """

    order: str
    key: tuple[str, ...] = ()
    tiebreak: tuple[str, ...] = ()
    index: str | None = None
    block_rows: int = 1 << 18
    width: float | None = None
    max_broadcast_blocks: int = 100_000

    def __post_init__(self):
        object.__setattr__(self, "key", _tuple(self.key))
        object.__setattr__(self, "tiebreak", _tuple(self.tiebreak))

    @property
    def keys(self) -> list[str]:
        return list(self.key)

    def ordering(self, df: DataFrame) -> list[Column]:
        """Nulls first, then NaN, then values, then the tie-breaks."""
        return [order_number(df, self.order).asc_nulls_first(), F.col(self.order).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in self.tiebreak]]

    def with_index(self, name: str) -> "SeriesSpec":
        return SeriesSpec(self.order, self.key, self.tiebreak, name, self.block_rows, self.width,
                          self.max_broadcast_blocks)

    def with_blocks(self, block_rows: int) -> "SeriesSpec":
        return SeriesSpec(self.order, self.key, self.tiebreak, self.index, block_rows, self.width,
                          self.max_broadcast_blocks)


def order_number(df: DataFrame, name: str) -> Column:
    """The order column as a DOUBLE on a linear scale (days for DATE, µs for TIMESTAMP)."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        # no place on the scale: with the nulls, -Inf below everything, +Inf above
        c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def null_safe_join(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join on ``on`` in which a null key or block meets its own row, so
    rows with a null key or order value are neither lost nor cut off from
    earlier blocks."""
    table = table.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in table.columns])
    cond = None
    for c in on:
        same = df[c].eqNullSafe(table[f"_on_{c}"])
        cond = same if cond is None else cond & same
    return df.join(table, cond, "left").drop(*[f"_on_{c}" for c in on])


ROOM = 4      # a range may hold this many times ``block_rows`` rows
MOST_CUTS = 20  # rounds of cutting; each divides what is left by the size of its ranges


def with_row_index(df: DataFrame, spec: SeriesSpec, name: str = RI) -> DataFrame:
    """Add the 0-based position of each row inside its series.

    If no series is longer than a block, a ``row_number`` per key is all.
    Otherwise only the longer ones (at most ``n / block_rows`` of them) are cut
    into ranges of the order value (``_cut_ranges``), and a ``row_number`` per
    range is added to the number of rows in the ranges before it.

    Null order values come first in their series, then NaN; -Inf and +Inf stand
    at its ends.  Rows that are equal in the order and every tie-break that is a
    number cannot be cut: they are one task, in no fixed order."""
    if spec.index is not None and spec.index in df.columns:
        return df.withColumn(name, F.col(spec.index).cast("long"))
    keys = spec.keys
    if spec.width is not None:
        d, cells = df.withColumn("_c0", F.floor(order_number(df, spec.order) / F.lit(float(spec.width))).cast("long")), ["_c0"]
    else:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        if (sizes.agg(F.max("_n")).first()[0] or 0) <= spec.block_rows:
            w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*spec.ordering(df))
            return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
        d, cells = _cut_ranges(df, spec)
    counts = d.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("_cn"))
    before = Window.partitionBy(*keys).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, *cells, F.coalesce(F.sum("_cn").over(before), F.lit(0)).cast("long").alias("_off"))
    d = null_safe_join(d, offs, [*keys, *cells])
    w = Window.partitionBy(*keys, *cells).orderBy(*spec.ordering(df))
    return d.select(*df.columns, (F.col("_off") + F.row_number().over(w) - 1).cast("long").alias(name))


def _cut_ranges(df: DataFrame, spec: SeriesSpec) -> tuple[DataFrame, list[str]]:
    """``df`` with range columns ``_c0, _c1, ...`` whose order is that of the
    rows.  Each round cuts the ranges that hold more than ``ROOM`` blocks, evenly
    between their least and greatest finite value of the first number that
    still differs in them: the order itself, or a tie-break.  The table of these
    ranges has at most ``n / block_rows`` rows; it is broadcast under a count."""
    keys, size = spec.keys, spec.block_rows
    kinds = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    names = [spec.order, *[c for c in spec.tiebreak if isinstance(df.schema[c].dataType, kinds)]]
    numbers = [order_number(df, c) for c in names]
    if len(names) - 1 < len(spec.tiebreak):  # a tie-break that is no number hides those behind it
        numbers = numbers[: 1 + next(i for i, c in enumerate(spec.tiebreak) if c not in names)]
    d, cells = df, []
    for turn in range(MOST_CUTS):
        parts = F.ceil(F.col("_n") / size)
        stats = [F.count(F.lit(1)).alias("_n")]
        for i, x in enumerate(numbers):
            finite = F.when(F.abs(x) < F.lit(float("inf")), x)
            stats += [F.min(finite).alias(f"_lo{i}"), F.max(finite).alias(f"_hi{i}"), (F.min(x).eqNullSafe(F.max(x)) & F.count(x).isin(0, F.count(F.lit(1)))).alias(f"_same{i}")]
        which = F.lit(None).cast("int")
        for i in reversed(range(len(numbers))):
            which = F.when(~F.col(f"_same{i}"), F.lit(i)).otherwise(which)
        full = d.groupBy(*keys, *cells).agg(*stats).where(F.col("_n") > (ROOM if turn else 1) * size).withColumn("_by", which).where("_by IS NOT NULL")

        def chosen(part: str) -> Column:
            return F.element_at(F.array(*[F.col(f"{part}{i}") for i in range(len(numbers))]), F.col("_by") + 1)

        full = full.select(*keys, *cells, "_by", chosen("_lo").alias("_lo"), chosen("_hi").alias("_hi"), F.greatest(parts, F.lit(2)).cast("double").alias("_m"))
        n_full = full.limit(spec.max_broadcast_blocks + 1).count()
        if not n_full and turn:
            break
        d = null_safe_join(d, F.broadcast(full) if n_full <= spec.max_broadcast_blocks else full, [*keys, *cells])
        x = F.element_at(F.array(*numbers), F.col("_by") + 1)
        at = F.coalesce(F.try_divide((x - F.col("_lo")) * F.col("_m"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
        cell = (F.when(F.col("_by").isNull(), F.lit(0.0)).when(x.isNull(), F.lit(-2.0)).when(x == F.lit(float("-inf")), F.lit(-1.0))
                .when(x == F.lit(float("inf")), F.col("_m") + 1).otherwise(F.greatest(F.lit(0.0), F.least(F.floor(at).cast("double"), F.col("_m") - 1))))
        d = d.withColumn(f"_c{turn}", cell.cast("long")).drop("_by", "_lo", "_hi", "_m")
        cells.append(f"_c{turn}")
    return d, cells


def ensure_index(df: DataFrame, spec: SeriesSpec) -> tuple[DataFrame, str, bool]:
    """Return (df, index column, added?) so callers can drop a helper index."""
    if spec.index is not None and spec.index in df.columns:
        return df, spec.index, False
    if RI in df.columns:
        return df, RI, False
    return with_row_index(df, spec, RI), RI, True


def windowed(
    df: DataFrame,
    spec: SeriesSpec,
    build: Callable[[WindowSpec], Sequence[Column]],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Append window columns built by ``build(w)``; frames reach at most
    ``before`` rows back and ``after`` rows ahead.

    ``w`` is ordered by the series position; use ``w.rowsBetween(...)`` for
    frames.  Work is partitioned by ``(key, block)`` with halo rows, so the
    result equals the one-partition window for any block size > halo.
    """
    df, ri, added = ensure_index(df, spec)
    B = max(spec.block_rows, before + 1, after + 1)
    blk = F.floor(F.col(ri) / F.lit(B)).cast("long")
    pos = F.col(ri) - blk * F.lit(B)
    lo = F.when(pos < F.lit(after), blk - 1).otherwise(blk) if after else blk
    hi = F.when(pos >= F.lit(B - before), blk + 1).otherwise(blk) if before else blk
    base_cols = [c for c in df.columns]
    if before or after:
        d = df.select("*", F.explode(F.sequence(lo, hi)).alias("_blk"))
    else:
        d = df.withColumn("_blk", blk)
    w = Window.partitionBy(*spec.keys, "_blk").orderBy(F.col(ri))
    out = d.select(*base_cols, *build(w), (F.col("_blk") == blk).alias("_own"))
    out = out.filter(F.col("_own")).drop("_own")
    if added:
        out = out.drop(ri)
    return out


def _block_table_join(d: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    # carry has one row per (key, block); AQE turns this into a broadcast
    # join at run time when the measured table is small
    return null_safe_join(d, carry, [*keys, "_blk"])


def prefix_sum(df: DataFrame, spec: SeriesSpec, cols: dict[str, Column]) -> DataFrame:
    """Running (unbounded preceding .. current) sums, one output per entry of
    ``cols`` (name -> value expression), computed as in-block running sum plus
    the sum of all earlier blocks."""
    df, ri, added = ensure_index(df, spec)
    keys = spec.keys
    B = spec.block_rows
    d = df.withColumn("_blk", F.floor(F.col(ri) / F.lit(B)).cast("long"))
    for n, e in cols.items():
        d = d.withColumn(f"_v_{n}", e)
    tot = d.groupBy(*keys, "_blk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in cols])
    prev = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*keys, "_blk", *[F.coalesce(F.sum(f"_t_{n}").over(prev), F.lit(0)).alias(f"_c_{n}")
                                        for n in cols])
    d = _block_table_join(d, carry, keys)
    run = Window.partitionBy(*keys, "_blk").orderBy(F.col(ri)).rowsBetween(Window.unboundedPreceding, 0)
    out = d.select(*df.columns, *[(F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.sum(f"_v_{n}").over(run)).alias(n)
                                  for n in cols])
    if added:
        out = out.drop(ri)
    return out


def ffill(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Forward fill: each null takes the last non-null value before it in the
    series (leading nulls stay null).  Block carry: the last non-null value of
    each block, then the last non-null among earlier blocks."""
    df, ri, added = ensure_index(df, spec)
    keys = spec.keys
    B = spec.block_rows
    d = df.withColumn("_blk", F.floor(F.col(ri) / F.lit(B)).cast("long"))
    tot = d.groupBy(*keys, "_blk").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ri))).alias(f"_t_{c}") for c in cols])
    prev = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*keys, "_blk", *[F.last(f"_t_{c}", ignorenulls=True).over(prev).alias(f"_c_{c}")
                                        for c in cols])
    d = _block_table_join(d, carry, keys)
    run = Window.partitionBy(*keys, "_blk").orderBy(F.col(ri)).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c + suffix: F.coalesce(F.last(F.col(c), ignorenulls=True).over(run), F.col(f"_c_{c}")) for c in cols}
    keep = [c for c in df.columns if c not in filled]
    out = d.select(*keep, *[e.alias(n) for n, e in filled.items()])
    out = out.select(*[c for c in df.columns if c in out.columns], *[n for n in filled if n not in df.columns])
    if added:
        out = out.drop(ri)
    return out


def restrict(df: DataFrame, spec: SeriesSpec, lo, hi, halo: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Evaluate ``build`` on the order range [lo, hi] only.

    A filter on the order column cannot pass below a window, so the source is
    cut to ``[lo - halo, hi]`` first (``halo`` in order units, at least the
    largest frame) and the result to ``[lo, hi]`` after.  Both filters reach
    the Parquet scan as pushed predicates.
    """
    src = df.filter((F.col(spec.order) >= F.lit(lo - halo)) & (F.col(spec.order) <= F.lit(hi)))
    out = build(src)
    return out.filter((F.col(spec.order) >= F.lit(lo)) & (F.col(spec.order) <= F.lit(hi)))


def slice_rows(df: DataFrame, spec: SeriesSpec, lo: int, hi: int | None = None) -> DataFrame:
    """Positional slice ``iloc[lo:hi]`` per series."""
    df, ri, added = ensure_index(df, spec)
    cond = F.col(ri) >= F.lit(lo)
    if hi is not None:
        cond = cond & (F.col(ri) < F.lit(hi))
    out = df.filter(cond)
    return out.drop(ri) if added else out


def series_length(df: DataFrame, spec: SeriesSpec, ri: str) -> DataFrame:
    """One row per series with its length (``max(pos) + 1``)."""
    return df.groupBy(*spec.keys).agg((F.max(ri) + 1).alias("_n"))


def attach_length(df: DataFrame, spec: SeriesSpec, ri: str) -> DataFrame:
    """Join each row with its series length; for one series the length table
    has one row and is broadcast."""
    lens = series_length(df, spec, ri)
    if not spec.keys:
        return df.crossJoin(F.broadcast(lens))  # exactly one row
    return null_safe_join(df, lens, spec.keys)


def take_evenly(df: DataFrame, spec: SeriesSpec, m: int, ri: str) -> DataFrame:
    """Keep rows at positions ``floor(k*(n-1)/(m-1))``, k = 0..m-1 (P11): the
    rows a ``linspace`` index picks; all rows when n <= m."""
    d = attach_length(df, spec, ri)
    n = F.col("_n")
    # position p is picked iff some k has floor(k*(n-1)/(m-1)) = p, i.e.
    # ceil(p*(m-1)/(n-1)) * (n-1) < (p+1)*(m-1)
    k = F.ceil(F.col(ri) * F.lit(m - 1) / (n - 1))
    picked = (n <= F.lit(m)) | ((k * (n - 1)) < (F.col(ri) + 1) * F.lit(m - 1))
    return d.filter(picked).drop("_n")


def is_sorted(df: DataFrame, spec: SeriesSpec, col: str) -> DataFrame:
    """Rows where ``col`` decreases relative to the previous row (S3/K9).
    An empty result means the column is sorted in series order."""
    out = windowed(df, spec, lambda w: [F.lag(col, 1).over(w).alias("_prev")], before=1)
    return out.filter(F.col("_prev") > F.col(col))
