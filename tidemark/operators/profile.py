"""Profiles and exploratory statistics.

Wide statistics are one aggregate over all columns (chunked to stay under the
codegen size limit) unpivoted with ``stack`` into long form
``(column, stat...)``: one scan, one tiny shuffle, no per-column jobs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import safe_corr, bias_corrected_kurt, bias_corrected_skew, lit_d
from tidemark.operators.series import SeriesSpec, attach_length, ensure_index, with_row_index

CHUNK = 40  # columns per aggregate; ~10 expressions each keeps codegen small


def _chunks(cols: Sequence[str], n: int = CHUNK):
    for i in range(0, len(cols), n):
        yield list(cols[i:i + n])


def _long(df: DataFrame, cols: Sequence[str], stats: dict[str, callable]) -> DataFrame:
    """One aggregate with ``stats[name](col)`` for every column, unpivoted to
    one row per column."""
    parts = []
    names = list(stats)
    for chunk in _chunks(cols):
        aggs = [fn(F.col(c)).alias(f"{i}__{j}") for i, c in enumerate(chunk) for j, fn in enumerate(stats.values())]
        wide = df.agg(*aggs)
        rows = ", ".join(f"'{c}', " + ", ".join(f"`{i}__{j}`" for j in range(len(names)))
                         for i, c in enumerate(chunk))
        parts.append(wide.selectExpr(f"stack({len(chunk)}, {rows}) as (column, {', '.join(names)})"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def describe_long(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """count, mean, std (ddof 1), min, quartiles, max, bias-corrected skew and
    excess kurtosis per column (A1, A3-A6, L6).  ``approx`` switches the exact
    percentiles (which hold each group's distinct values) to
    ``percentile_approx`` for very large columns."""
    q = (lambda c, p: F.percentile_approx(c, p, 10000)) if approx else (lambda c, p: F.percentile(c, p))
    stats = {
        "count": lambda c: F.count(c),
        "mean": lambda c: F.avg(c.cast("double")),
        "std": lambda c: F.stddev_samp(c.cast("double")),
        "min": lambda c: F.min(c.cast("double")),
        "q25": lambda c: q(c.cast("double"), 0.25),
        "median": lambda c: q(c.cast("double"), 0.5),
        "q75": lambda c: q(c.cast("double"), 0.75),
        "max": lambda c: F.max(c.cast("double")),
        "g1": lambda c: F.skewness(c.cast("double")),
        "g2": lambda c: F.kurtosis(c.cast("double")),
    }
    out = _long(df, cols, stats)
    return out.select("column", "count", "mean", "std", "min", "q25", "median", "q75", "max",
                      bias_corrected_skew(F.col("g1"), F.col("count")).alias("skew"),
                      bias_corrected_kurt(F.col("g2"), F.col("count")).alias("kurt"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], block_rows: int = 1 << 18) -> DataFrame:
    """Exact interpolated quantiles ``column, prob, value`` at any size (A4,
    A5): the values of all columns are numbered in order by ranges of at most a
    few ``block_rows`` (``series.with_row_index``) and the rows at the two ranks
    around each quantile are picked, so no task holds a column's distinct
    values.  Nulls and NaN are left out; a column without values has no rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("v")) for c in cols])).alias("x"))
    long = long.select("x.column", "x.v").where("v IS NOT NULL")
    placed = with_row_index(long, SeriesSpec("v", "column", block_rows=block_rows), "_pos")
    at = (F.col("n") - 1) * F.col("prob")
    wanted = long.groupBy("column").agg(F.count(F.lit(1)).alias("n")).select("column", "n", F.explode(F.array(*[lit_d(p) for p in probs])).alias("prob"))
    low = F.struct(F.floor(at).alias("_pos"), (lit_d(1.0) - (at - F.floor(at))).alias("w"))
    high = F.struct(F.least(F.floor(at) + 1, F.col("n") - 1).alias("_pos"), (at - F.floor(at)).alias("w"))
    wanted = wanted.select("column", "prob", F.explode(F.array(low, high)).alias("t")).select("column", "prob", "t._pos", "t.w")
    met = placed.join(F.broadcast(wanted), ["column", "_pos"])  # two rows a column and quantile
    return met.groupBy("column", "prob").agg(F.sum(F.col("v") * F.col("w")).alias("value"))


def percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], cells: int = 4096, few: int = 1 << 17) -> dict[str, list[float | None]]:
    """Exact interpolated percentiles of each column, as ``F.percentile`` gives
    them (nulls are left out, NaN is above all; no value: None), from counts
    alone: no task sees a column's distinct values.

    The rows at the two ranks around each percentile are searched by halving at
    a larger base.  A round counts the values between the least and the greatest
    that a rank may have in ``cells`` even cells, and goes on in the cell that
    holds the rank, until that has one value; where at most ``few`` rows are
    left, they are counted by value.  ``df`` is read once a round, for all
    columns together, hence must give the same values each time."""
    v = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    inf, wide, wanted, value, open_ = float("inf"), [], [], {}, []
    for i in range(len(cols)):
        x = F.col(f"v{i}")
        finite = F.when(F.abs(x) < F.lit(inf), x)
        wide += [F.count(x), F.count(F.when(x == -inf, 1)), F.count(finite), F.min(finite), F.max(finite), F.count(F.when(x == inf, 1))]
    first = v.agg(*[x.alias(f"s{j}") for j, x in enumerate(wide)]).first()
    for i in range(len(cols)):
        n, below, inside, lo, hi, top = first[6 * i: 6 * i + 6]
        wanted.append([(n - 1) * float(p) for p in probs] if n else [])
        ranks = {f(at) for at in wanted[i] for f in (math.floor, math.ceil)}
        value.update({(i, r): -inf if r < below else inf if r < below + inside + top else math.nan for r in ranks if not 0 <= r - below < inside})
        ranks = [r for r in ranks if 0 <= r - below < inside]
        if ranks:
            open_.append((i, lo, hi, below, inside, ranks))
    while True:
        value.update({(i, r): lo for i, lo, hi, _, _, ranks in open_ if lo == hi for r in ranks})
        open_ = [b for b in open_ if b[1] < b[2]]
        if not open_:
            break
        met = [F.lit(None).cast("struct<b int, v double, cell double>")] * len(cols)
        here = F.lit(False)
        for b, (i, lo, hi, below, inside, ranks) in enumerate(open_):
            x, unit = F.col(f"v{i}"), 1.0 if hi - lo < inf else 0.25  # the difference of huge values may overflow
            at = (x * unit - lo * unit) / F.lit(hi * unit - lo * unit) * cells
            cell = x if inside <= few else F.least(F.floor(at).cast("double"), F.lit(cells - 1.0))
            met[i] = F.when(x.between(lo, hi), F.struct(F.lit(b).alias("b"), x.alias("v"), cell.alias("cell"))).otherwise(met[i])
            here = here | (F.col("b") == b) & reduce(or_, [(F.col("upto") > r - below) & (F.col("upto") - F.col("n") <= r - below) for r in ranks])
        each = v.select(F.explode(F.array(*met)).alias("x")).where("x IS NOT NULL").select("x.*")
        counts = each.groupBy("b", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("b").orderBy("cell")))
        found, now = counts.where(here).collect(), []
        for row in found:
            i, _, _, below, _, ranks = open_[row.b]
            now.append((i, row.lo, row.hi, below + row.upto - row.n, row.n, [r for r in ranks if row.upto - row.n <= r - below < row.upto]))
        open_ = now
    out = {}
    for i, c in enumerate(cols):
        made = []
        for at in wanted[i] or [None] * len(probs):
            low, high = (None, None) if at is None else (value[i, math.floor(at)], value[i, math.ceil(at)])
            made.append(low if low == high or at is None or at == math.floor(at) else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
        out[c] = made
    return out


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent per column (A7), one aggregate."""
    cols = list(cols or df.columns)
    stats = {"null_count": lambda c: F.sum(c.isNull().cast("long")), "n": lambda c: F.count(F.lit(1))}
    out = _long(df, cols, stats)
    return out.select("column", "null_count", (F.col("null_count") * lit_d(100.0) / F.col("n")).alias("null_pct"))


def null_total(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Total null cells and their share of all cells."""
    cols = list(cols or df.columns)
    nulls = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    return df.agg(F.sum(nulls).alias("null_cells"), F.count(F.lit(1)).alias("rows")).select(
        "null_cells", "rows", (F.col("null_cells") * lit_d(100.0) / (F.col("rows") * len(cols))).alias("null_pct"))


def blocks(df: DataFrame, spec: SeriesSpec, k: int, remainder: str = "drop", name: str = "block") -> DataFrame:
    """Block id ``floor(pos / (n // k))`` per series (V1).  ``remainder='drop'``
    drops the rows past ``k`` full blocks; ``'last'`` gives them to block k-1."""
    d, ri, added = ensure_index(df, spec)
    d = attach_length(d, spec, ri)
    size = F.floor(F.col("_n") / k)
    b = F.floor(F.col(ri) / size).cast("long")
    if remainder == "last":
        d = d.withColumn(name, F.least(b, F.lit(k - 1).cast("long")))
    else:
        d = d.withColumn(name, b).filter(F.col(name) < k)
    d = d.filter(size > 0).drop("_n")
    return d.drop(ri) if added else d


def null_blocks(df: DataFrame, spec: SeriesSpec, k: int = 10, cols: Sequence[str] | None = None) -> DataFrame:
    """Percent of null cells per time block with its order range."""
    cols = list(cols or df.columns)
    d = blocks(df, spec, k)
    nulls = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    return d.groupBy(*spec.keys, "block").agg(
        F.min(spec.order).alias("first"), F.max(spec.order).alias("last"),
        (F.sum(nulls) * lit_d(100.0) / (F.count(F.lit(1)) * len(cols))).alias("null_pct"))


def block_stats(df: DataFrame, spec: SeriesSpec, col: str, k: int, remainder: str) -> DataFrame:
    """Mean, sample std and variance of ``col`` per time block."""
    d = blocks(df, spec, k, remainder)
    return d.groupBy(*spec.keys, "block").agg(
        F.min(spec.order).alias("first"), F.max(spec.order).alias("last"),
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.var_samp(col).alias("var"))


def stationarity(df: DataFrame, spec: SeriesSpec, col: str, k: int = 5, tol: float = 1e-4) -> DataFrame:
    """Population variance of the ``k`` block variances of the non-null
    values, and the ``< tol`` flag (E5)."""
    d = df.filter(F.col(col).isNotNull())
    d, ri, _ = ensure_index(d, spec) if spec.index is None else (d, None, False)
    sub = SeriesSpec(order=ri or spec.order, key=spec.key, block_rows=spec.block_rows,
                     width=float(spec.block_rows))
    d = with_row_index(d, sub, "__i")
    bs = block_stats(d, sub.with_index("__i"), col, k, "drop")
    return bs.groupBy(*spec.keys).agg(F.var_pop("var").alias("var_of_vars")).withColumn(
        "stationary", F.col("var_of_vars") < lit_d(tol))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal-width bins on [min, max]; the last bin is
    closed (A18).  min/max come from a one-row aggregate (broadcast)."""
    d = df.filter(F.col(col).isNotNull())
    mm = d.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    d = d.crossJoin(F.broadcast(mm))
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col(col) - F.col("__lo")) / width), F.lit(bins - 1))).otherwise(0)
    return d.groupBy(b.cast("long").alias("bin"), "__lo", "__hi").agg(F.count(F.lit(1)).alias("count")).select(
        "bin", (F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / bins).alias("lower"),
        (F.col("__lo") + (F.col("bin") + 1) * (F.col("__hi") - F.col("__lo")) / bins).alias("upper"), "count")


def boxplot(df: DataFrame, col: str, whisker: float = 1.5) -> DataFrame:
    """Q1, median, Q3, whisker ends (most extreme values inside the 1.5 IQR
    fences) and number of fliers (A19)."""
    q = percentiles(df, [col], (0.25, 0.5, 0.75))[col]
    d = df.filter(F.col(col).isNotNull()).withColumns({k: F.lit(x).cast("double") for k, x in zip(("q1", "median", "q3"), q, strict=True)})
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - lit_d(whisker) * iqr, F.col("q3") + lit_d(whisker) * iqr
    inside = (F.col(col) >= lo_f) & (F.col(col) <= hi_f)
    return d.groupBy("q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(col))).alias("whisker_low"), F.max(F.when(inside, F.col(col))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("fliers"))


def ecdf(df: DataFrame, col: str, block_rows: int = 1 << 18) -> DataFrame:
    """Empirical CDF ``rank / n`` by sorted position (E7).  Positions come
    from value-range blocks and a prefix over block counts, not from a
    global single-partition ``row_number``."""
    d = df.select(F.col(col).cast("double").alias(col)).filter(F.col(col).isNotNull())
    d = with_row_index(d, SeriesSpec(order=col, block_rows=block_rows), "__i")
    d = attach_length(d, SeriesSpec(order=col), "__i")
    return d.select(col, ((F.col("__i") + 1) / F.col("_n")).alias("ecdf"))


def qq_grid(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """Normal Q-Q points on a fixed probability grid (E8): sample quantile of
    the standardised column vs the standard normal quantile (constants)."""
    nd = NormalDist()
    q = percentiles(df, [col], probs)[col]
    st = df.agg(F.avg(col).alias("__m"), F.stddev_samp(col).alias("__s")).withColumn("__q", F.array(*[F.lit(x).cast("double") for x in q]))
    rows = [(float(p), nd.inv_cdf(p)) for p in probs]
    grid = df.sparkSession.createDataFrame(rows, "p double, theoretical double")
    g = grid.withColumn("__k", F.row_number().over(Window.orderBy("p")) - 1)  # len(probs) rows
    return g.crossJoin(st).select("p", "theoretical", F.try_divide(F.col("__q")[F.col("__k")] - F.col("__m"), F.col("__s"))
                                  .alias("sample"))


def outliers(df: DataFrame, cols: Sequence[str], method: str = "z", z: float = 3.0, k: float = 1.5) -> DataFrame:
    """Outlier counts per column (E1, E2): ``|x - mean| / std_pop > z`` or
    outside ``[Q1 - k IQR, Q3 + k IQR]``.  One aggregate for the statistics
    (broadcast, one row) or the few passes of ``percentiles``, one for the
    counts."""
    if method == "z":
        st = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
        d = df.crossJoin(F.broadcast(st))
        flags = {c: F.try_divide(F.abs(F.col(c) - F.col(f"m_{c}")), F.col(f"s_{c}")) > lit_d(z) for c in cols}
    elif method == "iqr":
        found, d, flags = percentiles(df, cols, (0.25, 0.75)), df, {}
        for c in cols:
            q1, q3 = (F.lit(x).cast("double") for x in found[c])
            flags[c] = (F.col(c) < q1 - lit_d(k) * (q3 - q1)) | (F.col(c) > q3 + lit_d(k) * (q3 - q1))
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    stats = {"outliers": None, "n": None}
    aggs = [e for c in cols for e in (F.count(F.when(flags[c], 1)).alias(f"o_{c}"), F.count(c).alias(f"n_{c}"))]
    wide = d.agg(*aggs)
    rows = ", ".join(f"'{c}', `o_{c}`, `n_{c}`" for c in cols)
    del stats
    return wide.selectExpr(f"stack({len(cols)}, {rows}) as (column, outliers, n)").withColumn(
        "outlier_pct", F.col("outliers") * lit_d(100.0) / F.col("n"))


def conditional_counts(df: DataFrame, col: str, k: float = 2.0) -> DataFrame:
    """Counts of > 0, < 0, = 0 and beyond mean +- k std (ddof 1)."""
    st = df.agg(F.avg(col).alias("__m"), F.stddev_samp(col).alias("__s"))
    d = df.crossJoin(F.broadcast(st))
    c = F.col(col)
    return d.agg(
        F.count(c).alias("n"), F.count(F.when(c > 0, 1)).alias("positive"), F.count(F.when(c < 0, 1)).alias("negative"),
        F.count(F.when(c == 0, 1)).alias("zero"),
        F.count(F.when(c > F.col("__m") + lit_d(k) * F.col("__s"), 1)).alias("above_k_std"),
        F.count(F.when(c < F.col("__m") - lit_d(k) * F.col("__s"), 1)).alias("below_k_std"))


def extremes(df: DataFrame, col: str, n: int, ids: Sequence[str]) -> DataFrame:
    """The n largest and n smallest values with their ids (K2, J3): two
    ``orderBy().limit()`` top-k plans (no full sort)."""
    hi = df.filter(F.col(col).isNotNull()).orderBy(F.col(col).desc(), *ids).limit(n).select(
        F.lit("largest").alias("side"), *ids, col)
    lo = df.filter(F.col(col).isNotNull()).orderBy(F.col(col).asc(), *ids).limit(n).select(
        F.lit("smallest").alias("side"), *ids, col)
    return hi.unionByName(lo)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value counts for one or many columns (A10): many columns are
    unpivoted to ``(column, value)`` first, then one group-by."""
    if len(cols) == 1:
        return df.groupBy(F.lit(cols[0]).alias("column"), F.col(cols[0]).cast("string").alias("value")).agg(
            F.count(F.lit(1)).alias("count"))
    rows = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {rows}) as (column, value)")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def corr_with(df: DataFrame, cols: Sequence[str], target: str, min_pairs: int = 0) -> DataFrame:
    """Pearson correlation of each column with ``target`` on pairwise
    complete rows and the number of such pairs; NULL below ``min_pairs``
    (A12).  One aggregate for all columns."""
    stats = {"corr": lambda c: safe_corr(c.cast("double"), F.col(target).cast("double")),
             "pairs": lambda c: F.count(F.when(c.isNotNull() & F.col(target).isNotNull(), 1))}
    out = _long(df, cols, stats)
    return out.withColumn("corr", F.when(F.col("pairs") > min_pairs, F.col("corr")))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise correlations on listwise-complete rows, long form
    ``(a, b, corr)`` for a < b in column order (A13).  The pair list is
    over columns (a schema property), not rows."""
    d = df.dropna("any", subset=list(cols)).select(*[F.col(c).cast("double").alias(c) for c in cols])
    at = {c: i for i, c in enumerate(cols)}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = d.agg(*[F.covar_samp(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)], *[F.stddev_samp(c).alias(f"s{i}") for c, i in at.items()])
    rows = ", ".join(f"'{a}', '{b}', try_divide(p{i}, s{at[a]} * s{at[b]})" for i, (a, b) in enumerate(pairs))
    return wide.selectExpr(f"stack({len(pairs)}, {rows}) as (a, b, corr)")


def corr_pairs(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Highly correlated pairs, ``|r| > threshold``."""
    return matrix.filter(F.abs(F.col("corr")) > lit_d(threshold))


def jarque_bera(df: DataFrame, col: str) -> DataFrame:
    """Jarque-Bera normality statistic from population skewness and excess
    kurtosis over the whole column (E6 re-aimed), with its chi-square(2)
    p-value ``exp(-JB/2)``."""
    st = df.agg(F.count(col).alias("n"), F.skewness(col).alias("g1"), F.kurtosis(col).alias("g2"))
    jb = F.col("n") / lit_d(6.0) * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / lit_d(4.0))
    return st.select("n", "g1", "g2", jb.alias("jb"), F.exp(-jb / lit_d(2.0)).alias("p_value"))


def rank_columns(profile: DataFrame, metric: str, n: int, ascending: bool = False) -> DataFrame:
    """Top-n columns of a long profile by a metric, ties by column name
    (K6, K7)."""
    o = F.col(metric).asc() if ascending else F.col(metric).desc()
    return profile.orderBy(o, F.col("column")).limit(n)


def top_abs(df: DataFrame, col: str, n: int, tie: str = "column") -> DataFrame:
    """Top-n rows by absolute value (K3)."""
    return df.orderBy(F.abs(F.col(col)).desc(), F.col(tie)).limit(n)


def family_of(col: Column) -> Column:
    """Family letter of a column name (``V12`` -> ``V``)."""
    return F.regexp_extract(col, r"^([A-Z]+)\d+$", 1)
