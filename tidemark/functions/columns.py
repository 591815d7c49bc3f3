"""Column helpers (scalar functions F1-F18).

All return ``Column`` expressions built from ``pyspark.sql.functions`` so they
stay inside whole-stage codegen.  Spark runs with ANSI mode on, where ``x/0``
raises; every ratio goes through ``safe_div`` (``try_divide``) instead.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the reference ---------------------------------
# trading calendar: 252 days a year, weeks of 5 days, months of 21 days
DAYS_PER_YEAR = 252
DAYS_PER_WEEK = 5
DAYS_PER_MONTH = 21
# small constant added to denominators of ratios and z-scores
EPS = 1e-8
# column families by prefix
FAMILIES = ("D", "E", "I", "M", "P", "S", "V")
# -----------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_d(v: float) -> Column:
    """A DOUBLE literal (plain Python floats can become DECIMAL in SQL text)."""
    return F.lit(float(v)).cast("double")


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI-safe)."""
    return F.try_divide(_c(a), _c(b))


def null_if_nonfinite(x) -> Column:
    """NaN, +Inf and -Inf become NULL (F8, M4)."""
    c = _c(x)
    return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), F.lit(None).cast("double")).otherwise(c)


def clip(x, lo: float, hi: float) -> Column:
    """``least(greatest(x, lo), hi)`` keeping NULL as NULL."""
    c = _c(x)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.greatest(c, lit_d(lo)), lit_d(hi)))


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 INT where a NULL comparison gives 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def sign_match(a, b) -> Column:
    """1 when ``sign(a) == sign(b)``; a NULL on either side gives 0."""
    return flag(F.signum(_c(a)) == F.signum(_c(b)))


def sign_differs(a, b) -> Column:
    """1 when signs differ; NULL != NULL counts as different."""
    return F.lit(1) - sign_match(a, b)


def cyclic(pos, period: float) -> tuple[Column, Column]:
    """(sin, cos) of ``2*pi*pos/period`` (F2)."""
    ang = F.lit(2.0 * math.pi) * _c(pos) / lit_d(period)
    return F.sin(ang), F.cos(ang)


def bias_corrected_skew(g1, n) -> Column:
    """Sample skewness G1 from population g1 and count n (n >= 3)."""
    n = _c(n).cast("double")
    return F.when(n >= 3, _c(g1) * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurt(g2, n) -> Column:
    """Sample excess kurtosis G2 from population excess g2 and count n (n >= 4)."""
    n = _c(n).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * _c(g2) + 6))


def row_stats(cols: Sequence[str]) -> dict[str, Column]:
    """Row-wise statistics over a column family, skipping NULLs.

    mean/std (ddof 1)/max/min/median/sum/abs_sum/n_pos/n_neg/n_valid.
    Sum of an all-NULL row is 0, like pandas; mean/std are NULL.
    """
    cs = [F.col(c) for c in cols]
    n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    s = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    mean = safe_div(s, n.cast("double"))
    ss = sum((F.coalesce((F.col(c) - mean) * (F.col(c) - mean), F.lit(0.0)) for c in cols), F.lit(0.0))
    std = F.when(n >= 2, F.sqrt(ss / (n - 1)))
    arr = F.array_sort(F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda v: v.isNotNull()))
    k = F.size(arr)
    mid_lo = F.element_at(arr, F.floor((k + 1) / 2).cast("int"))
    mid_hi = F.element_at(arr, F.floor(k / 2).cast("int") + 1)
    median = F.when(k > 0, (mid_lo + mid_hi) / 2)
    return {
        "mean": mean,
        "std": std,
        "max": F.greatest(*cs) if len(cs) > 1 else cs[0],
        "min": F.least(*cs) if len(cs) > 1 else cs[0],
        "median": median,
        "sum": s,
        "abs_sum": sum((F.coalesce(F.abs(F.col(c)), F.lit(0.0)) for c in cols), F.lit(0.0)),
        "n_pos": sum((flag(F.col(c) > 0) for c in cols), F.lit(0)),
        "n_neg": sum((flag(F.col(c) < 0) for c in cols), F.lit(0)),
        "n_valid": n,
        "n_null": F.lit(len(cols)) - n,
    }


def row_nulls(cols: Iterable[str]) -> Column:
    """Number of NULL cells in the row."""
    return sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))


def winsorize(x, med, mad, k: float = 4.0) -> Column:
    """Clip x to ``med +- k*mad`` (F18); med and mad are columns (e.g. from a
    broadcast one-row aggregate)."""
    c = _c(x)
    lo = _c(med) - lit_d(k) * _c(mad)
    hi = _c(med) + lit_d(k) * _c(mad)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.greatest(c, lo), hi))


def label_map(x, mapping: dict) -> Column:
    """Lookup of a label in a small fixed dict (F16)."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), _c(x))


def bins_right_closed(x, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """``pd.cut`` with right-closed intervals ``(c_i, c_{i+1}]`` (F15);
    values outside all intervals are NULL."""
    c = _c(x)
    e = None
    for i, lab in enumerate(labels):
        lo, hi = cuts[i], cuts[i + 1]
        cond = (c > lit_d(lo)) & (c <= lit_d(hi))
        e = F.when(cond, F.lit(lab)) if e is None else e.when(cond, F.lit(lab))
    return e


_FAMILY_STRICT = re.compile(r"^([A-Z]+)(\d+)$")


def family(columns: Iterable[str], prefix: str, strict: bool = True) -> list[str]:
    """Columns of a family (P1/P1b): strict means prefix + digits only
    (``V12``); non-strict means any name starting with the prefix."""
    out = []
    for c in columns:
        if strict:
            m = _FAMILY_STRICT.match(c)
            if m and m.group(1) == prefix:
                out.append(c)
        elif c.startswith(prefix):
            out.append(c)
    return out


def numeric_columns(schema, include_ints: bool = True) -> list[str]:
    """Columns by dtype."""
    from pyspark.sql import types as T

    kinds = (T.DoubleType, T.FloatType, T.DecimalType)
    if include_ints:
        kinds = kinds + (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    return [f.name for f in schema.fields if isinstance(f.dataType, kinds)]


def schema_diff(a_cols: Iterable[str], b_cols: Iterable[str]) -> tuple[list[str], list[str]]:
    """Columns only in a, only in b (U4), in their original order."""
    a, b = list(a_cols), list(b_cols)
    sb, sa = set(b), set(a)
    return [c for c in a if c not in sb], [c for c in b if c not in sa]


def safe_corr(a, b):
    """Pearson correlation on pairwise-complete rows, NULL when either side
    has zero variance (Spark's ``corr`` raises DIVIDE_BY_ZERO under ANSI)."""
    x, y = _c(a).cast("double"), _c(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xa, ya = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(xa, ya), F.stddev_samp(xa) * F.stddev_samp(ya))
