"""Registry of named queries: a Spark builder and, where SQL can express it,
the DuckDB oracle text that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its
    oracle SQL (None: no SQL twin, rows-only check)."""

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = portable_round(sql)
        return fn

    return deco


# Rounding for the oracle comparison.  Exact decimal ties (means of 2-decimal
# prices, moments of quantised rates) are common, and 1e-16 differences between
# engines land on either side of them; the cut is moved a little off the tie.
TIE_SHIFT = 0.5001
ROUND_LIMIT = 1e17  # |x * 10^d| above this is rounded to an integer instead (no BIGINT overflow)
INT_LIMIT = 1e15    # above this, doubles are integers already and are left as they are


def round_half_up(c, digits: int):
    """``floor(x * 10^d + 0.5001) / 10^d``: the same IEEE operations in Spark
    and in the oracle text (``portable_round``)."""
    scale = float(10 ** digits)
    lim = ROUND_LIMIT / scale
    return (F.when(F.abs(c) < F.lit(lim), F.floor(c * F.lit(scale) + F.lit(TIE_SHIFT)) / F.lit(scale))
            .when(F.abs(c) < F.lit(INT_LIMIT), F.floor(c + F.lit(TIE_SHIFT)).cast("double")).otherwise(c))


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Round every DOUBLE column (``per_column`` overrides the digits) so the
    oracle comparison is insensitive to summation order."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_half_up(F.col(f.name).cast("double"), per_column.get(f.name, digits)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def portable_round(sql: str) -> str:
    """Rewrite every ``ROUND(expr, d)`` of an oracle text into
    the same floor expression, the twin of
    ``round_half_up``."""
    out, i, key = [], 0, "ROUND("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        out.append(sql[i:j])
        depth, k, comma = 1, j + len(key), -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        if comma < 0:  # ROUND(x): to an integer, left as is
            out.append(key + portable_round(sql[j + len(key):k]))
            i = k
            continue
        inner = portable_round(sql[j + len(key):comma])
        digits = int(sql[comma + 1:k - 1].strip())
        scale = float(10 ** digits)
        x = f"CAST({inner} AS DOUBLE)"
        out.append(f"(CASE WHEN ABS({x}) < {ROUND_LIMIT / scale!r} THEN FLOOR({x} * {scale!r} + {TIE_SHIFT!r}) / "
                   f"{scale!r} WHEN ABS({x}) < {INT_LIMIT!r} THEN CAST(FLOOR({x} + {TIE_SHIFT!r}) AS DOUBLE) "
                   f"ELSE {x} END)")
        i = k


def unrounded(sql: str) -> str:
    """An oracle text with every ``ROUND(expr, d)`` replaced by ``expr``, for use
    inside a larger one that rounds at its end."""
    out, i = [], 0
    for m in re.finditer(r"(?<!\w)ROUND\(", sql):
        if m.start() < i:
            continue
        depth, k, comma = 1, m.end(), None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            comma = k if sql[k] == "," and depth == 1 else comma
            k += 1
        out += [sql[i:m.start()], "(", unrounded(sql[m.end():comma]), ")"]
        i = k
    return "".join(out) + sql[i:]


def round_sig(c, digits: int = 10):
    """Round to ``digits`` significant digits (same expression as
    ``sig_sql``): for scores spanning many orders of magnitude."""
    s = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, c).otherwise(F.floor(c * s + F.lit(TIE_SHIFT)) / s)


def sig_sql(x: str, digits: int = 10) -> str:
    s = f"POW(10.0, {digits - 1} - FLOOR(LOG10(ABS({x}))))"
    return f"(CASE WHEN {x} = 0 THEN {x} ELSE FLOOR({x} * {s} + {TIE_SHIFT!r}) / {s} END)"
