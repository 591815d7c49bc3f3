"""Sources: table readers and the derived series the operators run on.

The driver's tables are TPC-H-like; the series fixtures turn them into the
shapes the market operators expect (one long daily series, a panel of user
series, a wide daily table with column families).  Each is a lazy DataFrame
derived from the whole table, so its cost grows with the data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import lit_d
from tidemark.operators.series import SeriesSpec, windowed, with_row_index

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Explicit schema of the reference's daily market table (no inference at scale).
MARKET_FAMILIES = {"D": 9, "E": 20, "I": 9, "M": 18, "P": 13, "S": 12, "V": 13}


def market_schema(serving: bool = False) -> T.StructType:
    """Schema of the wide daily market table: ``date_id``, families in lexical
    column order, then targets (training) or ``is_scored`` + lagged targets
    (serving)."""
    fields = [T.StructField("date_id", T.LongType(), False)]
    for fam, n in MARKET_FAMILIES.items():
        names = sorted((f"{fam}{i}" for i in range(1, n + 1)))
        kind = T.LongType() if fam == "D" else T.DoubleType()
        fields += [T.StructField(c, kind, True) for c in names]
    if serving:
        fields += [T.StructField("is_scored", T.BooleanType(), True)]
        fields += [T.StructField(c, T.DoubleType(), True) for c in
                   ("lagged_forward_returns", "lagged_risk_free_rate", "lagged_market_forward_excess_returns")]
    else:
        fields += [T.StructField(c, T.DoubleType(), True) for c in
                   ("forward_returns", "risk_free_rate", "market_forward_excess_returns")]
    return T.StructType(fields)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_market(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None,
                serving: bool = False) -> DataFrame:
    """Read a market table with an explicit schema (CSV with header,
    Parquet or JSON)."""
    schema = schema or market_schema(serving)
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", True).csv(path)
    return r.format(fmt).load(path)


def daily_market(spark: SparkSession, sf_dir: str, block_rows: int | None = None) -> DataFrame:
    """One long daily series from ``orders`` (FIXTURES 3.1).

    ``date_id`` is the 0-based day position, ``price`` the exact (decimal) sum
    of order prices of the day, ``forward_returns`` a bounded next-day return
    and ``risk_free_rate`` a small daily rate.
    """
    o = read_table(spark, sf_dir, "orders")
    days = o.groupBy(F.to_date("o_orderdate").alias("d")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"),
        F.count(F.lit(1)).alias("n"),
    )
    spec = SeriesSpec(order="d")
    if block_rows:
        spec = spec.with_blocks(block_rows)
    days = with_row_index(days, spec, "date_id")
    spec = spec.with_index("date_id")
    out = windowed(days, spec, lambda w: [F.lead("price", 1).over(w).alias("_nxt")], after=1)
    return out.select(
        "date_id", "d", "price",
        (lit_d(0.02) * (F.col("_nxt") - F.col("price")) / (F.col("_nxt") + F.col("price"))).alias("forward_returns"),
        (lit_d(0.0001) * (F.col("n") % 5)).alias("risk_free_rate"),
    )


DAILY = SeriesSpec(order="date_id", index="date_id")


def user_series(spark: SparkSession, sf_dir: str, block_rows: int | None = None) -> DataFrame:
    """Panel of per-user event series (FIXTURES 3.2): ``pos`` is the 0-based
    position by ``(ts, event_id)`` inside each user."""
    e = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    spec = SeriesSpec(order="ts", key="user_id", tiebreak="event_id")
    if block_rows:
        spec = spec.with_blocks(block_rows)
    return with_row_index(e, spec, "pos")


USERS = SeriesSpec(order="pos", key="user_id", index="pos")


def _dsum(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def wide_daily(spark: SparkSession, sf_dir: str, block_rows: int | None = None) -> DataFrame:
    """Wide daily table with families D/E/V/M/S/P/I (FIXTURES 3.3).

    Averages are exact decimal sums divided by the count, so they are the
    same bits in any engine.
    """
    li = read_table(spark, sf_dir, "lineitem")
    n = F.count(F.lit(1))
    days = li.groupBy(F.to_date("l_shipdate").alias("d")).agg(
        n.alias("E1"),
        _dsum("l_quantity").alias("E2"),
        F.stddev_samp("l_quantity").alias("V1"),
        F.stddev_samp("l_extendedprice").alias("V2"),
        F.stddev_samp("l_discount").alias("V3"),
        F.stddev_samp("l_tax").alias("V4"),
        (_dsum("l_quantity") / n - lit_d(25)).alias("M1"),
        (_dsum("l_discount") / n - lit_d(0.05)).alias("M2"),
        (_dsum("l_tax") / n - lit_d(0.04)).alias("M3"),
        (F.sum((F.col("l_returnflag") == "R").cast("long")) / n - lit_d(1.0) / lit_d(3.0)).alias("S1"),
        (F.sum((F.col("l_linestatus") == "O").cast("long")) / n - lit_d(0.5)).alias("S2"),
        (_dsum("l_extendedprice") / n).alias("P1"),
        F.max("l_extendedprice").alias("P2"),
        F.min("l_tax").alias("I1"),
        (_dsum("l_tax") / n).alias("I2"),
        F.max("l_tax").alias("I3"),
    )
    spec = SeriesSpec(order="d")
    if block_rows:
        spec = spec.with_blocks(block_rows)
    days = with_row_index(days, spec, "date_id")
    days = days.withColumn("D1", (((F.unix_date("d") + 3) % 7) < 5).cast("long"))
    out = windowed(days, spec.with_index("date_id"), lambda w: [F.lead("M1", 1).over(w).alias("target")], after=1)
    return out.select("d", "date_id", "D1", "E1", "E2", "V1", "V2", "V3", "V4", "M1", "M2", "M3",
                      "S1", "S2", "P1", "P2", "I1", "I2", "I3", "target")


def wide_daily_nulls(spark: SparkSession, sf_dir: str, block_rows: int | None = None) -> DataFrame:
    """``wide_daily`` with planted missing data (FIXTURES 3.4)."""
    w = wide_daily(spark, sf_dir, block_rows)
    i = F.col("date_id")
    nul = F.lit(None).cast("double")
    return w.select(
        *[c for c in w.columns if c not in ("V2", "M1", "P1", "S1", "E2")],
        F.when(i % 2 == 0, nul).otherwise(F.col("V2")).alias("V2"),
        F.when(i % 4 == 0, nul).otherwise(F.col("M1")).alias("M1"),
        F.when(i < 500, nul).otherwise(F.col("P1")).alias("P1"),
        F.when(i % 10 < 3, nul).otherwise(F.col("S1")).alias("S1"),
        F.when(i.between(700, 760), nul).otherwise(F.col("E2")).alias("E2"),
    ).select(*w.columns)
