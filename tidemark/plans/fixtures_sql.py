"""The derived series as DuckDB SQL (CTE bodies) for the oracle side.

Each mirrors a builder in ``tidemark.sources.tables`` and is written once;
oracle queries start with ``WITH`` + the fixtures they need.
"""

DAILY_MARKET = """
dm0 AS (
  SELECT CAST(o_orderdate AS DATE) AS d,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
         COUNT(*) AS n
  FROM orders GROUP BY 1),
dm1 AS (
  SELECT ROW_NUMBER() OVER (ORDER BY d) - 1 AS date_id, d, price,
         LEAD(price) OVER (ORDER BY d) AS nxt, n
  FROM dm0),
daily_market AS (
  SELECT date_id, d, price,
         CAST(0.02 AS DOUBLE) * (nxt - price) / (nxt + price) AS forward_returns,
         CAST(0.0001 AS DOUBLE) * (n % 5) AS risk_free_rate
  FROM dm1)"""

USER_SERIES = """
user_series AS (
  SELECT user_id, ts, event_id, value,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events)"""

WIDE_DAILY = """
wd0 AS (
  SELECT CAST(l_shipdate AS DATE) AS d,
         COUNT(*) AS E1,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS E2,
         STDDEV_SAMP(l_quantity) AS V1, STDDEV_SAMP(l_extendedprice) AS V2,
         STDDEV_SAMP(l_discount) AS V3, STDDEV_SAMP(l_tax) AS V4,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) - CAST(25 AS DOUBLE) AS M1,
         CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) - CAST(0.05 AS DOUBLE) AS M2,
         CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) - CAST(0.04 AS DOUBLE) AS M3,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*)
             - CAST(1 AS DOUBLE) / CAST(3 AS DOUBLE) AS S1,
         CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) - CAST(0.5 AS DOUBLE) AS S2,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS P1,
         MAX(l_extendedprice) AS P2,
         MIN(l_tax) AS I1,
         CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS I2,
         MAX(l_tax) AS I3
  FROM lineitem GROUP BY 1),
wide_daily AS (
  SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS date_id,
         CAST(((CAST(d - DATE '1970-01-01' AS BIGINT) + 3) % 7) < 5 AS BIGINT) AS D1,
         E1, E2, V1, V2, V3, V4, M1, M2, M3, S1, S2, P1, P2, I1, I2, I3,
         LEAD(M1) OVER (ORDER BY d) AS target
  FROM wd0)"""

WIDE_DAILY_NULLS = WIDE_DAILY + """,
wide_daily_nulls AS (
  SELECT d, date_id, D1, E1,
         CASE WHEN date_id BETWEEN 700 AND 760 THEN NULL ELSE E2 END AS E2,
         V1, CASE WHEN date_id % 2 = 0 THEN NULL ELSE V2 END AS V2, V3, V4,
         CASE WHEN date_id % 4 = 0 THEN NULL ELSE M1 END AS M1, M2, M3,
         CASE WHEN date_id % 10 < 3 THEN NULL ELSE S1 END AS S1, S2,
         CASE WHEN date_id < 500 THEN NULL ELSE P1 END AS P1, P2, I1, I2, I3, target
  FROM wide_daily)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)
