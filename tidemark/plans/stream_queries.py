"""Streaming queries: the stateful momentum stream must equal the batch rule."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tidemark.plans.fixtures_sql import USER_SERIES, with_
from tidemark.plans.registry import query
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.tables import user_series
from tidemark.streaming.momentum import momentum_stream, run_stream
from tidemark.streaming.serving import EpochSink

_SM_SQL = with_(USER_SERIES, "s AS (SELECT user_id, pos, value - 35 AS x FROM user_series)") + """
SELECT user_id, pos, CASE WHEN COUNT(x) OVER w >= 5 THEN CASE WHEN AVG(x) OVER w > 0 THEN 1.5 ELSE 0.5 END
                          ELSE 1.0 END AS allocation
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""


@query("stream_momentum", _SM_SQL)
def stream_momentum(spark, sf_dir):
    """The user series replayed as three Parquet parts (pos <= 20, 21-45,
    > 45) through the stateful momentum stream (T1, T2, T6), one run a part from
    the same checkpoint; the sink read back must equal the batch momentum rule.
    Files, sink and checkpoint live under the session's shared checkpoint folder."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    src, sink = os.path.join(base, "source"), EpochSink(spark, os.path.join(base, "sink"))
    us = user_series(spark, sf_dir).select("user_id", "pos", (F.col("value") - 35).alias("x"))
    for cond in (F.col("pos") <= 20, F.col("pos").between(21, 45), F.col("pos") > 45):
        us.filter(cond).write.mode("append").parquet(src)
        sdf = spark.readStream.schema("user_id long, pos long, x double").parquet(src)
        run_stream(momentum_stream(sdf, "user_id", "pos", "x", 5), sink, os.path.join(base, "checkpoint"))
    return sink.read("good", "key long, pos long, allocation double").withColumnRenamed("key", "user_id")
