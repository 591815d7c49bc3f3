"""Session helpers: one place for the configuration the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "tidemark", cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the existing session.

    AQE stays on so shuffle partitions are coalesced at run time and skewed
    partitions are split; the UI is off (no server is started).
    """
    parts = shuffle_partitions or (os.cpu_count() or 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; a folder of our own is only set when the
    session has none (local tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    target = conf or fallback
    if target is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        target = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target
