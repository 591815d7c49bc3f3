"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: the session's
    ``spark.checkpoint.dir``.  A folder of our own is made only where none is
    set and the session runs in one machine; a cluster without one is an error."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-llm-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: its
    lineage is cut, lost executors cost no recomputation, and later readers
    read only the columns that they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``most_rows``
    rows, else as it is (Spark then joins by shuffle)."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where the
    body uses it within lambdas (Spark would otherwise repeat it there for
    every element)."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def upto(n: Column) -> Column:
    """1, 2, ..., n; empty when n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def words(text: Column) -> Column:
    """The words of a text (``WORD``) in order; null and empty texts have none."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(path: str):
    """``(pyarrow file system, path in it)`` of a local path or a URI, for tasks
    that write binary files."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Sets the session's Arrow batches to few rows: ours hold whole texts, and
    a batch is in memory several times over (executor and Python)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def with_own_columns(docs: DataFrame, used: tuple[str, ...], body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``body(docs)`` with exactly the columns of ``docs``: those named in
    ``used`` (in either case) bear other names while ``body`` runs."""
    taken = {u.lower() for u in used}
    free = "own_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free = "_" + free
    aside = {c: f"{free}{i}" if c.lower() in taken else c for i, c in enumerate(docs.columns)}
    return body(docs.toDF(*aside.values())).select(*[F.col(f"`{v}`").alias(c) for c, v in aside.items()])


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; sizes the number of buckets, never the result."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
