"""CSV tables, in batch or as a stream, with an explicit schema.

Nothing is inferred.  A row that does not fit the schema is not lost and does
not stop the read: it comes out beside the good rows with the text of its line.
NaN and infinite numbers become NULL at the door.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import null_if_nonfinite
from tidemark.operators.series import SeriesSpec, with_row_index

LINE = "_line"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Rows of the CSV files below ``path`` (with a header line each) in the
    columns of ``schema``, and ``_line``: NULL for a good row, else the text of
    the line.  Doubles and floats are finite or NULL.  With ``stream`` new files
    are read as they come, at most ``files_per_batch`` at once."""
    reader = spark.readStream if stream else spark.read
    # every column may be null in a row that does not fit
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    reader = reader.schema(T.StructType([*fields, T.StructField(LINE, T.StringType())])).option("header", True).option("mode", "PERMISSIVE")
    # whether a row fits must not depend on which columns a query reads
    reader = reader.option("columnNameOfCorruptRecord", LINE).option("enforceSchema", False).option("columnPruning", False)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    real = {f.name for f in fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    rows = reader.csv(path)
    # Spark refuses a query that reads the line alone: it always reads one column more
    line = F.when(F.hash(fields[0].name) >= F.lit(-(1 << 31)), F.col(LINE))
    return rows.select(*[null_if_nonfinite(F.col(c).cast("double")).cast(rows.schema[c].dataType).alias(c) if c in real else line.alias(c) if c == LINE else F.col(c)
                         for c in rows.columns])


def good_rows(rows: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows that fit the schema and have their required columns."""
    ok = F.col(LINE).isNull()
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return rows.where(ok).drop(LINE)


def bad_rows(rows: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """The others: ``line`` (NULL where only a required column is missing),
    ``reason`` and the required columns."""
    missing = F.lit(None).cast("string")
    for c in reversed(required):
        missing = F.when(F.col(c).isNull(), F.lit(f"no {c}")).otherwise(missing)
    why = F.when(F.col(LINE).isNotNull(), F.lit("does not fit the schema")).otherwise(missing)
    return rows.withColumn("reason", why).where("reason IS NOT NULL").select(F.col(LINE).alias("line"), "reason", *required)


def with_id(rows: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """S3: ``rows`` with the id column ``name``; where the table has none, the
    0-based position by ``order``, or by file and line without one."""
    if name in rows.columns:
        return rows
    if order is not None:
        return with_row_index(rows, SeriesSpec(order), name)
    placed = rows.select("*", F.monotonically_increasing_id().alias("_place"))  # file splits in order, lines in order
    return with_row_index(placed, SeriesSpec("_place"), name).drop("_place")
