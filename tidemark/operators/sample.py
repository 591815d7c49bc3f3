"""Exact random samples of k rows, for a table or for each key.

A row's place is the MD5 of the seed and its id columns; the k least are the
sample.  So it does not depend on partitions, can be drawn again, grows by
keeping what it had, and samples of parts merge to the sample of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bottom_k(df: DataFrame, k: int, ids: Sequence[str], seed: int = 0, by: Sequence[str] = (), salts: int = 64) -> DataFrame:
    """The ``k`` rows of ``df``, or of each group of ``by``, whose seeded hash of
    ``ids`` is least; ties go by the ids, nulls first.  A group with fewer rows
    is kept whole; null keys are one group.

    Without ``by`` each partition keeps its ``k`` best rows before they meet, so
    there is no sort of the table.  With it, each group is first cut to ``k`` in
    each of ``salts`` parts, so a group that holds a third of all rows is
    ``salts`` tasks and at most ``salts * k`` rows meet in one."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ids]
    marked = df.withColumn("_mark", F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary")))
    order = [F.col("_mark"), *[F.col(c).asc_nulls_first() for c in ids]]
    if not by:
        return marked.orderBy(*order).limit(k).drop("_mark")
    marked = marked.withColumn("_salt", F.pmod(F.xxhash64("_mark"), F.lit(salts)))
    for group in ([*by, "_salt"], list(by)):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        marked = marked.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return marked.drop("_mark", "_salt", "_rank")
