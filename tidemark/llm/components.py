"""Connected components by alternating stars, each round a few joins.

Every round replaces links by links to the smallest neighbour, first of the
larger end (large star), then of the smaller end (small star), until nothing
changes: every node then links to the smallest of its component.  A node that
a third of the links share is a partial minimum and a skewed join key, never a
list in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of a link; the label is the smallest
    node that it reaches.  Links from a node to itself and nulls are left out."""
    both = [F.col(a).alias("u"), F.col(b).alias("v")]
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(*both).alias("u"), F.least(*both).alias("v")).distinct()
    count = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = staged(now, "links")
    before = count(now)
    while True:
        out = now.union(now.select("v", "u"))
        low = out.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = out.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = staged(small.where("u != v").distinct(), "links")
        after = count(new)
        if before == after:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
        now, before = new, after
