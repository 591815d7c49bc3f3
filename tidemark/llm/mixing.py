"""Mixing sources to target weights by systematic sampling.

Each source gets a target (its weight's share of the mix, at most ``cap`` times
its own size; what is above is shared again by weight).  The documents of a
source then share one rate, ``target / size``; ordered by size, each stands for
an interval of that length on a line that starts at one random offset, and a
document is emitted once per whole number that its interval crosses.

Since the order is by size, the words that a source gives differ from its
target by about one document's size at most, whatever the spread of sizes.

The prefix sums are two-level, so that no source meets in one task: documents
are counted per block (source, size class, and in large tables ranges of size and
doc_id), blocks are summed in a table that is far smaller than the documents, and
ranks are taken within blocks.  Blocks follow the order (class, size, doc_id), so
a rank is the row number in it at every size of input, wherever ranges are cut.
The counts are whole numbers, hence reruns agree to the last document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small, with_own_columns

OUT = ("size", "source_size", "target", "copies", "taken")
#: Names that ``mix_sources`` and ``repeated`` give to columns.
MADE = (*OUT, "_size", "_src", "_source", "_class", "_sub", "_cuts", "_n", "_s", "_before", "_offset", "_rate", "_rank", "_copy", "_h", "_w", "_cap", "_level", "_full_at")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``(_src, source_size, target)`` from one row per source ``(_src,
    _source, source_size)``.

    Sources in code point order, null last, take ``weights`` in turn.  The
    target is ``min(cap * size, level * weight)``; the level is the one at
    which all targets add up to ``share`` times all sizes (if even the caps do
    not, every source gets its cap).  One row per source: the windows here run
    over the table of sources, not over documents.
    """
    order = Window.orderBy(F.col("_source").isNull(), "_source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    t = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    t = t.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn("_full_at", F.col("_cap") / F.col("_w"))
    everyone = Window.partitionBy(F.lit(0))
    before = everyone.orderBy("_full_at", F.col("_source").isNull(), "_source").rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    gone = F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everyone) * F.lit(float(share)) - full) / (F.sum("_w").over(everyone) - gone)
    t = t.withColumn("_level", level)
    t = t.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_full_at"), F.col("_level"))).over(everyone))
    target = F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap"))
    return t.select("_src", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, size: Column, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
                cap: float = 2.0, seed: str = "mix", block_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken`` (``taken =
    copies * size``); ``copies`` is how often the mix takes the row, at most
    ``ceil(cap)``.  ``docs`` is read twice: stage it first if it is costly.

    * a null source is a source of its own, ordered last; a null size counts 0;
    * size 0 (null or empty text) takes part and adds no words; a source
      without words has target 0 and is not taken;
    * a null ``doc_id`` is ordered first among equal sizes; repeated rows are
      separate rows, and equal ones are taken in either order;
    * an empty table gives an empty table;
    * an input column named like an output column is replaced.
    """
    cols = [c for c in docs.columns if c not in OUT]
    sized = docs.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long")).select(
        *cols, "_size",
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("_src"))
    n_sub = max(1, -(-sized.select("_src").count() // block_rows))
    bits = F.expr("int(length(bin(_size)))")
    sized = sized.withColumn("_class", F.when(bits <= 4, F.col("_size")).otherwise(
        bits * 8 + F.expr("shiftright(_size, int(length(bin(_size))) - 4)")))
    place = F.struct("_size", "doc_id", F.xxhash64(*cols).alias("_h"))
    if n_sub > 1:  # ranges of about block_rows rows, cut at a sample of places
        cuts = sized.where(F.pmod(F.xxhash64("doc_id", F.xxhash64(*cols)), F.lit(block_rows)) == 0)
        cuts = cuts.groupBy("_src", "_class").agg(F.collect_set(place).alias("_cuts"))
        sized = sized.join(small(cuts, 1_000_000), ["_src", "_class"], "left")
        sized = sized.withColumn("_sub", F.coalesce(F.size(F.filter("_cuts", lambda x: x < place)), F.lit(0)).cast("long")).drop("_cuts")
    else:
        sized = sized.withColumn("_sub", F.lit(0).cast("long"))
    key = ["_src", "_class", "_sub"]
    blocks = sized.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"), F.first("source").alias("_source"))
    sources = blocks.groupBy("_src").agg(F.sum("_s").alias("source_size"), F.first("_source").alias("_source"))
    targets = source_targets(sources, weights, share, cap)
    earlier = Window.partitionBy("_src").orderBy("_class", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(*key, "_before")
    # 12 bits of offset: offset + 2 * rank is then exact, and a rate of 2 gives two copies each
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_src"))), 1, 3), 16, 10).cast("double") / F.lit(4096.0)
    blocks = blocks.join(targets, "_src").withColumn("_offset", offset).withColumn(
        "_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    within = Window.partitionBy(*key).orderBy("_size", "doc_id", F.xxhash64(*cols))
    ranked = sized.withColumn("_rank", F.row_number().over(within)).join(blocks, key)
    end = (F.col("_before") + F.col("_rank")).cast("double")
    crossed = F.floor(F.col("_offset") + F.col("_rate") * end) - F.floor(F.col("_offset") + F.col("_rate") * (end - 1))
    copies = F.least(crossed, F.ceil(F.col("_rate")))  # rounding never adds a copy above the rate
    return ranked.select(*cols, F.col("_size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"),
                         (copies * F.col("_size")).cast("long").alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of ``mix_sources`` as often as it is taken,
    with the input's columns."""
    cols = [c for c in mixed.columns if c not in OUT]
    return mixed.where(F.col("copies") > 0).select(
        *cols, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(*cols)


def mixed_documents(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself with all columns of ``docs``, also those named like a
    column that ``mix_sources`` makes; ``size`` must not read one of these."""
    return with_own_columns(docs, MADE, lambda d: repeated(mix_sources(d, size, **options)))
