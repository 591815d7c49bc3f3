"""Line removal across documents by a deletion-neighbourhood join (DataFrame
functions only).

Two lines are alike if they have equal words, or if both have at least
``least_words`` words and one inserted, deleted or replaced word makes them
equal.  A line goes if a line alike stands earlier (smaller doc_id, then line).

Equal lines are found by hash.  For the rest:

1.  One changed word leaves the first or the second half of a line as it was.
    Only lines that share a half with a different line go on; the halves are
    hashes of a few bytes, and this sift loses no pair.
2.  Of these, every variant with one word deleted is emitted as a hashed key
    (place, words before, words after); the whole line is emitted as what a line
    with one word more at any place would become.  Lines alike share a key.
3.  A key's earliest line is a partial minimum, so a key that many lines share
    costs a row each and never pairs all of them.
4.  The pair of a line and its earliest partner is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, let, staged, upto

NULL_LAST = 2 ** 63 - 1  # the place of a null id in the order


def _lines(docs: DataFrame, least_words: int) -> DataFrame:
    """A narrow row for each line with a word: its document, number, words,
    hash, and the hashes of its halves.  For n words they are the first
    ``n // 2`` and the last ``n - n // 2``, and those that a line with one word
    more or less has at its middle."""
    out = docs.select(F.coalesce("doc_id", F.lit(NULL_LAST)).alias("doc"), F.xxhash64("text").alias("version"),
                      F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    odd_space = F.contains(F.col("line"), F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd_space = odd_space | F.contains(F.col("line"), F.lit(c))
    out = out.withColumn("line", F.btrim("line", F.lit(WHITE))).where("line <> ''")
    out = out.withColumn("line", F.when(odd_space, F.regexp_replace("line", r"[\x20\x09-\x0D]+", " ")).otherwise(F.col("line")))
    out = out.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1)
    j = F.floor(F.col("n") / 2).cast("int")
    half = lambda count: F.xxhash64(F.call_function("substring_index", "line", F.lit(" "), count), count)
    odd = F.col("n") % 2 == 1
    halves = F.array(half(j), half(-j), half(F.when(odd, -(j + 1)).otherwise(j - 1)))
    return out.select("doc", "version", "line_no", "n", F.xxhash64("line").alias("k"), F.xxhash64("line", F.lit(1)).alias("k2"),
                      F.when(F.col("n") >= least_words, halves).alias("halves"))


def _chain(ws: Column) -> Column:
    """The hash of the first 0, 1, ..., n words."""
    return F.aggregate(ws, F.array(F.lit(0).cast("bigint")), lambda a, w: F.concat(a, F.array(F.xxhash64(F.element_at(a, -1), w))))


def _variants(ws: Column) -> Column:
    """Keys of the line with each word deleted, and of the line itself as what
    is left when a word at each place is deleted."""
    def keys(c):
        n = F.size(c["before"]) - 1
        after = lambda i: F.get(c["after"], n - i)  # noqa: E731  the hash of the words from the i-th on, counted from 0
        gone = F.transform(upto(n), lambda i: F.xxhash64(F.get(c["before"], i - 1), after(i), i, n - 1))
        whole = F.transform(upto(n + 1), lambda i: F.xxhash64(F.get(c["before"], i - 1), after(i - 1), i, n))
        return F.concat(gone, whole)

    return let(F.struct(_chain(ws).alias("before"), _chain(F.reverse(ws)).alias("after")), keys)


def _one_edit(a: Column, b: Column) -> Column:
    """Whether at most one word inserted, deleted or replaced makes a of b."""
    def alike(x, y):
        same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
        return let(F.array_position(same, False), lambda at: F.when(at > 0, at - 1).otherwise(F.size(same)))

    return (F.abs(F.size(a) - F.size(b)) <= 1) & (alike(a, b) + alike(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1)


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``k, near``: the earliest place of a different line alike."""
    half = lines.where("halves IS NOT NULL").select("k", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("half")
    alive = half.join(shared, "half").select("k").distinct()
    first = staged(lines.join(alive, "k").groupBy("k").agg(F.min(F.struct("doc", "line_no", "version")).alias("at")), "alive")
    texts = docs.select(F.coalesce("doc_id", F.lit(NULL_LAST)).alias("doc"), F.xxhash64("text").alias("version"), "text")
    held = first.groupBy(F.col("at.doc").alias("doc"), F.col("at.version").alias("version")).agg(
        F.collect_list(F.struct("at.line_no", "k")).alias("want"))
    held = texts.join(held, ["doc", "version"]).select("doc", F.explode(let(F.split("text", "\n"), lambda ls: F.transform("want", lambda w: F.struct(
        w["line_no"].alias("line_no"), w["k"].alias("k"), F.get(ls, w["line_no"]).alias("line"))))).alias("l"))
    ws = F.transform(F.split(F.btrim("line", F.lit(WHITE)), r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    held = held.select("doc", "l.*").groupBy("doc", "line_no", "k").agg(F.first("line").alias("line"))  # repeated rows hold it more than once
    held = staged(held.select(F.struct("doc", "line_no").alias("at"), "k", ws.alias("ws")), "alive-words")
    keyed = staged(held.select("at", "k", F.explode(_variants(F.col("ws"))).alias("key")), "variants")
    least = keyed.groupBy("key").agg(F.min(F.struct("at", "k")).alias("m"), F.max("k").alias("b"), F.min("k").alias("a")).where("a <> b").select("key", "m")
    met = keyed.join(least, "key").where("m.at < at").groupBy("k").agg(F.min("m").alias("m"))
    x = held.select("k", F.col("ws").alias("wx"))
    y = held.select(F.col("k").alias("ky"), F.col("ws").alias("wy"))
    pairs = met.select("k", F.col("m.k").alias("ky"), F.col("m.at").alias("near")).join(x, "k").join(y, "ky")
    return pairs.where(_one_edit(F.col("wx"), F.col("wy"))).select("k", "near")


def line_dedup(docs: DataFrame, least_words: int = 8) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, version,
    n_lines`` (with a word), ``n_equal``, ``n_near`` and ``removed`` (numbers of
    the lines to remove, from 0, joined by commas; equal ones count as equal).

    * lines without a word, null and empty texts are left alone;
    * lines are judged on the input, not on what is left;
    * a null doc_id comes after every other;
    * rows that repeat one id and text have their lines at the same places, none
      of which is earlier; each row gets the same result;
    * an empty table gives an empty result; other columns are not read.
    """
    lines = staged(_lines(docs, least_words), "lines")
    near = staged(near_lines(docs, lines), "near")
    first = lines.groupBy("k", "k2").agg(F.min(F.struct("doc", "line_no")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    at = F.struct("doc", "line_no")
    judged = lines.select("doc", "version", "line_no", "k", "k2").join(first, ["k", "k2"], "left").join(near, "k", "left")
    equal, alike = F.coalesce(F.col("first") < at, F.lit(False)), F.coalesce(F.col("near") < at, F.lit(False))
    counts = judged.groupBy(F.col("doc").alias("_d"), F.col("version").alias("_v")).agg(
        *[F.collect_set(F.when(c, F.col("line_no"))).alias(name) for name, c in (("_all", F.lit(True)), ("_equal", equal), ("_near", alike & ~equal))])
    counts = counts.select("_d", "_v", *[F.size(f"_{x}").alias(f"n_{y}") for x, y in (("all", "lines"), ("equal", "equal"), ("near", "near"))],
                           F.array_join(F.transform(F.array_sort(F.concat("_equal", "_near")), lambda x: x.cast("string")), ",").alias("removed"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), F.coalesce("doc_id", F.lit(NULL_LAST)).alias("_d0"))
    met = rows.join(counts, (F.col("_d0") == F.col("_d")) & (F.col("version") == F.col("_v")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return met.select("doc_id", "version", zero("n_lines"), zero("n_equal"), zero("n_near"), F.coalesce("removed", F.lit("")).alias("removed"))


def without_lines(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` with the lines that ``line_dedup`` removes taken out of ``text``."""
    gone = judged.where("removed <> ''").select(F.col("doc_id").alias("_id"), F.col("version").alias("_v"), "removed").distinct()
    met = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_v")), "left")
    kept = let(F.transform(F.split("removed", ","), lambda x: x.cast("int")), lambda g: F.array_join(
        F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(g, i)), "\n"))
    return met.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
