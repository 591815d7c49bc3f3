"""Benchmark decontamination by winnowing (DataFrame functions only).

From every text the smallest hash of each run of ``W`` consecutive ``K``-word
grams is kept.  A shared passage of ``K + W - 1 = 13`` words holds one such run,
so both sides keep the same gram of it: no shared passage of 13 words is
missed.  Document and benchmark fingerprints are joined on the hash; a joined
pair fixes an alignment (document position minus item position), along which
the words themselves are compared, so a chance hash match adds nothing.

Only fingerprints (about two in seven words, three small columns) pass the
first join, and none of them is shuffled while the benchmark's own stay under
a counted bound.  Texts are shuffled once, to meet their alignments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, small, upto, with_own_columns

SPAN = 13  # words of a benchmark window
K = 8      # words of a gram
W = SPAN - K + 1  # grams of a winnowing run
#: What separates words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: At most so many benchmark fingerprints are broadcast (about 30 bytes each).
BROADCAST_ROWS = 1_000_000
OUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
#: Names that ``contamination`` gives to columns.
MADE = (*OUT, "_h", "_hh", "_id", "_f", "_ids", "al", "n", "occ")


def tokens(text: Column) -> Column:
    """Words of the lower-cased (A-Z) text; a null text has none.

    Each byte of the text is taken as one ISO-8859-1 character, which is several
    times as fast to lower-case as translating 26 letters.  Besides A-Z this
    changes only first bytes of two-byte characters (C3 to E3 and so on); they
    stay apart from the three-byte ones, which have another length.  So two words
    are equal here exactly if they are equal with A-Z lower-cased; the words are
    only compared and counted, never shown.
    """
    low = F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))
    first = lambda a: F.when(F.get(a, F.lit(0)) == "", 2).otherwise(1)  # noqa: E731  a break at either end leaves an empty string
    last = lambda a: F.size(a) - F.when(F.element_at(a, -1) == "", 1).otherwise(0)
    return F.when(F.length(text) > 0, let(F.split(low, BREAK), lambda a: F.slice(
        a, first(a), F.greatest(last(a) - first(a) + 1, F.lit(0))))).otherwise(F.array().cast("array<string>"))


def _beside(a: Column, b: Column, d: int, f) -> Column:
    """``f(a[i], b[i + d])`` for every i that has both; a is at least as long as b."""
    n = F.size(b) - d
    return F.when(n >= 1, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + d), n), f)).otherwise(
        F.array().cast("array<bigint>"))


def grams(ws: Column, k: int) -> Column:
    """The hash of every ``k`` consecutive words, in order."""
    return F.transform(upto(F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i, k), F.lit(k)))


def grams8(ws: Column) -> Column:
    """As ``grams`` for eight words, by doubling: of words, pairs, fours and eights."""
    def doubled(h, d):
        return _beside(h, h, d, lambda a, b: F.xxhash64(a, b))

    return let(let(let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1)),
                   lambda h: doubled(h, 2)), lambda h: doubled(h, 4))


def winnowed(gs: Column) -> Column:
    """``array<struct<pos,h>>``: the leftmost smallest gram of every run of
    ``W`` = 6 grams, each once.

    The smallest of six is the smaller of two threes.  The gram kept changes
    where the smallest changes or where the run has just left it behind."""
    def kept(least):
        def new(s):
            was = F.get(least, s - 2)
            return (s == 1) | (F.get(least, s - 1) != was) | (F.get(gs, s - 2) == was)

        def place(s):
            h = F.get(least, s - 1)
            return F.struct((s - 1 + F.array_position(F.slice(gs, s, W), h)).cast("int").alias("pos"), h.alias("h"))

        return F.transform(F.filter(upto(F.size(least)), new), place)

    def smaller(a, b):
        return F.least(a, b)

    def of_three(g):
        return _beside(_beside(g, g, 1, smaller), g, 2, smaller)

    return let(let(of_three(gs), lambda t: _beside(t, t, 3, smaller)), kept)


def every(gs: Column) -> Column:
    return F.transform(gs, lambda h, i: F.struct((i + 1).cast("int").alias("pos"), h.alias("h")))


def contamination(docs: DataFrame, bench: DataFrame, share_inverse: int = 20) -> DataFrame:
    """One row per document: its columns (``text`` included) and ``n_words,
    n_hit, n_items, items_sha256, contaminated``.

    A benchmark window is 13 consecutive words of an item, or the whole item if
    it has fewer; a document word inside any occurrence of a window is hit;
    contaminated means a hit and ``share_inverse * n_hit >= n_words``.

    * null and empty texts have no words, match nothing and are clean;
    * repeated document rows get the same result each; repeated items count
      once; a null ``item_id`` marks words but is not listed or counted;
    * items shorter than 13 words (at most 12 different lengths) are matched by
      grams of their own length at every position, since runs need 13 words;
    * an empty documents table gives an empty result, an empty benchmark clean
      documents; an input column named like an output column is replaced.
    """
    cols = [c for c in docs.columns if c not in OUT]
    items = bench.select("item_id", tokens(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    short = sorted(r[0] for r in items.select(F.size("iw").alias("n")).where(F.col("n") < SPAN).distinct().collect())

    def prints(ws: Column, item: bool) -> Column:
        parts = [let(grams8(ws), winnowed)]
        for n in short:
            one = every(grams(ws, n))
            parts.append(F.when(F.size(ws) == n, one).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>")) if item else one)
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    item_prints = items.withColumn("fp", F.explode(prints(F.col("iw"), True))).select(
        "item_id", "iw", F.col("fp.pos").alias("q"), F.col("fp.h").alias("h"))
    keyed = docs.select(*cols).withColumn("_h", F.xxhash64("text"))
    doc_prints = keyed.select(
        "doc_id", "_h", F.explode(let(tokens(F.col("text")), lambda ws: prints(ws, False))).alias("fp")).select(
        "doc_id", "_h", F.col("fp.pos").alias("p"), F.col("fp.h").alias("h"))
    aligned = doc_prints.join(small(item_prints, BROADCAST_ROWS), "h").groupBy(
        F.col("doc_id").alias("_id"), F.col("_h").alias("_hh")).agg(
        F.collect_set(F.struct("item_id", "iw", (F.col("p") - F.col("q")).alias("shift"))).alias("al"))
    met = keyed.join(aligned, keyed["doc_id"].eqNullSafe(aligned["_id"]) & (keyed["_h"] == aligned["_hh"]), "left")

    def occurrences(ws, a):
        n = F.least(F.size(a["iw"]), F.lit(SPAN))
        begin = F.filter(upto(F.size(a["iw"]) - n + 1), lambda j: (j + a["shift"] >= 1)
                         & (j + a["shift"] + n - 1 <= F.size(ws))
                         & (F.slice(ws, F.greatest(j + a["shift"], F.lit(1)), n) == F.slice(a["iw"], j, n)))
        return F.struct(a["item_id"].alias("item_id"), F.flatten(F.transform(
            begin, lambda j: F.sequence(j + a["shift"], j + a["shift"] + n - 1))).alias("at"))

    none = F.array().cast(aligned.schema["al"].dataType)
    found = let(tokens(F.col("text")), lambda ws: F.struct(F.size(ws).alias("n"), F.filter(
        F.transform(F.coalesce("al", none), lambda a: occurrences(ws, a)), lambda o: F.size(o["at"]) > 0).alias("occ")))
    met = met.select(*cols, found.alias("_f")).select(*cols, "_f.n", "_f.occ")
    ids = F.array_sort(F.array_distinct(F.transform(
        F.filter("occ", lambda o: o["item_id"].isNotNull()), lambda o: o["item_id"].cast("string"))))
    met = met.select(*cols, F.col("n").cast("long").alias("n_words"), ids.alias("_ids"),
                     F.size(F.array_distinct(F.flatten(F.transform("occ", lambda o: o["at"])))).cast("long").alias("n_hit"))
    return met.select(*cols, "n_words", "n_hit", F.size("_ids").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "_ids"), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * share_inverse >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns, also
    those named like a column that ``contamination`` makes."""
    return with_own_columns(docs, MADE, lambda d: contamination(d, bench).where(~F.col("contaminated")))
