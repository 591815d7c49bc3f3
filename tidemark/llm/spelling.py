"""Spelling variants: words one edit apart, found by a relational trie frontier.

The edge table holds one row per trie node (a prefix that some word has) with
its edges: the next letter, a signature of the tails of all words behind it, and
the count of the word that ends there.  States ``(word, position, node, edits)``
are joined with it level by level, one trie depth a level.  Each state takes the
edge of its own next letter; without an edit so far it also takes the other
edges, as a replaced or an inserted letter, and the edge behind its next letter,
as a deleted one.  An edited state must still match the rest of its word, so it
is made only if the signature may hold that tail (a signature errs only by
letting a state through, which then finds no edge); one that ends its word at a
node that is a word is a pair.

One edit leaves the first half of a word whole or the second.  So there are two
tries in the table, of words (marked ``>``) and of reversed words (``<``), and
a state begins at the middle of its word: no edit is tried near the root, where
every word would meet every edge.  A node's row is bounded by the alphabet, and
states spread over nodes: only levels of at most ``most_broadcast`` nodes, by
their count, are broadcast; the others are joined by shuffle, where Spark splits
a skewed node.

There are as many levels as the longest word has letters.  Words above
``max_levels`` letters go another exact way, with those of ``max_levels``: the
polynomial hashes of a word and of its deletion variants, one pass each, are
joined and every pair is verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

LETTERS = "A-Za-zÀ-ÿ"  # fixed by the contract: the letters of a run


def word_counts(docs: DataFrame, least_chars: int = 7, least_n: int = 2, one_in: int = 31, most_kept: int = 100_000) -> DataFrame:
    """``word, n`` of the words of all texts (``doc_id, text``).

    A run of letters, lower-cased, loses the letter ``h % length`` where
    ``one_in`` divides ``h``, the CRC-32 of ``<doc_id>:<run>`` (nothing before
    the colon for a null id).  Results of ``least_chars`` letters that occur
    ``least_n`` times or more are words; shorter runs never become one, so they
    are not taken out of the text.  Null and empty texts have no words; each
    repeated row counts.  Each task adds up its words before the shuffle and
    passes them on whenever it holds ``most_kept`` different ones."""
    run = re.compile("[%s]{%d,}" % (LETTERS, least_chars))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: defaultdict[str, int] = defaultdict(int)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                if not text.is_valid:
                    continue
                low = text.as_buffer().to_pybytes().lower().decode()  # bytes: only A-Z
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                found = run.findall(low) if len(low) < 1 << 20 else (m.group() for m in run.finditer(low))
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_chars:
                            continue
                    kept[word] += n
                if len(kept) >= most_kept:
                    yield batch()
                    kept.clear()
        if kept:
            yield batch()

    counts = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_n)


def _oriented(words: DataFrame) -> DataFrame:
    """``w, n, len, begin``: each word in both directions, and how many letters
    its states take as they are."""
    size = F.length("word")
    half, last = F.floor(size / 2), F.greatest(size - 2, F.lit(0))
    both = F.explode(F.array(F.struct(F.concat(F.lit(">"), "word").alias("w"), F.least(half, last).cast("int").alias("begin")),
                             F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("w"), F.least(size - half, last).cast("int").alias("begin"))))
    return words.select("n", size.alias("len"), both.alias("o")).select("o.w", "n", "len", "o.begin")


TAILS = 4  # words of 64 bits of a node's signature


def _tail(rest: str) -> str:
    """SQL of the bit of a signature for the letters behind a node."""
    return f"CAST(xxhash64({rest}) & {64 * TAILS - 1} AS INT)"


def trie_nodes(oriented: DataFrame, shallowest: int) -> DataFrame:
    """``depth, node, kids`` of every prefix of at least ``shallowest`` letters
    that goes on; ``kids`` maps the code point of each next letter to the
    signature ``t0``.. of the tails of all words below it, and the count ``n`` of
    the word that it ends."""
    spread = oriented.select("w", "n", "len", F.explode(F.sequence(F.lit(shallowest), F.col("len"))).alias("depth"))
    steps = spread.selectExpr("depth", "substr(w, 1, depth + 1) AS node", f"{_tail('substr(w, depth + 2)')} AS tail", "CASE WHEN depth = len THEN n END AS n")
    bits = [f"CASE WHEN tail >> 6 = {i} THEN shiftleft(1L, tail & 63) ELSE 0L END AS t{i}" for i in range(TAILS)]
    heads = steps.selectExpr("depth", "node", *bits, "n").groupBy("depth", "node").agg(*[F.bit_or(f"t{i}").alias(f"t{i}") for i in range(TAILS)], F.max("n").alias("n"))
    kid = f"struct({', '.join(f't{i}' for i in range(TAILS))}, n) AS kid"
    up = heads.where(F.col("depth") > shallowest).selectExpr("depth - 1 AS depth", "substr(node, 1, depth) AS node", "ascii(substr(node, depth + 1, 1)) AS c", kid)
    return up.groupBy("depth", "node").agg(F.map_from_entries(F.collect_list(F.struct("c", "kid"))).alias("kids"))


def _goes(p2: str, tail: str) -> str:
    """SQL of whether some word behind the edge ``kid`` may have the tail."""
    pick = " ".join(f"WHEN {i} THEN kid.t{i}" for i in range(TAILS))
    return f"((CASE {tail} >> 6 {pick} END & shiftleft(1L, {tail} & 63)) <> 0 AND ({p2} < len OR kid.n IS NOT NULL))"


def _unedited(states: DataFrame, edges: DataFrame) -> DataFrame:
    """What states without an edit become at the next level: all edges count.

    Within a run of one letter only one place counts: a letter is inserted at
    the end of the run and the last one is deleted, so a trie gives no pair twice."""
    own = states.selectExpr("w", "n", "len", "p", "node", *[f"ascii(substr(w, p + {i + 2}, 1)) AS c{i}" for i in range(2)], *[f"{_tail(f'substr(w, p + {i + 2})')} AS g{i}" for i in range(3)])
    met = own.join(edges, "node").select(*own.columns, F.explode("kids").alias("c", "kid"))
    met = met.selectExpr("*", "c = c0 AS same", f"c <> c0 AND p < len AND {_goes('p + 1', 'g1')} AS replaced", f"c <> c0 AND {_goes('p', 'g0')} AS inserted",
                         f"c <> c0 AND p + 1 < len AND c = c1 AND {_goes('p + 2', 'g2')} AS deleted").where("same OR replaced OR inserted OR deleted")
    moves = F.expr("explode(array(IF(same, 0, NULL), IF(replaced, 1, NULL), IF(inserted, 2, NULL), IF(deleted, 3, NULL))) AS move")
    made = met.select("w", "n", "len", "p", "node", "c", "kid", moves).where("move IS NOT NULL")
    made = made.selectExpr("w", "n", "len", "concat(node, char(c)) AS node", "p + CASE move WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS p", "IF(move = 0, 0, 1) AS edits", "kid.n AS m")
    # a node one letter short of its word is the word without its last letter
    return made.selectExpr("w", "n", "len", "p", "node", "edits", "IF(p = len - 1 + edits, m, NULL) AS m")


def _edited(states: DataFrame, edges: DataFrame) -> DataFrame:
    """What states with an edit become: they take their own letter's edge."""
    met = states.join(edges, "node").selectExpr("w", "n", "len", "p + 1 AS p", "node", "ascii(substr(w, p + 2, 1)) AS c", f"{_tail('substr(w, p + 3)')} AS g", "kids")
    met = met.selectExpr("w", "n", "len", "p", "concat(node, char(c)) AS node", "element_at(kids, c) AS kid", "g").where(_goes("p", "g"))
    return met.selectExpr("w", "n", "len", "p", "node", "1 AS edits", "IF(p = len, kid.n, NULL) AS m")


def _plain(w: str) -> Column:
    """A marked word as it is written."""
    bare = F.substr(w, F.lit(2))
    return F.when(F.startswith(F.col(w), F.lit(">")), bare).otherwise(F.reverse(bare))


def frontier_pairs(words: DataFrame, most_broadcast: int = 200_000) -> DataFrame:
    """``word, n, other, m``: all words one edit apart, both ways, with their
    counts; ``words`` (``word, n``) holds each word once."""
    oriented = staged(_oriented(words), "oriented")
    low, top = oriented.agg(F.min("begin"), F.max("len")).first()
    if low is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("m")).limit(0)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = staged(trie_nodes(oriented, low).repartitionByRange(parts, "depth", "node"), "trie")
    sizes = dict(nodes.groupBy("depth").count().collect())  # a number per level
    begun = oriented.selectExpr("w", "n", "len", "begin AS p", "substr(w, 1, begin + 1) AS node")
    fresh, gone, pairs = None, None, []
    for depth in range(low, top + 1):
        new = begun.where(f"p = {depth}")
        edges = nodes.where(f"depth = {depth}").select("node", "kids")
        if sizes.get(depth, 0) <= most_broadcast:
            edges = F.broadcast(edges)
        level = _unedited(new if fresh is None else fresh.union(new), edges)
        level = staged(level if gone is None else level.union(_edited(gone, edges)), "frontier")
        pairs.append(level.where("m IS NOT NULL").select("w", "n", "node", "m"))
        states = level.select("w", "n", "len", "p", "node")
        fresh, gone = (level.where(cond).select(*states.columns) for cond in ("edits = 0", "edits = 1 AND m IS NULL"))
    found = reduce(DataFrame.union, pairs)
    return found.select(_plain("w").alias("word"), "n", _plain("node").alias("other"), "m").distinct()


BASE, PRIME = 1_000_003, (1 << 61) - 1  # of the polynomial hash


def variant_hashes(word: str) -> tuple[int, set[int]]:
    """The hash of a word and those of it without one letter."""
    size, power, head = len(word), [1], [0]
    for c in word:
        power.append(power[-1] * BASE % PRIME)
        head.append((head[-1] * BASE + ord(c)) % PRIME)
    cut = {(head[i] * power[size - 1 - i] + head[size] - head[i + 1] * power[size - 1 - i]) % PRIME for i in range(size)}
    return head[size], cut


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own, cut = variant_hashes(word)
            sizes = [len(word)] + [len(word) - 1] * len(cut)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(sizes), pa.int64()), pa.array(sizes, pa.int32()), pa.array([own, *cut], pa.int64())], names=["id", "size", "h"])


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter turns ``a`` into ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[i + (len(a) == len(b)):] == long[i + 1:]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([one_edit(a, b) for a, b in zip(batch.column("word").to_pylist(), batch.column("other").to_pylist(), strict=True)], pa.bool_()))


def long_pairs(words: DataFrame) -> DataFrame:
    """The same pairs as ``frontier_pairs``, for long words: work and rows grow
    with their letters, not with levels."""
    named = staged(words.withColumn("id", F.monotonically_increasing_id()), "long-words")
    marks = staged(named.select("id", "word").mapInArrow(_hashed, "id long, size int, h long"), "long-hashes")
    x, y = marks.alias("x"), marks.alias("y")
    met = x.join(y, ["size", "h"]).where(F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    met = met.join(named.toDF("word", "n", "a"), "a").join(named.toDF("other", "m", "b"), "b").select("word", "n", "other", "m")
    good = met.mapInArrow(_verified, met.schema)
    return staged(good.union(good.select("other", "m", "word", "n")), "long-pairs")


def near_words(words: DataFrame, max_levels: int = 48, most_broadcast: int = 200_000) -> DataFrame:
    """``word, n, other, m``: every pair of words one edit apart, both ways."""
    words = staged(words.select("word", "n"), "words")
    size = F.length("word")
    pairs = frontier_pairs(words.where(size <= max_levels), most_broadcast)
    if words.where(size > max_levels).limit(1).count():
        other = long_pairs(words.where(size >= max_levels))
        pairs = pairs.union(other.where(F.greatest(F.length("word"), F.length("other")) > max_levels))
    return pairs


def spelling_groups(words: DataFrame, ratio: int = 10, **options: int) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words``
    (``word, n``; each word once).

    ``form`` is the near word that occurs most often (ties: the first in
    code-point order) if it occurs ``ratio`` times as often, else null;
    ``root`` is the last word that forms lead to, the word itself without one;
    ``n_near`` counts near words.  No words give no rows; other columns are not
    read.  Chains are short, since counts grow by ``ratio`` at each step."""
    words = staged(words.select("word", "n"), "words")
    pairs = near_words(words, **options)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    form = F.when(-F.col("best.m") >= F.col("n") * ratio, F.col("best.other"))
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
                                                     F.when(form.isNotNull(), -F.col("best.m")).alias("form_n"))
    judged = staged(judged, "forms")
    steps = judged.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:  # each turn doubles the length of the steps
        ahead = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        steps = staged(steps.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = steps.where("moved").limit(1).count()
        steps = steps.select("word", "to")
        if not moved:
            return judged.join(steps, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
