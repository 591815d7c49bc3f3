"""Quotation linking in conversations (DataFrame functions only).

Lines that begin with ``>`` marks are quotes; the number of marks is their
level.  Consecutive lines of one level form a passage.  Passages and their
lines are normalised and hashed, and so are the bodies, paragraphs and lines of
all messages (without their quotes); a join on the hash finds what was quoted.
The latest earlier message of the same conversation comes first, else the first
message of any conversation; a message answers the one that it quotes most at
level 1, or, without such a quote, the message of the turn before.

Within a conversation the latest earlier original is carried along the turns,
so an answer that a text repeats many times costs a sort, not pairs.  Across
conversations the first original of a hash takes part, and the first of any
other conversation for quotes in the conversation of the first.

The answers within a conversation form trees; ``place`` is the position of a
message in them, depth first.  Turns that each answer the one before are one
branch (in that order they stand together, before what hangs on them), so trees
are built of branches.  Sizes go up and positions come down by pointer doubling:
twice as far with each join, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let, staged

MARKS = r"^(?:[ \t]*>)+[ \t]?"
ATTRIBUTION = r"^(?:On .* wrote|.* schrieb|Le .* a écrit ?):$"  # the line that introduces a quote


def parsed_lines(text: Column) -> Column:
    """``array<struct<level,line>>`` of a message, marks taken off."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: let(F.regexp_extract(x, MARKS, 0), lambda m: F.struct(
        F.length(F.regexp_replace(m, "[^>]", "")).alias("level"), F.substr(x, F.length(m) + 1).alias("line"))))


def normal(text: Column) -> Column:
    """Lower case, words separated by one space, everything else dropped."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _body(ls: Column) -> Column:
    """The lines of level 0, without attribution lines before a quote."""
    return F.transform(F.filter(ls, lambda x, i: (x["level"] == 0) & ~(F.coalesce(F.get(ls, i + 1)["level"], F.lit(0)).cast("boolean") & F.btrim(x["line"]).rlike(ATTRIBUTION))),
                       lambda x: x["line"])


def _units(body: Column) -> Column:
    """The normalised body, paragraphs and lines, each once."""
    joined = F.array_join(body, "\n")
    parts = F.concat(F.array(joined), F.split(joined, r"\n[ \t]*\n"), body)
    return F.filter(F.array_distinct(F.transform(parts, lambda x: normal(x))), lambda x: x != "")


def _passages(ls: Column) -> Column:
    """``array<struct<level,text,n>>``: runs of lines of one level, and each of
    their lines when a run has several."""
    starts = F.filter(F.transform(ls, lambda x, i: F.when((x["level"] > 0) & ~F.coalesce(F.get(ls, i - 1)["level"], F.lit(0)).eqNullSafe(x["level"]), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(ls, lambda x, i: F.when((x["level"] > 0) & ~F.coalesce(F.get(ls, i + 1)["level"], F.lit(0)).eqNullSafe(x["level"]), i)), lambda i: i.isNotNull())
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(F.get(ls, a)["level"].alias("level"), normal(F.array_join(F.transform(
        F.slice(ls, a + 1, b - a + 1), lambda x: x["line"]), "\n")).alias("text"), (b - a + 1).alias("n")))
    single = F.transform(F.filter(ls, lambda x: x["level"] > 0), lambda x: F.struct(x["level"].alias("level"), normal(x["line"]).alias("text"), F.lit(1).alias("n")))
    return F.filter(F.concat(F.filter(runs, lambda r: r["n"] > 1), single), lambda r: r["text"] != "")


def _running(rows: DataFrame, group: list[str], order: list[Column], value: str) -> DataFrame:
    """``rows`` and ``before``, the sum of ``value`` over the rows of the group
    that come earlier: within ranges of the order, and carried from range to
    range, so that no group meets in one task."""
    dealt = staged(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    carry = sums.select(*group, "_part", F.sum("_sum").over(earlier(Window.partitionBy(*group).orderBy("_part"))).alias("_carry"))
    within = dealt.withColumn("_in", F.sum(value).over(earlier(Window.partitionBy("_part", *group).orderBy(*order))))
    return within.join(carry, [*group, "_part"]).withColumn("before", F.coalesce("_in", F.lit(0)) + F.coalesce("_carry", F.lit(0))).drop("_in", "_carry", "_part")


def _branch_places(places: DataFrame) -> DataFrame:
    """``conv_id, thread, at, root_turn`` of each branch, ``at`` being the
    position of its first message, from ``conv_id, turn, thread, answers``
    (the turn of the same conversation that the message answers)."""
    opening = F.col("turn") == F.col("thread")
    branches = places.groupBy("conv_id", "thread").agg(F.count(F.lit(1)).alias("len"), F.max(F.when(opening, F.col("answers"))).alias("answers"))
    branches = branches.join(places.select("conv_id", F.col("turn").alias("answers"), F.col("thread").alias("up")), ["conv_id", "answers"], "left")
    branches = staged(branches, "branches")
    is_open = lambda s: s.where("anc IS NOT NULL").limit(1).count() > 0
    sizes = branches.select("conv_id", "thread", F.col("up").alias("anc"), F.col("len").alias("size"))
    while is_open(sizes):
        more = sizes.where("anc IS NOT NULL").groupBy("conv_id", F.col("anc").alias("thread")).agg(F.sum("size").alias("more"))
        further = sizes.select("conv_id", F.col("thread").alias("anc"), F.col("anc").alias("next"))
        sizes = staged(sizes.join(more, ["conv_id", "thread"], "left").join(further, ["conv_id", "anc"], "left").select(
            "conv_id", "thread", F.col("next").alias("anc"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
    sized = branches.join(sizes.drop("anc"), ["conv_id", "thread"]).withColumn("beside", F.coalesce(F.col("up").cast("string"), F.lit("")))
    # what hangs on a later message of a branch comes first, then the earlier turn
    sized = _running(sized, ["conv_id", "beside"], [F.col("answers").desc(), F.col("thread").asc()], "size")
    above = branches.select("conv_id", F.col("thread").alias("up"), F.col("len").alias("above"))
    at = sized.join(above, ["conv_id", "up"], "left").select("conv_id", "thread", F.col("up").alias("anc"), (F.col("before") + F.coalesce("above", F.lit(0))).alias("at"),
                                                             F.coalesce("up", "thread").alias("root_turn"))
    at = staged(at, "places")
    while is_open(at):
        further = at.select("conv_id", F.col("thread").alias("anc"), F.col("anc").alias("next"), F.col("at").alias("more"), F.col("root_turn").alias("top"))
        at = staged(at.join(further, ["conv_id", "anc"], "left").select("conv_id", "thread", F.col("next").alias("anc"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"),
                                                                        F.coalesce("top", "root_turn").alias("root_turn")), "places")
    return at.drop("anc")


def reply_links(messages: DataFrame) -> DataFrame:
    """One row per message: its columns but ``text``, and ``body`` (without
    quotes), ``n_quoted`` (quoted lines), ``depth`` (deepest level), ``n_linked``
    (passages found), ``reply_conv, reply_turn``, ``thread`` (the turn that opens
    its branch: the latest message up to it that answers another turn than the
    one before), ``root_turn`` (where following the answers within the
    conversation ends) and ``place``: ordered by ``conv_id, place``, a message
    comes after the one that it answers, followed by all that answer it, earlier
    turns first.  A message that answers another conversation begins a tree of
    its own.

    * a null text is empty; a message that only quotes has an empty body;
    * a passage that no other message has links nothing;
    * several rows under one conversation and turn are one place: a quote finds
      any of their texts, and each row is returned, with one ``place``;
    * messages without conversation or turn are returned without links and place, and
      nothing links to them;
    * an empty table gives an empty result; an input column named like an output
      column is replaced.
    """
    out = ("body", "n_quoted", "depth", "n_linked", "reply_conv", "reply_turn", "thread", "root_turn", "place")
    cols = [c for c in messages.columns if c not in out]
    read = messages.select(*cols, let(parsed_lines(F.col("text")), lambda ls: F.struct(
        F.array_join(_body(ls), "\n").alias("body"), let(_body(ls), _units).alias("units"), _passages(ls).alias("passages"),
        F.size(F.filter(ls, lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform(ls, lambda x: x["level"])), F.lit(0)).cast("long").alias("depth"))).alias("_p"))
    read = staged(read.select(*[c for c in cols if c != "text"], "_p.*"), "messages")
    placed = read.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    key = lambda c: F.md5(c)
    # only texts that someone quotes matter
    quotes = staged(placed.where("n_quoted > 0").select("conv_id", "turn", F.explode("passages").alias("q")).select(
        "conv_id", "turn", key(F.col("q.text")).alias("h"), F.col("q.level").alias("level"), F.col("q.n").alias("n")), "quotes")
    asked = quotes.select("h").distinct()
    units = placed.select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", key(F.col("u")).alias("h")).join(asked, "h", "left_semi")
    units = staged(units.distinct(), "units")
    both = quotes.select("conv_id", "turn", "h", "level", "n", F.lit(None).cast("bigint").alias("orig")).union(
        units.select("conv_id", "turn", "h", F.lit(None).cast("int"), F.lit(None).cast("int"), F.col("turn").cast("bigint")))
    earlier = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("orig", F.max("orig").over(earlier)).where("level IS NOT NULL")
    ranked = units.groupBy("h", "conv_id").agg(F.min("turn").alias("turn")).withColumn("_k", F.row_number().over(Window.partitionBy("h").orderBy("conv_id"))).where("_k <= 2")
    first = ranked.groupBy("h").agg(*[F.max(F.when(F.col("_k") == k, F.struct("conv_id", "turn"))).alias(f"f{k}") for k in (1, 2)])
    met = near.join(first, "h", "left").withColumn("f", F.when(F.col("f1.conv_id") == F.col("conv_id"), F.col("f2")).otherwise(F.col("f1")))
    here = F.col("orig").isNotNull()
    other = ~here & F.col("f").isNotNull()
    met = met.select("conv_id", "turn", "level", "n", F.when(here, F.col("conv_id")).when(other, F.col("f.conv_id")).alias("c"),
                     F.when(here, F.col("orig")).when(other, F.col("f.turn")).alias("t")).where("c IS NOT NULL")
    linked = met.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"))
    votes = met.where("level = 1").groupBy("conv_id", "turn", "c", "t").agg(F.sum("n").alias("v"))
    choice = votes.groupBy("conv_id", "turn").agg(F.max_by(F.struct("c", "t"), F.struct("v", F.col("c") == F.col("conv_id"), "t", "c")).alias("r"))
    there = placed.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("_prev")).distinct()
    rows = read.join(linked, ["conv_id", "turn"], "left").join(choice, ["conv_id", "turn"], "left").join(there, ["conv_id", "turn"], "left")
    rows = rows.withColumns({"reply_conv": F.when(F.col("r").isNotNull(), F.col("r.c")).when(F.col("_prev").isNotNull(), F.col("conv_id")),
                             "reply_turn": F.coalesce("r.t", "_prev")})
    rows = staged(rows.drop("units", "passages", "r", "_prev"), "replies")
    opens = (F.col("conv_id") != F.col("reply_conv")) | (F.col("reply_turn") != F.col("turn") - 1) | F.col("reply_turn").isNull()
    block = F.floor(F.col("turn") / 1024)
    # the latest opening turn: within blocks of turns, and carried from block to block
    tops = rows.where(opens).groupBy("conv_id", block.alias("_b")).agg(F.max("turn").alias("_top"))
    blocks = rows.select("conv_id", block.alias("_b")).distinct().join(tops, ["conv_id", "_b"], "left")
    carry = blocks.select("conv_id", "_b", F.max("_top").over(Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    within = Window.partitionBy("conv_id", "_b").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_b", block).withColumn("_in", F.max(F.when(opens, F.col("turn"))).over(within)).join(carry, ["conv_id", "_b"], "left")
    rows = rows.withColumn("thread", F.coalesce("_in", "_carry")).drop("_in", "_carry")
    places = staged(rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "_b", "turn", "thread", F.when(
        F.col("reply_conv") == F.col("conv_id"), F.col("reply_turn")).alias("answers")).distinct(), "turns")
    # a row for each block of a branch, so that a long branch is not one key
    at = places.select("conv_id", "_b", "thread").distinct().join(_branch_places(places), ["conv_id", "thread"])
    rows = rows.join(at, ["conv_id", "_b", "thread"], "left")
    return rows.select(*[c for c in cols if c != "text"], "body", "n_quoted", "depth", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
                       "reply_conv", "reply_turn", "thread", "root_turn", (F.col("at") + F.col("turn") - F.col("thread")).alias("place"))
