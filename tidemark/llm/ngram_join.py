"""Jaccard self-join of word-shingle sets by grouped prefixes.

1.  Each text becomes its set of 5-word shingles (64-bit hashes).  Texts with
    equal sets are one class; all further work is on classes.
2.  Shingles go, packed, to buckets by hash, where each is counted over
    classes.  Only those of two or more classes return: no other can be shared.
3.  In the order (number of classes, hash), the first ``n - ceil(0.8 n) + 1``
    shingles of a set are its prefix; two sets that are 80 % alike share one of
    it.  Shingles of a single class come first in that order, so most texts have
    nothing left in their prefix and are done.
4.  Classes with identical prefixes and size are one group, and groups that
    share a prefix shingle are joined.  Their pairs are expanded to members,
    sifted by size, place in the prefix and a bitmap, and the sets of those left
    are intersected.

Only components of links are asked for, so pairs known to be connected need no
check.  First each group is paired with one other that it shares many prefix
shingles with (as many pairs as groups), again with others while that still
finds links between components.  The last round takes every remaining candidate
pair whose ends are in different components.  No link is lost: in the end, a
pair of candidates is verified or already connected.

``ngram_links`` is the join itself: it takes the candidate pairs of all groups,
connected or not, and returns every link between classes, their members, and
how many links each document has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches, staged, text_bytes
from tidemark.llm.components import components
from tidemark.llm.hashing import mixed, run_hashes, word_hashes

SHINGLE = 5
BITS = 2048  # of the bitmap by which candidates are sifted
CLASS = 16  # bytes of a class: the 128-bit hash of its set


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    parts = [t.lower().split() for t in texts]
    h = word_hashes([w for p in parts for w in p])
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(sizes) - sizes
    runs = run_hashes(h, SHINGLE)
    out = []
    for b, n in zip(begin.tolist(), sizes.tolist(), strict=True):
        if n >= SHINGLE:
            out.append(np.unique(runs[b: b + n - SHINGLE + 1]))
        else:
            one = np.full(min(n, 1), n, np.uint64)
            for w in h[b: b + n]:
                one = mixed(one, np.array([w]))
            out.append(one)
    return out


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(d)
            texts.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
            size += len(texts[-1])
            if size >= most or len(ids) == 1 << PLACE:
                yield ids, texts
                ids, texts, size = [], [], 0
    yield ids, texts


PLACE, CHUNK = 16, 26  # bits of the place of a class in its chunk, and of a chunk in its task
FOUND = pa.schema([("doc_id", pa.int64()), ("cls", pa.binary()), ("n", pa.int32()), ("chunk", pa.int64()), ("names", pa.binary()), ("block", pa.binary())])


def _heads(of: np.ndarray) -> np.ndarray:
    """Where a run of equal entries begins."""
    return np.append(True, of[1:] != of[:-1]) if len(of) else np.empty(0, bool)


def shared_shingles(docs: DataFrame, chunk_bytes: int = 3 << 20, bucket_bytes: int = 12 << 20) -> tuple[DataFrame, DataFrame]:
    """``(members, shared)``.  ``members``: ``doc_id, cls, n``, the class and set
    size of each row of ``docs`` (without words: null and 0).  ``shared``:
    ``id, cls, n, keys, counts``, the shingles of a class that other classes have
    too, and how many classes have each, for classes whose prefix holds some;
    ``id`` is its first chunk and place, a third of the size of its name.

    Both ways between chunks of texts and buckets, shingles travel in packed
    blocks.  The 16-byte names of classes stay with their chunk: a bucket knows
    a class by its place in the chunk and tells classes of different chunks
    apart by 48 more bits of the name, compared only at an equal shingle.  So a
    shingle costs about as much however many buckets there are."""
    small_batches(docs.sparkSession)
    buckets = max(1, -(-text_bytes(docs) // bucket_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << CHUNK
        for chunk, (ids, texts) in enumerate(_texts(batches, chunk_bytes), task):
            sets = shingle_sets(texts)
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            rows = [(i % buckets, d, c, len(s), None, None, None) for i, (d, c, s) in enumerate(zip(ids, names, sets, strict=True))]
            own = {c: s for c, s in zip(names, sets, strict=True) if c is not None}
            if own:
                size = np.fromiter(map(len, own.values()), np.int64, len(own))
                keys, of = np.concatenate(list(own.values())), np.repeat(np.arange(len(own)), size)
                bucket = ((keys >> np.uint64(17)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                joined = b"".join(own)
                mark = np.frombuffer(joined, "<u8")[::2] >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(own), dtype=np.uint64)
                rows.append((chunk % buckets, None, None, len(own), chunk, joined + size.astype("<u4").tobytes(), None))
                for i in np.flatnonzero(np.diff(edge)):
                    pick = order[edge[i]: edge[i + 1]]
                    head = _heads(of[pick])
                    who = mark[of[pick][head]]
                    rows.append((int(i), None, None, len(who), chunk, None, who.tobytes() + keys[pick].tobytes() + np.packbits(head).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *FOUND.types], strict=True)], names=["bucket", *FOUND.names])

    def count(rows: pa.Table) -> pa.Table:
        rest = rows.filter(pc.is_null(rows.column("block"))).select(FOUND.names).cast(FOUND)
        rows = rows.filter(pc.is_valid(rows.column("block")))
        if not len(rows):
            return rest
        marks, keys, chunks = [], [], []
        for n, chunk, block in zip(*(rows.column(c).to_pylist() for c in ("n", "chunk", "block")), strict=True):
            k = (len(block) - 8 * n) * 8 // 65  # eight bytes and a bit each
            keys.append(np.frombuffer(block, "<u8", k, 8 * n))
            head = np.unpackbits(np.frombuffer(block, "u1", -1, 8 * (n + k)), count=k)
            marks.append(np.frombuffer(block, "<u8", n)[np.cumsum(head, dtype=np.int64) - 1])
            chunks.append(np.full(k, chunk))
        keys, marks, chunks = np.concatenate(keys), np.concatenate(marks), np.concatenate(chunks)
        order = np.argsort(keys, kind="stable")
        head = _heads(keys[order])
        order = order[~head | ~np.append(head[1:], True)]  # keys of two or more
        keys, marks, chunks = keys[order], marks[order], chunks[order]
        order = np.lexsort((chunks, marks >> np.uint64(PLACE), keys))
        keys, marks, chunks = keys[order], marks[order], chunks[order]
        first = _heads(keys) | _heads(marks >> np.uint64(PLACE))  # a class counts once, and its first chunk gets the answer
        keys, marks, chunks = keys[first], marks[first], chunks[first]
        start = np.flatnonzero(_heads(keys))
        counts = np.diff(np.append(start, len(keys)))
        counts = np.repeat(counts, counts)
        order = np.flatnonzero(counts > 1)
        order = order[np.argsort(chunks[order], kind="stable")]
        keys, chunks, counts = keys[order], chunks[order], counts[order].astype("<u4")
        place = (marks[order] & np.uint64((1 << PLACE) - 1)).astype("<u2")
        start = np.flatnonzero(_heads(chunks))
        made = [(int(chunks[i]), j - i, keys[i:j].tobytes() + counts[i:j].tobytes() + place[i:j].tobytes())
                for i, j in zip(start.tolist(), [*start[1:].tolist(), len(chunks)], strict=False)]
        chunk, n, block = list(zip(*made, strict=True)) or ([], [], [])
        void = {f: pa.nulls(len(made), FOUND.field(f).type) for f in ("doc_id", "cls", "names")}
        return pa.concat_tables([rest, pa.table(void | {"n": pa.array(n, pa.int32()), "chunk": pa.array(chunk, pa.int64()), "block": pa.array(block, pa.binary())}).select(FOUND.names)])

    def gather(rows: pa.Table) -> pa.Table:
        """The shared shingles of each class of one chunk, from all buckets."""
        chunk = rows.column("chunk")[0].as_py()
        keys, counts, of = [np.empty(0, "<i8")], [np.empty(0, "<u4")], [np.empty(0, "<u2")]
        for k, names, block in zip(*(rows.column(c).to_pylist() for c in ("n", "names", "block")), strict=True):
            if block is None:
                cls, n = [names[CLASS * i: CLASS * i + CLASS] for i in range(k)], np.frombuffer(names, "<u4", k, CLASS * k).astype(np.int64)
            else:
                keys.append(np.frombuffer(block, "<i8", k))
                counts.append(np.frombuffer(block, "<u4", k, 8 * k))
                of.append(np.frombuffer(block, "<u2", k, 12 * k))
        keys, counts, of = (np.concatenate(x) for x in (keys, counts, of))
        room = n - (4 * n + 4) // 5 + 1 - (n - np.bincount(of, minlength=len(n)))  # of the prefix, for shared shingles
        live = (room > 0)[of]
        of, keys, counts = of[live], keys[live], counts[live]
        order = np.argsort(of, kind="stable")
        of, keys, counts = of[order], keys[order], counts[order]
        head = np.flatnonzero(_heads(of))
        at, edges = of[head], pa.array(np.append(head, len(of)).astype(np.int32))
        return pa.Table.from_arrays([pa.array((chunk << PLACE) + at.astype(np.int64)), pa.array([cls[i] for i in at], pa.binary()), pa.array(n[at].astype(np.int32)),
                                     pa.ListArray.from_arrays(edges, pa.array(keys)), pa.ListArray.from_arrays(edges, pa.array(counts.astype(np.int32)))],
                                    names=["id", "cls", "n", "keys", "counts"])

    row = "doc_id long, cls binary, n int, chunk long, names binary, block binary"
    cuts = docs.select("doc_id", "text").mapInArrow(cut, f"bucket long, {row}")
    found = staged(cuts.groupBy("bucket").applyInArrow(count, row), "shingles")
    shared = found.where("chunk IS NOT NULL").select("chunk", "n", "names", "block").groupBy("chunk").applyInArrow(
        gather, "id long, cls binary, n int, keys array<bigint>, counts array<int>")
    return found.where("chunk IS NULL").select("doc_id", "cls", "n"), shared


def prefixes(shared: DataFrame) -> DataFrame:
    """``id, cls, n, own, keys, prefix, twin, bits`` of the classes whose prefix
    holds a shared shingle: ``own`` shingles of no other class come first in the
    order, then ``prefix``; ``twin`` is one for classes with equal prefix and
    size, null where shingles of their own tell them apart; ``bits`` is a bitmap
    of ``keys``."""
    need = F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1
    ranked = shared.withColumn("own", F.col("n") - F.size("keys")).withColumn("room", need - F.col("own")).where("room > 0")
    order = F.array_sort(F.zip_with("counts", "keys", lambda c, k: F.struct(c.alias("c"), k.alias("k"))))
    ranked = ranked.withColumn("prefix", F.transform(F.slice(order, F.lit(1), F.col("room")), lambda x: x["k"]))
    twin = F.when(F.col("own") == 0, F.unhex(F.md5(F.concat_ws(",", F.col("n").cast("string"), F.col("prefix").cast("array<string>")))))
    return ranked.select("id", "cls", "n", "own", "keys", "prefix", twin.alias("twin"), _bitmap("keys").alias("bits"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bitmap(keys: pd.Series) -> pd.Series:
    """Which of ``BITS`` remainders the keys have."""
    def one(k):
        bits = np.zeros(BITS // 64, np.uint64)
        k = k.view(np.uint64) & np.uint64(BITS - 1)
        np.bitwise_or.at(bits, k >> np.uint64(6), np.uint64(1) << (k & np.uint64(63)))
        return bits.view(np.int64)

    return keys.map(one)


def _may_link(x: str, y: str):
    """Whether two sets, of which ``i`` is the place of the first common
    shingle in each prefix, can be 80 % alike: by their sizes, by what is left
    after that place, and by the bits in which they differ, each of which is a
    shared shingle that only one of them has."""
    n1, n2 = F.col(f"{x}.n"), F.col(f"{y}.n")
    s1, s2 = n1 - F.col(f"{x}.own"), n2 - F.col(f"{y}.own")
    left = F.least(s1 - F.col(f"{x}.i"), s2 - F.col(f"{y}.i"))
    differ = F.aggregate(F.zip_with(f"{x}.bits", f"{y}.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return (F.least(n1, n2) * 5 >= F.greatest(n1, n2) * 4) & (left * 9 >= (n1 + n2) * 4) & ((s1 + s2 - differ) * 9 >= (n1 + n2) * 8)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that are 80 % alike: 100 * common >= 80 * union."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    common = F.size(F.array_intersect("ka", "kb"))
    return pairs.join(one, "a").join(two, "b").where(common * 9 >= (F.col("na") + F.col("nb")) * 4).select("a", "b")


def _labelled(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``id, grp, comp``: each class with the component that it is in so far."""
    labels = components(links)
    return groups.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "grp", F.coalesce("label", "id").alias("comp"))


def _most_met(met: DataFrame, turn: int) -> DataFrame:
    """Of the pairs ``(rep, hub)``, for each ``rep`` the hub that it meets most often."""
    counted = met.groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("m"))
    return counted.groupBy("rep").agg(F.max_by("hub", F.struct("m", F.xxhash64("hub", F.lit(turn)))).alias("a")).select("a", F.col("rep").alias("b"))


def _open(posted: DataFrame, classes: DataFrame) -> DataFrame:
    """Postings of the shingles that stand in more than one component, a row
    for each group and component; ``rep`` is a member of both."""
    units = classes.groupBy("grp", "comp").agg(F.min("id").alias("rep"))
    near = posted.join(units, "grp")
    apart = near.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("key")
    return near.join(apart, "key")


def jaccard_links(shared: DataFrame, turns: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(sets, links)``: the classes that can have links and, between them,
    links ``(a, b)`` that connect every component."""
    sets = staged(prefixes(shared), "sets")
    size_class = F.floor(F.log(1.25, F.col("n").cast("double")))
    alone, twins = sets.where("twin IS NULL"), sets.where("twin IS NOT NULL")
    firsts = twins.groupBy("twin").agg(F.min("id").alias("grp"), F.first("n").alias("n"), F.first("own").alias("own"), F.first("prefix").alias("prefix"))
    heads = alone.select(F.col("id").alias("grp"), "n", "own", "prefix").union(firsts.drop("twin"))
    posted = staged(heads.select("grp", "n", "own", F.posexplode("prefix").alias("i", "key")), "postings")
    least = twins.groupBy("twin").agg(F.min("id").alias("grp"))
    groups = staged(alone.select("id", F.col("id").alias("grp")).union(twins.select("twin", "id").join(least, "twin").select("id", "grp")), "groups")

    # first of each shingle and size class, and of these the one met most often; first of each group
    sized = posted.select(F.col("grp").alias("rep"), "key", size_class.alias("sc"))
    hubs = sized.groupBy("key", "sc").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    met = sized.join(hubs, ["key", "sc"]).where("rep != hub")
    inside = groups.where("id != grp").select(F.col("grp").alias("a"), F.col("id").alias("b"))
    tried = staged(_most_met(met, 0).union(inside), "tried")
    links = staged(_verified(tried, sets), "links")
    classes = staged(_labelled(groups, links), "labelled")

    # the same with other members, between different components, while it still finds links
    for turn in range(1, turns + 1):
        units = classes.groupBy("grp", "comp").agg(F.min("id").alias("rep"))
        near = posted.select("key", "grp", size_class.alias("sc")).join(units, "grp").drop("grp")
        hubs = near.groupBy("key", "sc").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min_by(
            F.struct("rep", "comp"), F.xxhash64("rep", F.lit(turn))).alias("h")).where("c0 <> c1").select("key", "sc", "h")
        met = near.join(hubs, ["key", "sc"]).where("comp <> h.comp").select("rep", F.col("h.rep").alias("hub"))
        pairs = staged(_most_met(met, turn), "pairs")
        new = staged(_verified(pairs, sets), "links")
        tried, links = tried.union(pairs), links.union(new)
        n_pairs, n_new = pairs.count(), new.count()
        if n_new:
            classes = staged(_labelled(groups, links), "labelled")
        if n_new * 20 < n_pairs or not n_new:
            break

    # all remaining candidates between different components, member by member
    near = _open(posted, classes).drop("rep")
    many = near.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"))
    members = classes.join(sets.select("id", "bits"), "id")
    near = staged(near.join(many, "key").join(members, ["grp", "comp"]), "open-postings")
    x, y = near.where("comp != main").alias("x"), near.alias("y")
    ahead = (F.col("y.comp") == F.col("y.main")) | (F.col("x.comp") < F.col("y.comp"))
    found = x.join(y, F.col("x.key") == F.col("y.key")).where((F.col("x.comp") != F.col("y.comp")) & ahead & _may_link("x", "y"))
    pairs = found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return sets, links.union(staged(_verified(pairs.join(known, ["a", "b"], "left_anti"), sets), "links"))


def ngram_components(docs: DataFrame, **sizes: int) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_shingles,
    component_id`` (the smallest doc_id that links reach, itself included).

    * null and empty texts have no shingle and only themselves; texts of one to
      four words have one, the whole sequence;
    * rows with equal sets are linked, also repeated rows; a null doc_id takes
      part in links, and is a component_id only where no other id is reached;
    * an empty table gives an empty result; other columns are not read.
    """
    rows, shared = shared_shingles(docs, **sizes)
    sets, links = jaccard_links(shared)
    first = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("first"))
    linked = components(links).join(sets.select(F.col("id").alias("node"), "cls"), "node").join(first, "cls")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    ids = first.join(linked.join(least, "label").select("cls", "least"), "cls", "left").select("cls", F.coalesce("least", "first").alias("component_id"))
    return rows.join(ids, "cls", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def all_links(sets: DataFrame) -> DataFrame:
    """Every link ``(a, b)``, ``a < b``, between the classes ``sets`` (as from
    ``prefixes``).  Pairs of groups are filtered by size and place first, then
    expanded to members, which are sifted by bitmap and intersected.  There are
    as many rows as links: a group of n texts that are all alike has n(n-1)/2."""
    named = sets.withColumn("grp", F.coalesce(F.hex("twin"), F.col("id").cast("string")))
    heads = named.groupBy("grp").agg(*[F.first(c).alias(c) for c in ("n", "own", "prefix")])
    posted = staged(heads.select("grp", "n", "own", F.posexplode("prefix").alias("i", "key")), "postings")
    x, y = posted.alias("x"), posted.alias("y")
    n1, n2 = F.col("x.n"), F.col("y.n")
    left = F.least(n1 - F.col("x.own") - F.col("x.i"), n2 - F.col("y.own") - F.col("y.i"))
    near = (F.least(n1, n2) * 5 >= F.greatest(n1, n2) * 4) & (left * 9 >= (n1 + n2) * 4)
    groups = x.join(y, F.col("x.key") == F.col("y.key")).where((F.col("x.grp") < F.col("y.grp")) & near)
    within = heads.select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
    groups = staged(groups.select(F.col("x.grp").alias("ga"), F.col("y.grp").alias("gb")).distinct().union(within), "group-pairs")
    members = staged(named.select("grp", "id", "n", "own", F.lit(0).alias("i"), "bits"), "group-members")
    x, y = members.alias("x"), members.alias("y")
    pairs = groups.join(x, F.col("ga") == F.col("x.grp")).join(y, F.col("gb") == F.col("y.grp")).where(
        ((F.col("ga") != F.col("gb")) | (F.col("x.id") < F.col("y.id"))) & _may_link("x", "y"))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return _verified(staged(pairs, "pairs"), sets)


def ngram_links(docs: DataFrame, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, links)``.  ``rows``, one per row of ``docs`` (``doc_id, text``):
    ``doc_id, n_shingles, cls, n_links``, the class (equal sets; null without
    words) and the number of other rows that are 80 % alike, equal ones among
    them.  ``links``: every pair ``(a, b)``, ``a < b``, of classes that are."""
    rows, shared = shared_shingles(docs, **sizes)
    sets = staged(prefixes(shared), "sets")
    names = sets.select("id", "cls")
    links = all_links(sets).join(names.toDF("a", "ca"), "a").join(names.toDF("b", "cb"), "b")
    links = staged(links.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")), "class-links")
    own = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("k"))
    both = links.union(links.select("b", "a")).toDF("cls", "other")
    met = both.join(own.toDF("other", "k"), "other").groupBy("cls").agg(F.sum("k").alias("met"))
    counts = own.join(met, "cls", "left").select("cls", (F.col("k") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"))
    rows = rows.join(counts, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "cls", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows, links


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the first of their component (all rows of that
    id), with their columns."""
    keep = ngram_components(docs).where("doc_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")
