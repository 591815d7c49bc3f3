"""The prefix trie of all conversations, from sorted neighbours.

1.  A conversation becomes the chain of hashes of its turns: entry ``d`` names
    the sequence of its first ``d`` turns, so it is the id of the node of depth
    ``d``.  16 bytes and a word count a turn travel, never texts.
2.  The chains are range-sorted with their conv_id (many equal chains are many
    keys).  In each partition neighbours share a longest common prefix (LCP);
    union-find takes these edges in descending depth.  A merge at depth ``L``
    makes (or extends) the branching node of that depth; what lies between a
    component's top and ``L`` are nodes with one child and the same members.
3.  Nodes on the chains of the first and last row of a partition may have
    members elsewhere.  They are left open: the contracted forest of a partition
    is these two chains with what hangs below each of their nodes.  Forests are
    merged by node id, and what a subtree sums is added up along the chains.

A partition holds about ``partition_bytes`` of chains; the merged forest has at
most two chains a partition.  The ids of conversations that end at an open node
are packed, in order, into chunks that a single pass digests, chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, staged

TOKEN = 16  # bytes of a node id
NO_ENDS = hashlib.sha256(b"").hexdigest()
CHUNK_IDS = 1 << 16
FOUND = pa.schema([("kind", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()),
                   ("ends_sha256", pa.string()), ("first", pa.int64()), ("ids", pa.binary())])
FOUND_DDL = ("kind string, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
             "saved_tokens long, words long, ends_sha256 string, first long, ids binary")


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` of the table ``conv_id, turn, role, text``; ``turns``
    is the list ``(turn, token, words)`` in order of turn (null first), ties by
    the hash of role and text; null role and text are empty.  Rows of a null
    conv_id belong to no conversation and are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    token = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TOKEN)
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", token.alias("token"), n_words(text).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame, family: int = 20, most_shared: int = 4) -> DataFrame:
    """``conv_id, turns`` with the first ``h`` turns of each conversation ``c``
    taken from conversation ``c - c % family`` (fewer or none if it has no
    more), ``h`` = CRC-32 of the decimal ``c`` modulo ``most_shared``."""
    heads = turns.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most_shared - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most_shared).cast("int")
    own = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h)
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = []
        for tokens in batch.column("tokens").to_pylist():
            chain, last = [], b""
            for t in tokens:
                last = hashlib.blake2b(last + t, digest_size=TOKEN).digest()
                chain.append(last)
            paths.append(b"".join(chain))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.binary()), batch.column("words")], names=["conv_id", "path", "words"])


def common_depth(a: bytes, b: bytes) -> int:
    """How many node ids two chains share from the root."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // TOKEN
    x, y = np.frombuffer(a, "u1", size), np.frombuffer(b, "u1", size)
    return int(np.argmax(x != y)) // TOKEN


class Forest:
    """Union-find over the sorted chains of one partition."""

    def __init__(self, ids: list[int], paths: list[bytes], words: list[list[int]]):
        self.begin = [i for i in range(len(paths)) if i == 0 or paths[i] != paths[i - 1]]
        self.ids, self.paths, self.words = ids, [paths[i] for i in self.begin], [words[i] for i in self.begin]
        self.begin.append(len(ids))
        m = len(self.paths)
        self.up = list(range(m))
        self.top = [len(p) // TOKEN for p in self.paths]
        self.n = [self.begin[i + 1] - self.begin[i] for i in range(m)]
        self.low = [ids[self.begin[i]] for i in range(m)]
        self.kids, self.leaves, self.saved = [0] * m, [0] * m, [0] * m
        self.end = list(range(m))  # the chain that ends at the top
        self.open = [i in (0, m - 1) for i in range(m)]
        self.below = [[] for _ in range(m)]  # rows whose parent is the top
        self.rows: list[dict] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def node(self, i: int, depth: int) -> bytes:
        return self.paths[i][TOKEN * (depth - 1): TOKEN * depth] if depth else b""

    def ends(self, c: int) -> list[int]:
        return [] if self.end[c] < 0 else self.ids[self.begin[self.end[c]]: self.begin[self.end[c] + 1]]

    def lift(self, c: int, to: int) -> None:
        """Finishes the nodes of a component from its top to below ``to``; the
        component then stands at ``to``, above them."""
        at, n, low = self.top[c], self.n[c], self.low[c]
        last = None
        for depth in range(at, to, -1):
            node, w = self.node(c, depth), self.words[c][depth - 1] if depth else 0
            row = {"node": node, "depth": depth, "conv_id": low, "n_convs": n}
            held = self.ends(c) if depth == at else []
            if self.open[c]:
                row |= {"kind": "open", "parent": self.node(c, depth - 1) if depth else None, "words": w, "n_children": self.kids[c], "n_leaves": self.leaves[c], "saved_tokens": self.saved[c]}
                for r in self.below[c]:
                    r["parent"] = node
                self.kids[c] = self.leaves[c] = self.saved[c] = 0
                self.below[c] = []
                for k in range(0, len(held), CHUNK_IDS):
                    self.rows.append({"kind": "ends", "node": node, "first": held[k], "ids": ",".join(map(str, held[k: k + CHUNK_IDS])).encode()})
            else:
                self.leaves[c] = self.leaves[c] or 1
                self.saved[c] += (n - 1) * w
                row |= {"kind": "closed", "n_children": self.kids[c], "n_leaves": self.leaves[c], "saved_tokens": self.saved[c],
                        "ends_sha256": hashlib.sha256(",".join(map(str, held)).encode()).hexdigest() if held else NO_ENDS}
                for r in self.below[c]:
                    r["parent_conv_id"] = low
                self.kids[c], self.below[c] = 1, [row]
            self.rows.append(row)
            last = row
        if last is not None:
            self.top[c], self.end[c] = to, -1

    def merge(self, i: int, j: int, depth: int) -> None:
        a, b = self.find(i), self.find(j)
        self.lift(a, depth)
        self.lift(b, depth)
        if len(self.below[a]) < len(self.below[b]):
            a, b = b, a
        self.up[b] = a
        for x in (self.n, self.kids, self.leaves, self.saved):
            x[a] += x[b]
        self.low[a] = min(self.low[a], self.low[b])
        self.open[a] = self.open[a] or self.open[b]
        self.end[a] = max(self.end[a], self.end[b])
        self.below[a] += self.below[b]

    def run(self) -> list[dict]:
        depth = [common_depth(a, b) for a, b in zip(self.paths, self.paths[1:])]
        for i in sorted(range(len(depth)), key=lambda i: -depth[i]):
            self.merge(i, i + 1, depth[i])
        self.lift(self.find(0), -1)
        return self.rows


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, paths, words = [], [], []
    for batch in batches:
        ids += batch.column("conv_id").to_pylist()
        paths += batch.column("path").to_pylist()
        words += batch.column("words").to_pylist()
    if not ids:
        return
    made = Forest(ids, paths, words).run()
    part = TaskContext.get().partitionId()
    made += [{"kind": "chain", "first": 2 * part + side, "node": paths[-side]} for side in (0, 1)]
    for i in range(0, len(made), 2000):
        yield pa.RecordBatch.from_pylist(made[i: i + 2000], FOUND)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node of chunks in order; a chunk is in memory at a time."""
    node, sha = None, None
    for batch in batches:
        for now, ids in zip(batch.column("node").to_pylist(), batch.column("ids"), strict=True):
            if sha is not None and now == node:
                sha.update(b",")
            else:
                if sha is not None:
                    yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": sha.hexdigest()}], pa.schema([FOUND.field("node"), FOUND.field("ends_sha256")]))
                node, sha = now, hashlib.sha256()
            sha.update(ids.as_buffer())
    if sha is not None:
        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": sha.hexdigest()}], pa.schema([FOUND.field("node"), FOUND.field("ends_sha256")]))


def _merged(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, subtrees)`` of the merged forest: the open nodes with the sums
    of all partitions, and what their subtrees add up to.  Each node counts on
    one chain that holds it; sums run up that chain, and what other chains bring
    meets them at the nodes that they share."""
    opened = found.where("kind = 'open'")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = opened.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"), *sums)
    nodes = staged(nodes, "open-nodes")
    inner = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("inner"))
    nodes = nodes.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0))).drop("inner")
    ends = found.where("kind = 'ends'").select("node", "first", "ids").repartition("node").sortWithinPartitions("node", "first")
    ends = ends.mapInArrow(_digests, "node binary, ends_sha256 string")
    nodes = staged(nodes.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "open-nodes")
    chains = found.where("kind = 'chain'").select(F.col("first").alias("chain"), F.col("node").alias("path"))
    d = F.explode(F.sequence(F.lit(0), (F.octet_length("path") / TOKEN).cast("int")))
    chains = chains.select("chain", "path", d.alias("depth"))
    node = F.when(F.col("depth") == 0, F.substring("path", 1, 0)).otherwise(F.substr("path", (F.col("depth") - 1) * TOKEN + 1, F.lit(TOKEN)))
    chains = staged(chains.select("chain", "depth", node.alias("node")), "open-chains")
    home = chains.groupBy("node").agg(F.min("chain").alias("home"))
    own = nodes.select("node", (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    at = chains.join(home, "node").join(own, "node").select("chain", "depth", "node", *[F.when(F.col("chain") == F.col("home"), F.col(c)).otherwise(0).alias(c) for c in ("leaves", "saved")])
    below = Window.partitionBy("chain").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.select("node", F.sum("leaves").over(below).alias("leaves"), F.sum("saved").over(below).alias("saved"))
    return nodes, at.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame, partition_bytes: int = 8 << 20) -> DataFrame:
    """One row per distinct sequence of first turns of the conversations
    ``turns`` (``conv_id, turns``: each conversation once): ``node, parent`` (ids;
    the root's is empty, its parent null), ``depth``, ``conv_id`` (the smallest
    member), ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256`` as the contract of ``op12`` has them.

    * a conversation without turns is a member of the root and ends there;
    * equal conversations are members of the same nodes; an empty table has no
      node, not even a root;
    * a chain (16 bytes and a count a turn) is one row, so a conversation of a
      million turns is a row of 24 MB; texts of any length are hashed first."""
    pairs = turns.select("conv_id", F.transform("turns", lambda t: t["token"]).alias("tokens"), F.transform("turns", lambda t: t["words"]).alias("words"))
    chains = staged(pairs.mapInArrow(_chained, "conv_id long, path binary, words array<long>"), "chains")
    size = chains.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    parts = max(size // partition_bytes + 1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = chains.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = staged(ordered.mapInArrow(_forests, FOUND_DDL), "forests")
    nodes, subtrees = _merged(found)
    out = ["node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    opened = nodes.drop("n_leaves", "saved_tokens").join(subtrees, "node").join(above, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    closed = found.where("kind = 'closed'")
    inside = closed.where("parent IS NULL")
    hanging = closed.where("parent IS NOT NULL").join(above, "parent").withColumn("parent_conv_id", F.col("above"))
    return opened.select(out).union(inside.select(out)).union(hanging.select(out))
