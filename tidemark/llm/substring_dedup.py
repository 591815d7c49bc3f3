"""Exact substring removal over word windows by super-k-mer partitioning.

A window is ``K`` consecutive words.  Its minimiser is the smallest hash among
its ``M``-word grams; consecutive windows that share it travel together, as one
packed string of words (a super-k-mer), to the bucket of that minimiser.  Equal
windows have equal minimisers, so a bucket holds every copy of its windows; it
sorts them and marks all but the first.

Before anything is shuffled, a task sorts the windows of its own chunk of
documents the same way: copies within the chunk are marked at once and only the
first of each travels.  So however common a passage is, its bucket gets one row
per chunk at most.  Super-k-mers go to a bucket as one compressed block per
chunk; in the bucket, those whose minimiser came once are passed over.

A gram that is the minimiser of so many different windows that they would fill
a good part of a bucket is heavy.  Heavy grams, found by counts over a sample of
the documents, come last in the order of minimisers; a window of nothing else
goes by its own hash.  Both depend on the window's words alone, so equal windows
still meet, whichever grams the sample finds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, text_bytes
from tidemark.llm.hashing import mixed, run_hashes, sliding_min, word_hashes

K, M = 20, 4
LAST = np.iinfo(np.int64).max  # stands for a null id: after every other
HEAVY = np.iinfo(np.uint64).max  # stands for the hash of a heavy gram: after every other
_REF = np.dtype([("doc_id", "<i8"), ("version", "<u4"), ("start", "<u4"), ("mini", "<u4")])


class _Runs:
    """Word sequences end to end, with the windows that lie within one."""

    def __init__(self, words: list[bytes], sizes: np.ndarray, doc_id: np.ndarray, start: np.ndarray, k: int):
        self.h = word_hashes(words)
        self.begin = np.cumsum(sizes) - sizes
        self.n = np.maximum(sizes - k + 1, 0)  # windows of each sequence
        self.of = np.repeat(np.arange(len(sizes)), self.n)
        within = np.arange(self.n.sum()) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.at = self.begin[self.of] + within  # first word of each window
        self.doc, self.start, self.k = doc_id[self.of], start[self.of] + within, k

    def again(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window: whether an equal one starts earlier, and whether an
        equal one stands before it in the order (doc_id, start, here)."""
        if not len(self.at):
            return np.zeros(0, bool), np.zeros(0, bool)
        key = run_hashes(self.h, self.k)[self.at]
        placed = np.all((self.doc[1:] > self.doc[:-1]) | (self.doc[1:] == self.doc[:-1]) & (self.start[1:] >= self.start[:-1]))
        order = np.argsort(key, kind="stable") if placed else np.lexsort((self.start, self.doc, key))
        sorted_key = key[order]
        head = np.append(True, sorted_key[1:] != sorted_key[:-1])
        for _ in range(64):  # equal hashes of different words (as good as never) split off until none is left
            first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            other = np.flatnonzero(~head)
            same = np.ones(len(other), bool)
            for j in range(self.k):
                same &= self.h[self.at[order[other]] + j] == self.h[self.at[first[other]] + j]
            if same.all():
                break
            apart = key.copy()
            apart[order[other[~same]]] = mixed(apart[order[other[~same]]], self.h[self.at[order[other[~same]]]])
            key, order = apart, np.lexsort((self.start, self.doc, apart))
            sorted_key = key[order]
            head = np.append(True, sorted_key[1:] != sorted_key[:-1])
        earlier, seen = np.zeros(len(order), bool), np.zeros(len(order), bool)
        d, s, e, t = self.doc[order], self.start[order], self.doc[first], self.start[first]
        earlier[order] = (e < d) | (e == d) & (t < s)
        seen[order] = ~head
        return earlier, seen


def _spans(doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """``(doc_id, version, windows)`` per document; windows: pairs of first
    start and number of consecutive starts."""
    order = np.lexsort((start, version, doc))
    doc, version, start = doc[order], version[order], start[order]
    new_doc = np.append(True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]))
    new_run = new_doc | np.append(True, start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new_run)
    pairs = np.stack([start[at], np.diff(np.append(at, len(start)))], 1).astype("<u4")
    cut = np.flatnonzero(new_doc[at])
    for i, j in zip(cut, np.append(cut[1:], len(at)), strict=True):
        yield int(doc[at[i]]), int(version[at[i]]), pairs[i:j].tobytes()


def _removed_words(pairs: bytes, n: int, k: int) -> np.ndarray:
    """Which of ``n`` words the windows cover."""
    edge = np.zeros(n + 1, np.int32)
    spans = np.frombuffer(pairs, "<u4").reshape(-1, 2).astype(np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans.sum(1) + k - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """The documents, some ``most`` words at a time: id, version and words."""
    rows, size = [], 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if t.is_valid:
                text = t.as_buffer().to_pybytes()
                rows.append((LAST if d is None else d, zlib.crc32(text), text.split()))
                size += len(rows[-1][2])
            if size >= most:
                yield rows
                rows, size = [], 0
    yield rows


def _minimisers(runs: _Runs, m: int, heavy: np.ndarray) -> np.ndarray:
    """The minimiser of each window."""
    grams = run_hashes(runs.h, m)
    if not len(heavy):
        return sliding_min(grams, runs.k - m + 1)[runs.at]
    mini = sliding_min(np.where(np.isin(grams, heavy), HEAVY, grams), runs.k - m + 1)[runs.at]
    return np.where(mini == HEAVY, run_hashes(runs.h, runs.k)[runs.at], mini)


def heavy_grams(docs: DataFrame, k: int, m: int, chunk_words: int, least: int, sample: int) -> np.ndarray:
    """The hashes of grams that are the minimiser of about ``least`` super-k-mers
    or more, by a ``sample``-th of the documents (told by the hash of the id).
    Each stands for a share of a bucket, so they are at most a few a bucket."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, chunk_words):
            rows = [r for r in rows if len(r[2]) >= k]
            gram, n = np.empty(0, np.uint64), np.empty(0, np.int64)
            if rows:
                sizes, zero = np.array([len(r[2]) for r in rows]), np.zeros(len(rows), np.int64)
                runs = _Runs([w for r in rows for w in r[2]], sizes, zero, zero, k)
                mini = _minimisers(runs, m, gram)
                go = np.sort(np.unique(run_hashes(runs.h, k)[runs.at], return_index=True)[1])  # equal windows travel once
                new = np.append(True, (np.diff(go) != 1) | (mini[go][1:] != mini[go][:-1]) | (runs.of[go][1:] != runs.of[go][:-1]))
                gram, n = np.unique(mini[go[new]], return_counts=True)
            yield pa.RecordBatch.from_pydict({"gram": gram[n > 1].view(np.int64), "n": n[n > 1].astype(np.int64)})

    taken = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 200)), F.lit(sample)) == 0)
    sums = taken.mapInArrow(tally, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") * sample >= least)
    return np.array([r.gram for r in sums.select("gram").collect()], np.int64).view(np.uint64)


def super_kmers(docs: DataFrame, k: int = K, m: int = M, chunk_words: int = 700_000, bucket_bytes: int = 24 << 20, sample: int = 16) -> DataFrame:
    """``bucket, doc_id, version, block``: the windows as they travel, a packed
    block per chunk and bucket (``doc_id`` and ``version`` null), and the copies
    found within a chunk."""
    small_batches(docs.sparkSession)
    buckets = max(1, -(-3 * text_bytes(docs) // bucket_bytes))
    # an eighth of a bucket, at some 200 bytes a super-k-mer and its reference
    heavy = heavy_grams(docs, k, m, chunk_words, max(2, bucket_bytes // 1600), sample) if buckets > 1 else np.empty(0, np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, chunk_words):
            yield chunk(rows)

    def chunk(rows: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
        rows = sorted((r for r in rows if len(r[2]) >= k), key=lambda r: r[0])
        out: dict[str, list] = {"bucket": [], "doc_id": [], "version": [], "block": []}
        if rows:
            words = [w for r in rows for w in r[2]]
            sizes = np.array([len(r[2]) for r in rows])
            doc, version = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            runs = _Runs(words, sizes, doc, np.zeros(len(rows), np.int64), k)
            earlier, seen = runs.again()
            if earlier.any():
                for d, v, pairs in _spans(runs.doc[earlier], version[runs.of[earlier]], runs.start[earlier]):
                    for key, value in zip(out, (zlib.crc32(pairs, d & 0xFFFF) % buckets, d, v, pairs), strict=True):
                        out[key].append(value)
            mini = _minimisers(runs, m, heavy)
            go = np.flatnonzero(~seen)
            new = np.append(True, (np.diff(go) != 1) | (mini[go][1:] != mini[go][:-1]) | (runs.of[go][1:] != runs.of[go][:-1]))
            head = go[new]  # first window of each super-k-mer
            number = np.diff(np.append(np.flatnonzero(new), len(go)))
            place = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))
            packed = b" ".join(words)
            a, b = place[runs.at[head]], place[runs.at[head] + number + k - 1] - 1
            bucket = ((mini[head] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            ref = np.empty(len(head), _REF)
            ref["doc_id"], ref["version"], ref["start"], ref["mini"] = runs.doc[head], version[runs.of[head]], runs.start[head], mini[head] & np.uint64(0xFFFFFFFF)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            zip_ = zstandard.ZstdCompressor(level=4)
            for i in np.flatnonzero(np.diff(edge)):
                pick = order[edge[i]: edge[i + 1]]
                block = len(pick).to_bytes(4, "little") + b"".join(np.diff(ref[f][pick], prepend=ref[f].dtype.type(0)).tobytes() for f in _REF.names) + b"\n".join(
                    [packed[x:y] for x, y in zip(a[pick].tolist(), b[pick].tolist(), strict=True)])
                for key, value in zip(out, (int(i), None, None, zip_.compress(block)), strict=True):
                    out[key].append(value)
        return pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("block", pa.binary())]))

    return docs.select("doc_id", "text").mapInArrow(cut, "bucket long, doc_id long, version long, block binary")


def repeated_windows(docs: DataFrame, k: int = K, **sizes: int) -> DataFrame:
    """``doc_id, version, spans``: the windows of each document that start
    earlier elsewhere, in one or more rows a document.  ``version`` is the
    CRC-32 of the text and tells apart different texts under one id."""
    def judge(rows: pa.Table) -> pa.Table:
        found = [r for r in rows.select(["doc_id", "version", "block"]).to_pylist() if r["version"] is not None]
        refs, texts = [], []
        for block in (x for x, v in zip(rows.column("block"), rows.column("version"), strict=True) if not v.is_valid):
            data = zstandard.ZstdDecompressor().decompress(block.as_py())
            n, at = int.from_bytes(data[:4], "little"), 4
            ref = np.empty(n, _REF)
            for f in _REF.names:
                width = _REF[f].itemsize
                ref[f] = np.cumsum(np.frombuffer(data, _REF[f], n, at), dtype=_REF[f])
                at += n * width
            refs.append(ref)
            texts.append(data[at:])
        if refs:
            ref = np.concatenate(refs)
            _, inverse, count = np.unique(ref["mini"], return_inverse=True, return_counts=True)
            shared = count[inverse] > 1
            pieces, at = [], 0
            for r, text in zip(refs, texts, strict=True):
                on = np.flatnonzero(shared[at: at + len(r)])
                if len(on):
                    lines = text.split(b"\n")
                    pieces += [lines[i].split(b" ") for i in on.tolist()]
                at += len(r)
            ref = ref[shared]
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            runs = _Runs([w for p in pieces for w in p], sizes, ref["doc_id"].astype(np.int64), ref["start"].astype(np.int64), k)
            earlier, _ = runs.again()
            if earlier.any():
                found += [dict(zip(("doc_id", "version", "block"), x, strict=True)) for x in _spans(
                    runs.doc[earlier], ref["version"][runs.of[earlier]].astype(np.int64), runs.start[earlier])]
        return pa.Table.from_pylist(found, pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("block", pa.binary())]))

    return super_kmers(docs, k, **sizes).groupBy("bucket").applyInArrow(judge, "doc_id long, version long, block binary").withColumnRenamed("block", "spans")


def substring_dedup(docs: DataFrame, k: int = K, with_text: bool = False, **sizes: int) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` and, if
    asked for, ``kept`` (the words left, joined by one space).

    A word goes if a window over it equals one that starts earlier: under a
    smaller doc_id, or earlier under the same.  Windows are judged on the input.

    * null, empty and shorter texts have no window and lose nothing;
    * a null id comes after every other id;
    * rows that repeat one id and text have windows at the same places, none of
      which is earlier: each row gets the same result as one row would;
    * an empty table gives an empty result; other columns are not read.
    """
    found = repeated_windows(docs, k, **sizes).groupBy("doc_id", "version").agg(F.collect_list("spans").alias("spans"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("version").alias("_v"), "spans")
    keyed = docs.select("doc_id", "text", F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(-1)).alias("_v0"))
    met = keyed.join(found, (F.coalesce(keyed["doc_id"], F.lit(int(LAST))) == found["_id"]) & (keyed["_v0"] == found["_v"]), "left")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                words = text.encode().split() if text is not None else []
                kept = words
                if spans is not None:
                    gone = _removed_words(b"".join(spans), len(words), k)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                left = b" ".join(kept)
                rows.append((d, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode()) if with_text else
                            (d, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return met.select("doc_id", "text", "spans").mapInPandas(
        keep, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
