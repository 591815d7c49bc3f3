"""Token ids in length-delimited binary records, with an offset index.

A file is a sequence of records::

    u64 length | u32 masked CRC-32C of the length | data | u32 masked CRC-32C of the data

(little-endian; the framing of TFRecord files).  ``data`` is one serialized
sequence: ``u8`` bytes per id (2 or 4), ``u8`` 1 if the document has an id,
``i64`` document id, then the ids.  Beside each file lies an index with the
``u64`` offset of every record, so a reader can fetch any record of any file.

Documents are range-partitioned by id, so that files follow each other in
ascending order; a task writes its files under names of its own attempt and
returns a manifest row for each, hence what a lost or repeated task left behind
is never read.
"""

from __future__ import annotations

import re
import struct
import threading
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem, scratch_path, small_batches, staged

MANIFEST = "part int, seq int, path string, index_path string, n_records long, n_tokens long"
_HEAD = np.dtype([("width", "u1"), ("has_id", "u1"), ("doc_id", "<i8")])
_BLOCK = 4096
_POLY = 0x82F63B78  # CRC-32C, reversed


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """``after[p, b]``: the register that byte b leaves after p more zero bytes;
    ``skip[j, b]``: what byte j of a register becomes after a block of zeros."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLY), one >> 1).astype(np.uint32)
    after = np.empty((_BLOCK, 256), np.uint32)
    after[0] = one
    for p in range(1, _BLOCK):
        after[p] = (after[p - 1] >> 8) ^ one[after[p - 1] & 255]
    skip = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(_BLOCK):
        skip = (skip >> 8) ^ one[skip & 255]
    return after, skip


_TABLES: list = []


def crc32c(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C of ``data[starts[i]:ends[i]]`` (uint8) for adjacent parts of at
    least four bytes each that cover ``data``."""
    if not _TABLES:
        _TABLES.extend(_crc_tables())
    after, skip = _TABLES
    flipped = data.copy()
    for j in range(4):  # the register starts with ones, which equals four inverted bytes
        flipped[starts + j] ^= 255
    sizes = ends - starts
    from_end = np.repeat((ends - 1).astype(np.int32), sizes)
    from_end -= np.arange(len(data), dtype=np.int32)
    from_end &= _BLOCK - 1
    from_end <<= 8
    from_end |= flipped
    parts = after.ravel()[from_end]
    n_blocks = -(-sizes // _BLOCK)
    first = sizes - (n_blocks - 1) * _BLOCK  # bytes of a part's first block
    out = np.zeros(len(starts), np.uint32)
    cut = np.repeat(starts, n_blocks)
    rank = np.arange(len(cut)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    cut = cut + np.where(rank > 0, np.repeat(first, n_blocks) + (rank - 1) * _BLOCK, 0)
    blocks = np.bitwise_xor.reduceat(parts, cut)
    at = np.cumsum(n_blocks) - n_blocks
    for r in range(int(n_blocks.max(initial=0))):
        on = np.flatnonzero(n_blocks > r)
        old = out[on]
        out[on] = skip[0][old & 255] ^ skip[1][(old >> 8) & 255] ^ skip[2][(old >> 16) & 255] ^ skip[3][old >> 24] ^ blocks[at[on] + r]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(0xA282EAD8)


class _Places(dict):
    """The number of each piece, given at its first look-up."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


class PieceEncoder:
    """Token ids of texts, equal to the tokenizer's own and several times as fast.

    Byte-level BPE of this kind first splits a text into words with the space
    before them, runs of punctuation and white space, and merges only within
    these.  So texts are cut at single spaces that have a character other than
    white space on one side, before a comma or full stop between a letter or
    digit and white space, and around a line break between other characters; the
    ids of a piece are kept for its next use (the first ``most`` pieces; later
    ones are encoded each time).  Texts where such marks stand in other places
    are cut at spaces only, or encoded whole.
    """

    _WHOLE = re.compile(r"\s (?:\s|\Z)|\x01")
    _ODD_MARK = re.compile(r"[.,]\s(?<![^\W_]..)", re.DOTALL)  # not after a letter or digit
    _kept: dict[str, PieceEncoder] = {}
    _uses = 0

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.place, self.used = _Places(), 0
        self.begin, self.size, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        """One per Python worker, so that tasks share what is kept; given up
        some seconds after its last use, so that later jobs have the memory."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    @classmethod
    def rest(cls, seconds: float = 6.0) -> None:
        """Give up what is kept unless it is used again within ``seconds``."""
        cls._uses += 1
        now = cls._uses
        timer = threading.Timer(seconds, lambda: cls._kept.clear() if cls._uses == now else None)
        timer.daemon = True
        timer.start()

    def _learn(self, pieces: list[str], first: int) -> None:
        """Encode pieces met for the first time, numbered from ``first``."""
        if not pieces:
            return
        bare = np.fromiter((x[:1] == "\x01" for x in pieces), bool, len(pieces))
        # the others are joined, as one call costs less than many: the space before each keeps them apart
        texts = [" " + x for x in pieces if x[:1] != "\x01"]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        got = self.tokenizer.encode("".join(texts), add_special_tokens=False)
        cuts = np.append(np.searchsorted(np.fromiter((x[0] for x in got.offsets), np.int64, len(got)), ends[:-1]), len(got)) if texts else ends
        alone = [x.ids for x in self.tokenizer.encode_batch_fast([x[1:] for x in pieces if x[:1] == "\x01"], add_special_tokens=False)]
        size = np.empty(len(pieces), np.int64)
        size[~bare] = np.diff(cuts, prepend=0)
        size[bare] = np.fromiter(map(len, alone), np.int64, len(alone))
        begin = np.empty(len(pieces), np.int64)
        begin[~bare] = self.used + cuts - size[~bare]
        begin[bare] = self.used + len(got) + np.cumsum(size[bare]) - size[bare]
        n, total = first + len(pieces), self.used + int(size.sum())
        if n > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * n), np.resize(self.size, 2 * n)
        if total > len(self.pool):
            self.pool = np.resize(self.pool, 2 * total)
        self.pool[self.used: total] = got.ids + [i for x in alone for i in x]
        self.begin[first: n], self.size[first: n], self.used = begin, size, total

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces without the space before them; ``\\x01`` marks those that had
        none.  None: the text must be encoded whole."""
        if " ".join(text.split()) == text.replace("\n", " ") and "\x01" not in text:  # white space stands alone
            if not self._ODD_MARK.search(text):
                text = text.replace(", ", " \x01, ").replace(". ", " \x01. ").replace(".\n", " \x01.\n").replace(",\n", " \x01,\n")
            text = text.replace("\n", " \x01\n \x01")
        elif self._WHOLE.search(text):
            return None
        return ("\x01" + text).split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        keys, ends, whole = [], [], {}
        for i, text in enumerate(texts):
            pieces = self._pieces(text)
            if pieces is None:
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                keys += pieces
            ends.append(len(keys))
        known, used = len(self.place), self.used
        at = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))
        new = list(islice(reversed(self.place), len(self.place) - known))[::-1]
        self._learn(new, known)
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.pool[np.repeat(self.begin[at] - total[:-1], size) + np.arange(total[-1])]
        if known + len(new) > self.most:
            for x in new:
                del self.place[x]
            self.used = used
        bounds = total[[0, *ends]]
        return [whole[i] if i in whole else flat[bounds[i]: bounds[i + 1]] for i in range(len(texts))]


def _framed(ids: list[np.ndarray], doc_ids: list[int | None]) -> tuple[bytes, np.ndarray]:
    """The records of some documents, and the size of each."""
    data = []
    for x, d in zip(ids, doc_ids, strict=True):
        width = 2 if len(x) == 0 or x.max() < 65536 else 4
        data.append(struct.pack("<BBq", width, d is not None, d or 0) + x.astype(f"<u{width}").tobytes())
    size = np.array([len(x) for x in data], np.int64)
    lengths = size.astype("<u8").tobytes()
    end = np.cumsum(size)
    check = masked(crc32c(np.frombuffer(b"".join(data), np.uint8), end - size, end)).astype("<u4").tobytes()
    at = np.arange(len(data)) * 8
    head = masked(crc32c(np.frombuffer(lengths, np.uint8), at, at + 8)).astype("<u4").tobytes()
    return b"".join(p for i, x in enumerate(data) for p in (
        lengths[8 * i: 8 * i + 8], head[4 * i: 4 * i + 4], x, check[4 * i: 4 * i + 4])), size + 16


def write_token_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2,
                        file_bytes: int = 64 << 20, group_chars: int = 1 << 20) -> DataFrame:
    """Writes ``docs`` (``doc_id, text``) below ``folder`` in ascending doc_id
    order and returns the manifest, one row per file in the order ``part, seq``.

    Every text is encoded whole and gets ``end_id`` at its end; a null or empty
    text is that id alone.  Null ids come last; rows with equal ids are all
    written, ordered by a hash of their text.  An empty table writes no file.
    Other columns are not read.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        PieceEncoder._uses += 1
        part, attempt, encoder, rows, out = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], PieceEncoder.of(tokenizer), [], None

        def close():
            out.close()
            with fs.open_output_stream(rows[-1]["index_path"]) as index:
                index.write((np.cumsum(sizes) - sizes).astype("<u8").tobytes())
            rows[-1] |= {"n_records": len(sizes), "n_tokens": n_tokens}

        for doc_ids, texts in _groups(batches, group_chars):
            if out is None:
                name = f"{root}/part-{part:06d}-{len(rows):04d}-{attempt}"
                rows.append({"part": part, "seq": len(rows), "path": f"{name}.rec", "index_path": f"{name}.idx"})
                out, sizes, written, n_tokens = fs.open_output_stream(rows[-1]["path"]), np.empty(0, np.int64), 0, 0
            ids = [np.append(x, np.uint32(end_id)) for x in encoder.encode(texts)]
            block, size = _framed(ids, doc_ids)
            out.write(block)
            sizes, written, n_tokens = np.concatenate([sizes, size]), written + len(block), n_tokens + sum(map(len, ids))
            if written >= file_bytes:
                close()
                out = None
        if out is not None:
            close()
        PieceEncoder.rest()
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), (
            "index_path", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())]))

    small_batches(docs.sparkSession)
    order = F.col("doc_id").asc_nulls_last()
    ranged = docs.select("doc_id", "text").repartitionByRange(order).sortWithinPartitions(order, F.xxhash64("text"))
    return staged(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str]]]:
    """Documents in groups of about ``most`` characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(d)
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def read_token_records(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per record of the manifest's files: ``doc_id, start`` (ids of all
    records before it), ``n_tokens, ids_crc32`` (of the ids as little-endian
    u32) and, if asked for, ``ids``.  A damaged record raises an error.

    Records are found by the index and checked in blocks of about 8 MB.  The
    running sum of starts is over the manifest, one row per file.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = staged(manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-files")
    n = max(1, min(files.count(), 8 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index_path, first in zip(*(batch.column(c).to_pylist() for c in ("path", "index_path", "first")), strict=True):
                fs, path = filesystem(path)
                with fs.open_input_stream(index_path) as f:
                    offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
                with fs.open_input_file(path) as f:
                    cuts = np.append(offsets, f.size())
                    i = 0
                    while i < len(offsets):
                        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + (8 << 20), "right")) - 1)
                        ids, doc_ids = parsed(f.read_at(int(cuts[j] - cuts[i]), int(cuts[i])), cuts[i: j + 1] - cuts[i])
                        size = np.array([len(x) for x in ids], np.int64)
                        columns = {"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(first + np.cumsum(size) - size),
                                   "n_tokens": pa.array(size), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())}
                        if with_ids:
                            columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(columns)
                        first, i = first + int(size.sum()), j

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.repartitionByRange(n, "part", "seq").mapInArrow(read, schema)


def parsed(block: bytes, cuts: np.ndarray) -> tuple[list[np.ndarray], list[int | None]]:
    """Ids and document ids of the records between ``cuts``, checked."""
    raw = np.frombuffer(block, np.uint8)
    begin, size = cuts[:-1], np.diff(cuts) - 16
    field = lambda at, n: raw[at[:, None] + np.arange(n)].reshape(-1)
    lengths, at = field(begin, 8), np.arange(len(begin)) * 8
    end = np.cumsum(size)
    data = raw[np.repeat(begin + 12 - (end - size), size) + np.arange(end[-1])]
    ok = (lengths.view("<u8") == size) & (field(begin + 8, 4).view("<u4") == masked(crc32c(lengths, at, at + 8)))
    if not (ok & (field(begin + 12 + size, 4).view("<u4") == masked(crc32c(data, end - size, end)))).all():
        raise ValueError("a record does not match its length or checksum")
    ids, doc_ids = [], []
    for b, e in zip(end - size, end, strict=True):
        head = data[b: b + _HEAD.itemsize].view(_HEAD)[0]
        ids.append(data[b + _HEAD.itemsize: e].view(f"<u{head['width']}"))
        doc_ids.append(int(head["doc_id"]) if head["has_id"] else None)
    return ids, doc_ids


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` to a new folder of the shared place and reads it back."""
    folder = scratch_path(docs.sparkSession, "token-records")
    return read_token_records(write_token_records(docs, folder, tokenizer, end_id))
